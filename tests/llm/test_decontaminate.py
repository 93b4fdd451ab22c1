import random

import pytest

from docketmill.llm import decontaminate

rnd = random.Random(11)
WORDS = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
ITEMS = [(i, text(rnd.randrange(8, 40))) for i in range(12)]


def distance(item, part):
    """Least edits between the item and any part of a text, by the plain table."""
    row = [0] * (len(part) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(part):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rnd.randrange(len(s)), rnd.randrange(3)
        if kind == 0:
            s[at] = rnd.choice("uvwxyz")
        elif kind == 1:
            s.insert(at, rnd.choice("uvwxyz"))
        else:
            del s[at]
    return "".join(s)


@pytest.fixture(scope="module")
def cases():
    rows = [(1, None), (2, ""), (3, text(200)), (None, ITEMS[0][1])]
    for i, (_, item) in enumerate(ITEMS):
        most = int(len(item) * decontaminate.BUDGET)
        for k, n in enumerate((0, most // 2, most, most + 3, 3 * most)):
            rows.append((100 + 10 * i + k, f"{text(20)} {edited(item, n)} {text(15)}"))
        rows.append((100 + 10 * i + 5, f"{text(3)}\n {item.upper().replace(' ', chr(10) + '  ')}\t{text(3)} {item}"))
    rows += [(5000, text(20_000) + " " + ITEMS[3][1]), (5001, ITEMS[4][1]), (5001, ITEMS[4][1])]
    return rows


def test_against_the_plain_distance(spark, cases):
    items = spark.createDataFrame([*ITEMS, (77, ITEMS[5][1]), (78, None), (79, "short"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame(cases, "doc_id long, text string").repartition(4)
    got = decontaminate.contamination(docs, items).collect()
    found = {(r.doc_id, r.item_id, r.distance) for r in got}
    want = set()
    for key, t in cases:
        for number, item in ITEMS:
            d = distance(decontaminate.normalise(item), decontaminate.normalise(t or "")[-900 if key == 5000 else 0 :]) if t else 99
            if d <= int(len(item) * decontaminate.BUDGET):
                want |= {(key, n, d) for n in ([5, 77] if number == 5 else [number])}
    best = {}
    for key, number, d in found:
        best[key, number] = min(d, best.get((key, number), 99))
    assert {(k, n, d) for (k, n), d in best.items()} == want and len(want) > 40
    whole = dict(cases)
    for r in got:
        if r.distance == 0 and r.doc_id is not None:
            assert decontaminate.normalise(whole[r.doc_id][r.start : r.end]) == dict(ITEMS).get(r.item_id, ITEMS[5][1])
    assert sum(r.doc_id == 5001 for r in got) == 2
    assert all(sum(r.doc_id == 100 + 10 * i + 5 and r.item_id == i for r in got) == 2 for i in range(12))


def test_blocks_give_the_same_and_clean_keeps_the_rest(spark, cases, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    rows = lambda: sorted(map(str, decontaminate.contamination(docs, items).collect()))
    whole = rows()
    real = decontaminate.blocks
    dirty = {r.doc_id for r in decontaminate.contamination(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "GATHERED", 3000)
    for together in (64, 2):
        monkeypatch.setattr(decontaminate, "blocks", lambda i: real(i, most=500, together=together))  # noqa: B023
        groups = list(decontaminate.blocks(items))
        assert sum(map(len, groups)) > 3 and (len(groups) == 1) == (together == 64) and max(map(len, groups)) <= together
        assert sorted(t for g in groups for b in g for t in b) == sorted(ITEMS)
        assert rows() == whole
    kept = decontaminate.clean(docs, items).collect()
    assert {r.doc_id for r in kept} == {k for k, _ in cases} - dirty and {1, 2, 3} <= {r.doc_id for r in kept}


def test_empty_tables_and_clashing_columns(spark, none, clashing, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(none, items).collect() == []
    assert decontaminate.contamination(docs, items.limit(0)).collect() == []
    assert decontaminate.clean(clashing, items).columns == clashing.columns
    planted = spark.createDataFrame([(1, "One two three four five six seven eight")], "item_id long, text string")
    rows = lambda d: sorted(map(str, decontaminate.contamination(d, planted).collect()))
    assert rows(clashing) == rows(docs) and len(rows(docs)) == 3


def test_short_items_stand_exactly_and_between_words(spark):
    """Against a search by regular expression at both sides of the border."""
    import re

    items = [("a", "What is 2+2?"), ("b", "one"), ("c", "x"), ("d", "nineteen characters"), ("e", "twenty characters ab"), ("f", "  "), ("g", "WHAT is  2+2?"), (None, "seven")]
    texts = ["Asked: what is\n2+2? And: what is 2+2?4", "one, none, one two ONE", "x\tx xx", "nineteen characters nineteen charactors", "twenty characters ab twenty charactors ab", "", None, "seventh seven"]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = sorted((str(r.item_id), r.doc_id, r.start, r.end) for r in decontaminate.contamination(frame, spark.createDataFrame(items, "item_id string, text string")).collect())
    want = []
    for key, item in items:
        words = item.split()
        pattern = r"\s+".join(map(re.escape, words))
        for k, t in enumerate(texts):
            if key == "e" and t and "twenty" in t:
                want += [("e", k, 0, 20), ("e", k, 21, 41)]
            elif words and key != "e":
                edges = (r"(?<![^\W_])" if words[0][0].isalnum() else "") + pattern + (r"(?![^\W_])" if words[-1][-1].isalnum() else "")
                want += [(str(key), k, m.start(), m.end()) for m in re.finditer(edges, t or "", re.I)]
    assert got == sorted(want) and len(want) > 12
