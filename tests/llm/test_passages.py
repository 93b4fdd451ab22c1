import random

from docketmill.llm import passages

rnd = random.Random(8)
WORDS = ["".join(rnd.choice("abcdefghijklmnoé") for _ in range(rnd.randrange(2, 10))) for _ in range(500)]
text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))


def gear(data):
    h, out = 0, []
    for i, b in enumerate(data):
        h = (2 * h + int(passages.GEAR[b])) & 0xFFFF
        if h < 65536 // passages.RARITY and i + 1 < len(data) and data[i + 1] & 0xC0 != 0x80:
            out.append(i + 1)
    return out


def test_hash_by_doubling_is_the_rolling_hash(monkeypatch):
    import numpy as np

    data = text(400).encode()
    for size in (1 << 20, 100):
        monkeypatch.setattr(passages, "BYTES_AT_ONCE", size)
        assert passages.candidates(np.frombuffer(data, np.uint8)).tolist() == gear(data)


def test_chunks_cover_the_text_within_bounds_and_resist_shifts():
    for t in (text(300), "é" * 500, "x" * 1000, "a", "", text(5)):
        data = t.encode()
        ends = passages.chunks(data)
        starts = [0, *ends][: len(ends)]
        assert b"".join(data[a:b] for a, b in zip(starts, ends, strict=True)) == data
        assert all(b - a <= passages.LONGEST and data[a:b].decode() for a, b in zip(starts, ends, strict=True))
        assert all(b - a >= passages.SHORTEST - 3 for a, b in zip(starts[:-1], ends[:-1], strict=True))
    data = text(2000).encode()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *passages.chunks(d)], passages.chunks(d), strict=False)}
    before, after = pieces(data), pieces(b"inserted " + data[:3000] + b" and here" + data[3000:])
    assert len(before & after) > 0.95 * len(before)


def test_a_word_said_over_and_over_resists_shifts():
    said = b"over " * 120
    pieces = lambda d: {d[a:b] for a, b in zip([0, *passages.chunks(d)], passages.chunks(d), strict=False)}
    for before in (b"", b"x", b"something else in front of it: "):
        assert pieces(before + said + b"and after") & pieces(b"begun otherwise " + said + b"ended otherwise")


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    shared = [text(n) for n in (51, 60, 120, 12)]
    rows = [(i, text(200)) for i in range(40)]
    for k, passage in enumerate(shared):
        rows += [(1000 * (k + 1) + i, f"{text(60)} {passage} {text(40)}") for i in range(100 if k == 0 else 6)]
    rows += [(900, None), (901, ""), (902, "short"), (None, text(30) + " " + shared[1]), (903, (p := text(60)) + " " + text(30) + " " + p)]
    rows += [(904, whole := text(5000)), (905, whole), (905, whole)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.repeated_passages(docs).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append(r)
    assert set(spans) == {1000 + i for i in range(100)} | {1000 * k + i for k in (2, 3) for i in range(6)} | {None, 904, 905}
    texts = dict(rows)
    for key, found in spans.items():
        for r in found:
            part = texts[key][r.start : r.end]
            assert any(part in t for k, t in rows if t and k != key) and len(part.split()) >= passages.LEAST_WORDS
            assert r.is_first == (key == r.first_doc_id)
    assert {r.first_doc_id for k, v in spans.items() for r in v if k in range(1000, 1100)} == {1000}
    assert all(r.end - r.start > 0.95 * len(whole) for k in (904, 905) for r in spans[k])


def by_hand(rows):
    """(key, start, end, words, first) of runs of neighbouring chunks that stand in several rows, over characters."""
    where, cut = {}, []
    for i, (_, t) in enumerate(rows):
        data = (t or "").encode()
        ends = passages.chunks(data)
        edges = [len(data[:e].decode()) for e in [0, *ends]]
        each = [(edges[k], edges[min(k + 2, len(ends))]) for k in range(max(1, len(ends) - 1))] if ends else []
        cut.append(each)
        for a, b in each:
            where.setdefault(t[a:b], set()).add(i)
    out = []
    for (key, t), each in zip(rows, cut, strict=True):
        run = []
        for a, b in [*each, (None, None)]:
            if a is not None and len(where[t[a:b]]) > 1:
                run.append((a, b))
            elif run:
                s, e = run[0][0], run[-1][1]
                keys = [rows[i][0] for x, y in run for i in where[t[x:y]] if rows[i][0] is not None]
                words = sum(not t[i].isspace() and (i == 0 or t[i - 1] in " \t\n\v\f\r") for i in range(s, e))
                out.append((key, s, e, words, min(keys, default=None)))
                run = []
    return sorted(map(str, out))


def test_every_run_against_brute_force(spark, docs, awkward):
    got = sorted(str((r.doc_id, r.start, r.end, r.n_words, r.first_doc_id)) for r in passages.repeated_passages(docs, least_words=0).collect())
    assert got == by_hand([(r[0], r[1]) for r in awkward]) and len(got) > 6
    part, other = text(60), text(50)
    tabbed = part.replace(" ", "\t")
    rows = [("b", f"{text(20)} {part}"), ("a", f"{part} {text(9)}"), ("a", f"{text(5)}\n{part}"), (None, f"{text(20)} {other}"), (None, f"{other} {text(8)}"), ("c", tabbed), ("d", f"x\v{tabbed}"), ("c", tabbed), ("e", "a b c")]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    assert sorted(str((r.doc_id, r.start, r.end, r.n_words, r.first_doc_id)) for r in found) == [x for x in by_hand(rows) if eval(x)[3] >= passages.LEAST_WORDS]
    assert sorted((str(r.doc_id), r.is_first) for r in found) == [("None", True), ("None", True), ("a", True), ("a", True), ("b", False), ("c", True), ("c", True), ("d", False)]


def test_few_digests_at_a_time_give_the_same(spark, docs, monkeypatch):
    rows = lambda: sorted(map(str, passages.repeated_passages(docs).collect()))
    whole = rows()
    monkeypatch.setattr(passages, "GATHERED", 50)
    monkeypatch.setattr("docketmill.llm.common.ROWS_AT_ONCE", 3)
    assert rows() == whole


def test_empty_table_and_clashing_columns(none, clashing, docs):
    assert passages.repeated_passages(none).collect() == []
    rows = lambda d: sorted(map(str, passages.repeated_passages(d).collect()))
    assert rows(clashing) == rows(docs)
