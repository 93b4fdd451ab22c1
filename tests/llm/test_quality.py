import random
import re
from collections import Counter

from docketmill.llm import quality


def brute(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rule(docs, awkward):
    got = quality.verdicts(docs).collect()
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted((r[0] or -1, *brute(r[1])) for r in awkward)
    assert sorted((r.doc_id or -1, *(r[c] for c in cols)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repeated_windows():
    rnd = random.Random(2)
    for _ in range(200):
        words = [rnd.choice("abc") for _ in range(rnd.randrange(40))]
        assert quality.repeated_words([w.encode() for w in words]) == brute(" ".join(words))[4]


def test_sketch_merges_and_bounds_its_error(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["en", "de"]), rnd.choice("ab"), rnd.randrange(100, 3000), 0, 1, 0, 300, 0) for i in range(3000)]
    names = "doc_id long, lang string, source string, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_words long, n_repeat_words long"
    frame = spark.createDataFrame(rows, names)
    whole = {r.q0 for r in quality.quantiles(quality.sketch(frame), [], [0.5]).where("rate = 'word_length'").collect()}
    halves = quality.sketch(frame.where("doc_id < 1500")).union(quality.sketch(frame.where("doc_id >= 1500")))
    assert whole == {r.q0 for r in quality.quantiles(halves, [], [0.5]).where("rate = 'word_length'").collect()}
    exact = sorted(r[3] / 300 for r in rows)[1499]
    assert abs(whole.pop() / exact - 1) < 0.02


def test_outliers_of_a_group_go_and_the_rest_stays(spark):
    rnd = random.Random(6)
    text = lambda size: " ".join("".join(rnd.choice("abcdefghij") for _ in range(size)) for _ in range(50))
    rows = [(i, text(rnd.choice([5, 6, 7])), "en", "a", 0) for i in range(200)] + [(900 + i, text(40), "en", "a", 0) for i in range(5)]
    rows += [(2000 + i, text(40), "de", "a", 0) for i in range(150)]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[i] for i in range(200)) and all(got[2000 + i] for i in range(150)) and not any(got[900 + i] for i in range(5))


def test_empty_table_and_clashing_columns(none, clashing, docs):
    assert quality.verdicts(none).collect() == []
    rows = lambda d: sorted(map(str, quality.verdicts(d).collect()))
    assert rows(clashing) == rows(docs)
