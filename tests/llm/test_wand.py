import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketmill.llm import wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, key, score) by the definition, every document scored for every item."""
    bags = [(key, Counter(cut(t))) for key, t in docs]
    n, long = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for key, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // max(long, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in cut(text) if t in bag)
            if s > 0:
                scores.append((-s, key is None, key))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(scores[:k])]
    return sorted(out, key=str)


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["Ünder", "日本", "x1", "THE"]
    pick = lambda: words[min(int(rnd.expovariate(0.02)), len(words) - 1)]
    docs = [(i, " ".join(pick() for _ in range(rnd.randrange(1, 80)))) for i in range(700)]
    items = [(i, " ".join(pick() for _ in range(rnd.randrange(1, 12)))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("docs_most,postings_most", [(37, 10**6), (10**6, 900), (10**6, 10**6)])
def test_rankings_are_those_of_brute_force(spark, corpus, docs_most, postings_most):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    found = wand.index(d, of=wand.vocabulary(q), shard_docs=docs_most, shard_postings=postings_most)
    assert plain(wand.search(found, q)) == brute(docs, items)


def test_an_index_of_all_terms_gives_the_same(spark, corpus):
    docs, items = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert wand.vocabulary(q, most=3) is None
    assert plain(wand.search(wand.index(d), q, k=3)) == brute(docs, items, 3)


def least(values, cost, longest):
    best = [0] + [None] * len(values)
    for j in range(1, len(values) + 1):
        best[j] = min(best[i] + max(values[i:j]) * (j - i) + cost for i in range(max(0, j - longest), j))
    return best[-1]


def test_blocks_have_the_least_error():
    rng = np.random.default_rng(4)
    lists = [rng.integers(1, 1000, n) for n in (1, 2, 7, 300, 64, 65, 129, 1, 40)] + [np.full(200, 5), np.sort(rng.integers(1, 99, 150))]
    sizes, counts = wand.cut_lists(np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]))
    at = 0
    for values, n in zip(lists, counts):
        own, at = sizes[at : at + n], at + n
        ends = np.cumsum(own)
        assert own.sum() == len(values) and own.max() <= wand.LONGEST
        cost = int(values.max()) * wand.BLOCK_COST
        got = sum(int(values[e - s : e].max()) * int(s) + cost for s, e in zip(own, ends))
        assert got == least(values.tolist(), cost, wand.LONGEST)


def test_blocks_are_skipped():
    """Documents with a rare term come first; the blocks of a common one elsewhere are not decoded."""
    docs = np.concatenate([np.arange(4096), [100]])
    values = np.concatenate([np.full(4096, 10), [900]])
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return super().__getitem__(at)

    shard = wand.Shard(list(range(4096)), ["common", "rare"], np.array([4096, 1]), docs, values, np.array([64, 1]), np.array([64] * 64 + [1]), np.array([10] * 64 + [900]))
    shard.docs = docs.view(Seen)
    assert shard.best([(0, 1), (1, 50)], 1, []) == [(-45010, False, 100)]
    assert sum(read) < 300


def test_terms_are_those_of_the_pattern():
    text = "Ab1_ü-É x\x00y\x7fZ 日本,日 " * 3
    assert [t.decode() for part in wand.terms(text) for t in part] == cut(text)
    long = "word Ünd " * 300_000
    parts = list(wand.terms(long))
    assert len(parts) > 1 and sum(map(len, parts)) == 600_000 and {t for p in parts for t in p} == {b"word", "Ünd".encode()}


def test_awkward_rows(docs, clashing, none, awkward, spark):
    items = [(1, "one two ALPHA the the"), (1, "one two ALPHA the the"), (None, "naïve ß"), (2, None), (3, ""), (4, "nowhere"), (5, "日本 delta 12345")]
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in awkward], items)
    assert plain(wand.ranked(docs, q)) == want
    more = q.withColumns({c: F.lit("x") for c in ("k", "q", "score", "rank", "doc_id")})
    assert plain(wand.ranked(clashing, more)) == want
    assert wand.ranked(none, q).collect() == [] and wand.ranked(docs, q.limit(0)).collect() == []
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "name string, body string")
    got = plain(wand.ranked(named, spark.createDataFrame([("i", "y")], "item_id string, text string"), key="name", text="body"))
    assert [r[:3] for r in got] == [("i", 1, "a"), ("i", 2, "b")]
