import random

import numpy as np
import pytest

from docketmill.llm import near_copies, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string"


def words_of(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def edited(words, *places):
    return " ".join("edited" + str(i) if i in places else w for i, w in enumerate(words))


def test_stage_takes_edited_copies_and_leaves_others(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        words = words_of(rnd, 80)
        # One word of 80 changed: 71 of 81 shingles shared. Two apart: 66 of 86, which is under 0.8.
        rows += [(i, edited(words)), (100 + i, edited(words, 40)), (200 + i, edited(words, 20, 60)), (300 + i, edited(words).upper())]
    rows += [(900, None), (901, ""), (902, "too short"), (903, "too  SHORT"), (904, "too short too")]
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()]
    assert sorted(kept) == [*range(40), *range(200, 240), 900, 902, 904]
    bits = [(simhash.fingerprint(rows[4 * i][1]) ^ simhash.fingerprint(rows[4 * i + 1][1])).bit_count() for i in range(40)]
    assert sum(b > 2 for b in bits) > 20


@pytest.mark.parametrize("stars", [3, near_copies.STAR_ROUNDS, 30])
def test_groups_against_brute_force(spark, monkeypatch, stars):
    monkeypatch.setattr(near_copies, "STAR_ROUNDS", stars)
    rnd = random.Random(8)
    texts = []
    for _ in range(6):
        words = words_of(rnd, 100)
        for _ in range(25):
            at = rnd.sample(range(100), rnd.randrange(5))
            texts.append(edited(words, *at) if rnd.random() < 0.5 else edited(edited(words, *at).split(), *rnd.sample(range(100), 1)))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_copies.near_copies(spark.createDataFrame([*enumerate(texts)], SCHEMA).repartition(3), key="doc_id").collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(texts))} and len(got) == len(texts)


def test_exactly_four_fifths_count_and_bands_reach_them():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert near_copies.near(a, b) and not near_copies.near(a[:8], b[:8])
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(1000):
        h = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        met += any(x == y for x, y in zip(near_copies.bands(h[:90]), near_copies.bands(h[10:]), strict=True))
    assert met >= 997


def test_no_rows(spark):
    assert near_copies.near_copies(spark.createDataFrame([], SCHEMA), key="doc_id").collect() == []


def test_simhash_links_what_no_band_holds(spark, monkeypatch):
    """The named method gives rows by itself: without min-hash bands, close copies are still told, and no others."""
    monkeypatch.setattr(near_copies, "bands", lambda hashes: [])
    rnd = random.Random(5)
    rows = []
    for i in range(10):
        words = words_of(rnd, 2000)
        rows += [(i, " ".join(words)), (100 + i, " ".join(words) + " more")]
    sets = [near_copies.shingles(t) for _, t in rows]
    bits = [(near_copies.fingerprint(a) ^ near_copies.fingerprint(b)).bit_count() for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(b <= 2 for b in bits) > 5
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, SCHEMA), key="doc_id").collect()}
    assert got == {i: i for i in range(10)} | {100 + i: i if bits[i] <= 2 else 100 + i for i in range(10)}


def test_roots_are_composed_before_rows_are_renamed(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "old long, new long")
    got = near_copies._composed(frame((9, 5), (8, 6)), [frame((5, 3)), frame((3, 1), (6, 2))])
    assert {(r.old, r.new) for r in got.collect()} == {(9, 1), (8, 2), (5, 1), (3, 1), (6, 2)}
    assert near_copies._composed(None, []) is None


@pytest.mark.parametrize("block", [7, 256])
def test_no_pair_of_a_large_band_is_left_out(spark, monkeypatch, block):
    """One band holds all texts; near copies of each other are none of those that the others are compared with first."""

    def signed(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([t.encode() for t in batch.column("text").to_pylist()], pa.binary()), pa.array([[1]] * n, pa.list_(pa.int64())), pa.array([k * 0x1F3D5B79A6C8E ^ k << 50 for k in batch.column("k").to_pylist()], pa.int64())], names=["k", "digest", "bands", "fp"])

    monkeypatch.setattr(near_copies, "_signed", signed)
    monkeypatch.setattr(near_copies, "BLOCK", block, raising=False)
    rnd = random.Random(11)
    rows = [(i, " ".join(words_of(rnd, 60))) for i in range(40)]
    rows += [(100 + i, edited(rows[i][1].split(), 30)) for i in (20, 33, 39)] + [(200, edited(rows[39][1].split(), 30, 31))]
    got = near_copies.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), key="doc_id").collect()
    assert {r.doc_id: r.component_id for r in got} == {k: {120: 20, 133: 33, 139: 39, 200: 39}.get(k, k) for k, _ in rows}
