import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketmill.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, size, k, rounds, seed=2):
    """The definition, in Python's own whole numbers."""
    kept = [(key, [max(-centroids.MOST, min(centroids.MOST, math.floor(256 * x))) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)[:k]
    centres = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else centres[c] for c in range(len(centres))]
    return sorted(((key, near(v), far(v, centres[near(v)])) for key, v in kept), key=str) if centres else [], centres


def rows_of(n, size, seed=1, spread=0.1):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    f32 = lambda x: float(np.float32(x))
    return [(i, [f32(m + rnd.gauss(0, spread)) for m in rnd.choice(middles)]) for i in range(n)]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA).repartition(3)
    assigned, centres = centroids.clusters(frame, **options)
    return sorted((tuple(r) for r in assigned.collect()), key=str), centres


@pytest.mark.parametrize("size,spread,block,leaf", [(2, 0.1, 64, 4), (8, 0.5, 50, 8), (8, 2.0, 2048, 32)])
def test_clusters_are_those_of_the_definition(spark, size, spread, block, leaf):
    rows = rows_of(400, size, spread=spread)
    assert found(spark, rows, size=size, centres=7, rounds=4, block=block, leaf=leaf) == brute(rows, size, 7, 4)


def test_trees_give_whole_nodes_and_leave_centres_out():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-20, 20, (300, 3)), rng.integers(980, 1020, (300, 3))]).astype(np.int64)
    tree, order = centroids.Tree.over(rows, 8)
    assert sorted(order.tolist()) == list(range(600)) and (tree.rows == rows[order]).all()
    assert (tree.sums[0] == rows.sum(axis=0)).all() and (tree.low[0] == rows.min(axis=0)).all()
    centres = np.array([[0, 0, 0], [1000, 1000, 1000], [5, 5, 5]])
    whole, owner, leaves, may = tree.filtered(centres)
    assert (tree.end[whole] - tree.start[whole])[owner == 1].sum() == 300  # the far heap goes whole
    assert not may[:, 1].any() and (tree.end[leaves] - tree.start[leaves]).sum() < 300


@pytest.mark.parametrize("seed", range(5))
def test_filtering_loses_no_nearest_centre(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-6, 6, (500, 2)).astype(np.int64)
    centres = np.concatenate([rng.integers(-6, 6, (8, 2)), [[0, 0], [0, 0]]])
    tree, _ = centroids.Tree.over(rows, 16)
    far = ((tree.rows[:, None] - centres[None]) ** 2).sum(axis=2)
    owner, distance = tree.assigned(centres)
    assert (owner == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    count, sums = tree.summed(centres)
    assert count.tolist() == np.bincount(owner, minlength=10).tolist() and all((sums[c] == tree.rows[owner == c].sum(axis=0)).all() for c in range(10))


def test_equal_vectors_ties_repeats_and_few_vectors(spark):
    same = [(i, [0.5, 0.25]) for i in range(100)] + [(3, [0.5, 0.25]), (200, [1.0, 1.0]), (None, [1.0, 1.0])]
    assert found(spark, same, size=2, centres=5, rounds=2, block=16, leaf=2) == brute(same, 2, 5, 2)
    few = rows_of(3, 2)
    assert found(spark, few, size=2, centres=40, rounds=2) == brute(few, 2, 40, 2)


def test_vectors_that_are_not_kept(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [3e38, -3e38]), (9, [1.0, 2.0, 3.0]), (10, [-0.001, 0.0])]
    got = found(spark, rows, size=2, centres=2, rounds=1)
    assert got == brute(rows, 2, 2, 1) and {r[0] for r in got[0]} == {1, 8, 10}
    assert found(spark, [(1, None)], size=2) == ([], [])
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.described(*centroids.clusters(empty)).collect() == []


def test_large_components_are_exact():
    rng = np.random.default_rng(5)
    rows = rng.integers(-centroids.MOST, centroids.MOST, (200, 64))
    centres = np.concatenate([rows[:4] + 1, rows[:4] - 1])
    tree, _ = centroids.Tree.over(rows, 32)
    owner, distance = tree.assigned(centres)
    want = [min(((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c))), i) for i, c in enumerate(centres)) for v in tree.rows]
    assert [(int(d), int(o)) for d, o in zip(distance, owner)] == want


def test_whole_numbers_round_down():
    _, found = centroids.whole_numbers(pa.array([[0.999 / 256, -0.001]], pa.list_(pa.float32())), 2)
    assert found.tolist() == [[0, -1]]


def test_described_sums_and_clashing_columns(spark):
    rows = rows_of(60, 2)
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("cluster", "distance", "k", "v", "keys", "own")})
    assigned, centres = centroids.clusters(frame, size=2, centres=4, rounds=2)
    got = [r.asDict() for r in centroids.described(assigned, centres).collect()]
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for c in {r["cluster"] for r in got}:
        own = [r for r in got if r["cluster"] == c]
        assert {r["cluster_inertia"] for r in own} == {sum(r["distance"] for r in own)}
        assert {r["centroid_sha256"] for r in own} == {hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()}
