"""Clusters around centroids, by filtering through kd-trees over blocks of each partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketmill.llm.common import cut

#: What components are multiplied by before they are cut down to whole numbers, and where those numbers end: squared
#: distances of 64 of them stay below 2^62.
SCALE, MOST = 256, 1 << 27
#: Vectors in a tree, and in one of its leaves.
BLOCK, LEAF = 2048, 32
#: Up to this size of components, products in doubles are exact.
EXACT = 1 << 20


def whole_numbers(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the rows that are kept, their components as whole numbers): vectors of `size` components, none null or not
    finite. A component beyond MOST after scaling counts as MOST, as distances could not be told in 64 bits."""
    rows = np.flatnonzero(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), size).to_numpy(zero_copy_only=False))
    flat = pc.fill_null(vectors.take(pa.array(rows, pa.int64())).flatten().cast(pa.float64()), np.nan)
    found = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    finite = np.isfinite(found).all(axis=1)
    return rows[finite], np.clip(np.floor(found[finite] * SCALE), -MOST, MOST).astype(np.int64)


class Tree:
    """A kd-tree over a block of vectors: each node has its part of the rows, a box, a count and the sums of its rows.

    The rows are in the tree's order, nodes level by level; a node's children follow each other, `left` is the first
    (-1: a leaf). Nodes are halved at the median of their widest component.
    """

    def __init__(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.rows, self.start, self.end, self.left, self.low, self.high, self.sums = rows, start, end, left, low, high, sums

    @classmethod
    def over(cls, rows: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree, and the order into which it has brought the rows."""
        order, spans, left, at = np.arange(len(rows)), [(0, len(rows))], [], 0
        while at < len(spans):
            a, b = spans[at]
            part = rows[order[a:b]]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            if b - a > leaf and part[:, widest].max() > part[:, widest].min():
                middle = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, widest], middle - a)]
                left.append(len(spans))
                spans += [(a, middle), (middle, b)]
            else:
                left.append(-1)
            at += 1
        rows = rows[order]
        ends = [rows[a:b] for a, b in spans]
        boxes = [np.array([f(x, axis=0) for x in ends]) for f in (np.min, np.max, np.sum)]
        start, end = np.array(spans).T
        return cls(rows, start, end, np.array(left), *boxes), order

    def filtered(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes given whole, the centre of each, leaves to be looked at, the centres that each may still have).

        In a node, a centre goes if it is farther than another, the one nearest the box's middle, from every point
        of the box, which the corner farthest in its direction tells; or never nearer and of a larger number.
        """
        number, squares = np.arange(len(centres)), (centres**2).sum(axis=1)
        nodes, may = np.array([0]), np.ones((1, len(centres)), bool)
        whole, owner, leaves, left_over = [], [], [], []
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            middle = squares * 4.0 - 4.0 * ((low + high).astype(float) @ centres.T.astype(float))
            best = np.where(may, middle, np.inf).argmin(axis=1)
            apart = centres[None] - centres[best][:, None]
            corner = np.where(apart > 0, high[:, None], low[:, None])
            farther = squares[None] - squares[best][:, None] - 2 * (apart * corner).sum(axis=2)
            may &= ~((farther > 0) | ((farther == 0) & (number[None] > best[:, None])))
            one, leaf = may.sum(axis=1) == 1, self.left[nodes] < 0
            whole.append(nodes[one])
            owner.append(may[one].argmax(axis=1))
            leaves.append(nodes[~one & leaf])
            left_over.append(may[~one & leaf])
            down = ~one & ~leaf
            nodes, may = np.concatenate([self.left[nodes[down]], self.left[nodes[down]] + 1]), np.concatenate([may[down], may[down]])
        return np.concatenate(whole), np.concatenate(owner), np.concatenate(leaves), np.concatenate(left_over)

    def nearest(self, centres: np.ndarray, leaves: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the leaves, the nearest of the centres that the leaf may have; of equals the first)."""
        sizes = self.end[leaves] - self.start[leaves]
        places = np.concatenate([np.arange(a, b) for a, b in zip(self.start[leaves], self.end[leaves], strict=True)] or [np.zeros(0, int)])
        found = self.rows[places]
        kind = float if max(np.abs(found).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT else np.int64
        far = (centres**2).sum(axis=1) - 2 * (found.astype(kind) @ centres.T.astype(kind)).astype(np.int64)
        return places, np.where(np.repeat(may, sizes, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)

    def summed(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many rows each centre is nearest to, their sums)."""
        count, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        whole, owner, leaves, may = self.filtered(centres)
        np.add.at(count, owner, self.end[whole] - self.start[whole])
        np.add.at(sums, owner, self.sums[whole])
        places, nearest = self.nearest(centres, leaves, may)
        np.add.at(count, nearest, 1)
        np.add.at(sums, nearest, self.rows[places])
        return count, sums

    def assigned(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the nearest centre of each row, its squared distance)."""
        out = np.zeros(len(self.rows), np.int64)
        whole, owner, leaves, may = self.filtered(centres)
        for node, centre in zip(whole, owner, strict=True):
            out[self.start[node] : self.end[node]] = centre
        places, nearest = self.nearest(centres, leaves, may)
        out[places] = nearest
        return out, ((self.rows - centres[out]) ** 2).sum(axis=1)


#: A tree's parts as they are stored; sums alone need 64 bits.
_PARTS = {"rows": "<i4", "start": "<i4", "end": "<i4", "left": "<i4", "low": "<i4", "high": "<i4", "sums": "<i8"}


def _planted(size: int, block: int, leaf: int):
    """Trees over blocks of a partition's vectors, a row for each; what is left at the end is a smaller one."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, held = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            every, vectors = pa.concat_arrays(keys), np.concatenate(found)
            for a in range(0, len(vectors), block):
                tree, order = Tree.over(vectors[a : a + block], leaf)
                own = every.slice(a, block).take(pa.array(order))
                own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([own, *(pa.array([getattr(tree, p).astype(t).tobytes()], pa.binary()) for p, t in _PARTS.items())], names=["keys", *_PARTS])

        for batch in batches:
            kept, vectors = whole_numbers(batch.column("v"), size)
            keys.append(batch.column("k").take(pa.array(kept, pa.int64())))
            found.append(vectors)
            held += len(kept)
            while held >= block:
                every, vectors = pa.concat_arrays(keys), np.concatenate(found)
                full = held - held % block
                keys, found = [every.slice(0, full)], [vectors[:full]]
                yield from rows()
                keys, found, held = [every.slice(full)], [vectors[full:]], held - full
        if held:
            yield from rows()

    return plant


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            parts = [np.frombuffer(batch.column(p)[i].as_buffer(), t).astype(np.int64) for p, t in _PARTS.items()]
            rows, start, end, left, low, high, sums = parts
            yield batch.column("keys")[i].values, Tree(rows.reshape(-1, size), start, end, left, low.reshape(-1, size), high.reshape(-1, size), sums.reshape(-1, size))


def _first(trees: DataFrame, size: int, centres: int, seed: int) -> np.ndarray:
    """The vectors whose keys have the least digests, in the order of the digests."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for keys, tree in _trees(batches, size):
            digests = [(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), i) for i, k in enumerate(keys.to_pylist()) if k is not None]
            best = sorted([*best, *((d, tree.rows[i].tolist()) for d, i in sorted(digests)[:centres])])[:centres]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], names=["digest", "v"])

    found = trees.mapInArrow(first, "digest string, v array<bigint>").orderBy("digest", "v").limit(centres).collect()
    return np.array([r.v for r in found], np.int64).reshape(-1, size)


def _moved(trees: DataFrame, size: int, now: np.ndarray) -> np.ndarray:
    """The means, cut down to whole numbers, of the vectors nearest to each centre; one without vectors stays."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
        for _, tree in _trees(batches, size):
            c, s = tree.summed(now)
            count, sums = count + c, sums + s
        table = np.concatenate([count[:, None], sums], axis=1)[count > 0]
        number = np.repeat(np.flatnonzero(count), size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(np.tile(np.arange(size + 1, dtype=np.int32), len(table))), pa.array(table.ravel())], names=["cluster", "place", "value"])

    parts = trees.select(*_PARTS, "keys").mapInArrow(summed, "cluster int, place int, value bigint")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found.setdefault(r.cluster, {})[r.place] = int(r.value)
    return np.array([[found[c][i + 1] // found[c][0] for i in range(size)] if c in found else old.tolist() for c, old in enumerate(now)], np.int64)


def clusters(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", size: int = 64, centres: int = 40, rounds: int = 5, seed: int = 2, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance), the centres in order): one row for each vector that is kept.

    A vector is kept if it has `size` components, none null or not finite; they become floor(256 x). Centres begin as
    the vectors with the least SHA-256 of `seed:key`; a null key is assigned, but no centre begins with it. Each
    round every vector goes to its nearest centre by squared distance, of equals to the first, and centres become
    the rounded-down means of their vectors; then vectors are assigned once more. With fewer vectors than centres there
    are as many centres as vectors. All is exact, in whole numbers. No vectors give no rows; repeated rows are
    vectors of their own; other columns are not read.

    The vectors are read once, into trees over blocks of each partition that the shared folder holds; no vector is
    shuffled, so no key, label or repeated vector can make a partition hot. A round sends the centres out and takes
    back one count and sum for each centre and task.
    """
    kind = dict(vectors.dtypes)[key]
    plain = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    trees = cut(plain.mapInArrow(_planted(size, block, leaf), f"keys array<{kind}>, " + ", ".join(f"{p} binary" for p in _PARTS)))
    now = _first(trees, size, centres, seed)
    for _ in range(rounds if len(now) else 0):
        now = _moved(trees, size, now)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, tree in _trees(batches, size):
            owner, far = tree.assigned(now)
            yield pa.RecordBatch.from_arrays([keys, pa.array(owner.astype(np.int32)), pa.array(far)], names=["k", "cluster", "distance"])

    if not len(now):
        trees = trees.limit(0)
    return trees.mapInArrow(assigned, f"k {kind}, cluster int, distance bigint").withColumnRenamed("k", key), now.tolist()


def described(assigned: DataFrame, centres: list[list[int]]) -> DataFrame:
    """The rows of clusters() with the distances summed over their cluster and over all, and the SHA-256 of its centre."""
    assigned = cut(assigned)
    summed = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, str(summed.get(c, 0)), str(sum(summed.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centres)]
    of = assigned.sparkSession.createDataFrame(rows, "cluster int, own string, every string, centroid_sha256 string")
    long = lambda c: F.expr(f"try_cast({c} as bigint)")
    return assigned.join(F.broadcast(of), "cluster").select(*assigned.columns, long("own").alias("cluster_inertia"), long("every").alias("inertia"), "centroid_sha256")
