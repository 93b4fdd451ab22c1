"""Near copies by the Jaccard similarity of word shingles: SimHash ball hashing first, min-hash bands for what it can't
reach, every link verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketmill.llm.common import cut, drop, slices, small
from docketmill.llm.components import components
from docketmill.llm.simhash import links

#: Two texts are near copies if they share SHARED of OF or more of their different shingles of WORDS words.
WORDS, SHARED, OF = 5, 4, 5
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8, and more above.
BANDS, ROWS = 30, 6
#: Members of a large band that the others are compared with before it is looked at again. A band of at most twice as many
#: and one is not large: all its pairs are no more than these comparisons.
STAR_ROUNDS = 8
#: Texts of a large band that are held against each other, or against as many others, in one piece of work.
BLOCK = 256
#: Roots that are broadcast.
MOST_BROADCAST = 200_000
#: Shingles whose min-hashes are taken at a time.
SHINGLES_AT_ONCE = 2048
_rng = np.random.default_rng(11)
FACTORS, TERMS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * 2 + 1, _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of a text as ascending XXH64. Words are those of simhash.fingerprint; a text of
    fewer words is one shingle, so that all texts without words are copies of each other."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if len(found) < WORDS:
        found = [b" ".join(found)]
    else:
        found = map(b" ".join, zip(*(found[k:] for k in range(WORDS)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in found), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A number for each band of min-hashes; equal numbers of two texts make them candidates."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        least = np.minimum(least, (hashes[at : at + SHINGLES_AT_ONCE, None] * FACTORS + TERMS).min(axis=0))
    data = least.astype("<u8").tobytes()
    size = 8 * ROWS
    return [xxhash.xxh64_intdigest(data[i * size : (i + 1) * size], i) - (1 << 63) for i in range(BANDS)]


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles as a signed integer: a bit is set if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        piece = hashes[at : at + SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets of shingles are near copies; in whole numbers, so that 0.8 itself counts."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * SHARED:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= (len(a) + len(b) - both) * SHARED


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("k"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "digest", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(sets, pa.binary())], names=["k", "shingles"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(n).to_pylist()] for n in ("left", "right"))
        kept = pa.array([near(a, b) for a, b in zip(left, right, strict=True)], pa.bool_())
        yield batch.select(["root_a", "root_b"]).filter(kept)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    # Few pairs are sent to the sets, so that only the sets of pairs are shuffled, by the pair; many meet them by shuffle.
    if (few := small(pairs, MOST_BROADCAST)) is not pairs:
        left = sets.join(few, sets["k"] == pairs["a"]).select(*pairs.columns, F.col("shingles").alias("left"))
        right = sets.join(F.broadcast(pairs.select("a", "b")), sets["k"] == pairs["b"]).select("a", "b", F.col("shingles").alias("right"))
        both = left.join(right, ["a", "b"])
    else:
        left = pairs.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("left")), "a")
        both = left.join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("right")), "b")
    # in slices, so that a worker never holds the sets of a whole batch twice
    return both.select("root_a", "root_b", "left", "right").mapInArrow(_near, "root_a bigint, root_b bigint")


def _renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with a column `root` by the new roots (old, new); others keep theirs. A large component's rows share a root,
    so the roots are broadcast if few, and come from files else, so that their join can be split."""
    both = rows.join(small(roots, MOST_BROADCAST), rows["root"] == roots["old"], "left")
    return both.select(*(F.coalesce("new", "root").alias("root") if c == "root" else F.col(c) for c in rows.columns))


def _composed(roots: DataFrame | None, later: list[DataFrame]) -> DataFrame | None:
    """The roots (old, new) that renaming by `roots` and then by each of `later` comes to. Only roots are renamed here, so
    that the rows under them need it once, however many rounds joined something."""
    for more in later:
        if roots is None:
            roots = more
        else:
            renamed = _renamed(roots.select(F.col("old").alias("was"), F.col("new").alias("root")), more)
            roots = renamed.select(F.col("was").alias("old"), F.col("root").alias("new")).union(more)
    return roots if roots is None else cut(roots)


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of nodes (node, fp) that SimHash finds: those of one fingerprint with its least node, and
    the least nodes of fingerprints at most 2 bits apart, by ball hashing."""
    least = cut(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(least, "fp").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    of = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"node_{side}"))
    apart = links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    pairs = cut(same.union(apart).withColumns({"root_a": F.col("a"), "root_b": F.col("b")}))
    drop(least)
    return pairs


def near_copies(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """(key, component_id): one row for each row of `docs`, whose key is a BIGINT, not null and not repeated.

    component_id is the least key that a row reaches over pairs of near copies, itself included. Texts with the
    same shingles are one node. First SimHash's ball hashing links the texts whose fingerprints are at most 2 bits apart,
    which a similarity of 0.8 alone seldom reaches; the rest are candidates that share a band. There each text is compared with one other, the best known one
    that it shares any band with, which joins most of a large group of near copies by one link for each text. Then those of
    a large band that are in several components are compared with its best known member, then with the next, and so on,
    STAR_ROUNDS at a time, as long as that joins anything. At last all pairs of texts that share a band and are still in
    different components are compared, whatever the band's size, so no pair of candidates is left out. An empty table gives no rows.
    """
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    signed = cut(texts.mapInArrow(_signed, "k bigint, digest binary, bands array<bigint>, fp bigint"))
    nodes = cut(signed.groupBy("digest").agg(F.min("k").alias("node"), F.first("fp").alias("fp")))
    every = signed.join(nodes.select(F.col("node").alias("k")), "k", "left_semi").select(F.col("k").alias("node"), F.explode("bands").alias("band"))
    several = cut(every.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("first < last").select("band", "size"))
    met = cut(every.join(small(several, MOST_BROADCAST), "band"))
    # A text that little was changed in shares its bands with the most others, so it comes first as what to compare with.
    known = met.groupBy("node").agg((-F.sum("size")).alias("place"))
    close = _close(nodes.select("node", "fp"))
    wanted = cut(met.select("node").union(close.select("a")).union(close.select("b")).distinct().withColumnRenamed("node", "k"))
    # Few texts are picked where they lie; many meet their list by shuffle, which Spark's Bloom filters keep to the picked.
    sets = cut(texts.join(small(wanted, MOST_BROADCAST), "k", "left_semi").mapInArrow(_sets, "k bigint, shingles binary"))
    begun = components(_verified(close, sets).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    found = cut(begun.where("node <> root").select(F.col("node").alias("old"), F.col("root").alias("new")))
    members = cut(_renamed(met.join(known, "node").select("band", "node", "place", "size", F.col("node").alias("root")), found))
    drop(met, several, close, wanted)
    if joined := _compared(members, sets, 0, each=False):
        found = _composed(found, joined)
    done, large = 0, _mixed(_renamed(members.where(F.col("size") > 2 * STAR_ROUNDS + 1), found))
    while not large.isEmpty() and (joined := _compared(large, sets, done)):
        now = _composed(None, joined)
        found, done = _composed(found, [now]), done + STAR_ROUNDS
        # Bands of no more members were compared throughout, and no row is renamed for them. Those that nothing was joined in
        # wait for all pairs.
        renamed = _renamed(large.where(F.col("size") > done).withColumn("before", F.col("root")), now)
        old, large = large, _mixed(renamed, "moved = 1")
        drop(old)
    left = _mixed(_renamed(members, found))
    drop(large, members)
    if joined := [r for r in _all_pairs(left, sets) if not r.isEmpty()]:
        found = _composed(found, joined)
    drop(left, sets)
    first = _renamed(nodes.select("digest", F.col("node").alias("root")), found)
    return signed.join(cut(first), "digest").select(F.col("k").alias(key), F.col("root").alias("component_id"))


def _mixed(members: DataFrame, which: str = "true") -> DataFrame:
    """The members of bands that hold several components; with a column `before` of earlier roots, `which` may ask for moved."""
    moved = F.max((F.col("root") != F.col("before")).cast("int")) if "before" in members.columns else F.lit(1)
    bands_ = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), moved.alias("moved"))
    return cut(members.drop("before").join(cut(bands_.where("low < high").where(which).select("band")), "band").select("band", "node", "place", "size", "root"))


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) of roots that join all near copies of a cell's rows (block, root, shingles, ..): of one block with itself,
    or of two with each other. What is joined already is not compared again."""
    rows = list(zip(frame["block"], frame["root"], (np.frombuffer(x, np.uint64) for x in frame["shingles"]), strict=True))
    root, links_ = {r: r for r in frame["root"]}, []

    def top(r: int) -> int:
        while root[r] != r:
            root[r] = r = root[root[r]]
        return r

    alone = frame["block"].nunique() == 1
    for i, (block, a, left) in enumerate(rows):
        for other, b, right in rows[:i]:
            if (alone or block != other) and top(a) != top(b) and near(left, right):
                links_.append((a, b))
                root[top(a)] = top(b)
    return pd.DataFrame(links_, columns=["a", "b"], dtype="int64")


def _all_pairs(members: DataFrame, sets: DataFrame) -> Iterator[DataFrame]:
    """The roots (old, new) that all pairs within the bands of members come to. Pairs of small bands are verified as rows, each
    once; large bands are cut into blocks, and a pair of blocks is a piece of work by itself, so no task holds a whole band."""
    few = F.col("size") <= 2 * STAR_ROUNDS + 1
    side = lambda n: members.where(few).select("band", F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    pairs = cut(side("a").join(side("b"), "band").where("a > b and root_a <> root_b").drop("band").distinct())
    joined = components(_verified(pairs, sets).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    roots = cut(joined.where("node <> root").select(F.col("node").alias("old"), F.col("root").alias("new")))
    drop(pairs)
    yield roots
    large = members.where(~few)
    if large.isEmpty():
        return
    large = _mixed(_renamed(large, roots))
    by_band = Window.partitionBy("band")
    placed = large.withColumns({"block": F.floor((F.row_number().over(by_band.orderBy("node")) - 1) / BLOCK), "blocks": F.ceil(F.count(F.lit(1)).over(by_band) / BLOCK)})
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cells = cells.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root").join(sets.withColumnRenamed("k", "node"), "node")
    # the rows of a cell of one block come once, those of two blocks once each
    linked = cut(cells.groupBy("band", "i", "j").applyInPandas(_linked, "a bigint, b bigint"))
    joined = components(linked)
    yield cut(joined.where("node <> root").select(F.col("node").alias("old"), F.col("root").alias("new")))
    drop(large, linked)


def _compared(members: DataFrame, sets: DataFrame, done: int, *, each: bool = True) -> list[DataFrame]:
    """The roots (old, new) that were joined, round by round, when the members (band, node, place, root) of bands were
    compared with the next STAR_ROUNDS of their best known ones, after the first `done`; without `each`, when each text was
    compared with the best known one of all its bands alone."""
    # What a band's members are compared with: its best known ones, taken before the shuffle on the bands.
    best, rounds = F.row_number().over(Window.partitionBy("band").orderBy("place", "node")), STAR_ROUNDS if each else 1
    ranked = members.select("band", "node", "place", "root", best.alias("rank")).where(F.col("rank") <= done + rounds)
    firsts = cut(ranked.where(F.col("rank") > done))
    found, left = [], members
    for at in range(rounds):
        to_come = firsts.where(F.col("rank") > done + at)
        by_band = to_come.groupBy("band").agg(F.min(F.struct("rank", "place", "node", "root")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
        # A text whose root is that of all it would still be compared with is done, as roots never part again.
        mixed = left.join(by_band, "band").where("root <> low or root <> high")
        apart, rest = mixed.where("root <> first.root"), mixed.where("node <> first.node").select(*members.columns)
        if not each:
            apart = apart.groupBy("node").agg(F.min("first").alias("first"), F.min("root").alias("root"))
        pairs = apart.select(F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("first.node").alias("b"), F.col("first.root").alias("root_b"))
        turned = F.col("a") < F.col("b")
        sides = [F.when(turned, F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("b", "a", "a"), ("a", "b", "b"), ("root_b", "root_a", "root_a"), ("root_a", "root_b", "root_b"))]
        pairs = cut(pairs.select(*sides).distinct())
        # Components are those of the roots so far, so a round's work is that of what is still apart.
        joined = components(_verified(pairs, sets).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        roots = cut(joined.where("node <> root").select(F.col("node").alias("old"), F.col("root").alias("new")))
        drop(pairs)
        settled = roots.isEmpty()
        if not settled:
            found.append(roots)
        if at + 1 == rounds:
            break
        old, left = left, cut(rest if settled else _renamed(rest, roots))
        if not settled:
            old_firsts, firsts = firsts, cut(_renamed(to_come.join(left.select("band").distinct(), "band", "left_semi"), roots))
            drop(old_firsts)
        drop(*([old] if old is not members else []))
        if left.isEmpty():
            break
    drop(*([left] if left is not members else []), firsts)
    return found
