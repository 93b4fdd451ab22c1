"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketmill.llm.common import cut, drop

#: Star contraction needs O(log n) rounds in practice; this only stops a run that would never end.
MOST_ROUNDS = 60


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """One contraction: every neighbour above (large) or up to (small) a node is linked to the least neighbour.

    The least neighbour is an aggregate with map-side combining and comes back by a join, so that the links of
    a node with very many neighbours are never gathered in one row, and a hot node's join can be split.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # a > b holds for every stored edge: for small stars each node looks at its smaller neighbours only, for large ones
    # the least of all neighbours goes to those above the node.
    least = (edges.union(turned) if large else edges).groupBy("a").agg(F.min("b").alias("m"))
    joined = (turned if large else edges).join(least, "a")
    if large:
        out = joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (columns a and b, any order): root is the least node it reaches.

    Loops, repeats and nulls among the edges are ignored; no edges give no rows. Each round is written to the
    shared folder, and the last but one is removed.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, old = mark, now
        now = cut(_star(_star(now, large=True), large=False))
        drop(old)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
