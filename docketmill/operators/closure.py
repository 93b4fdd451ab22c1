"""Everything that hangs together: what a person, client or matter leads to over links of many kinds.

Links are rules over tables; what they reach is a fixpoint that joins only what the last round found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketmill.functions.secure import hmac_sha256
from docketmill.tables import written

#: Objects of a kind that a round broadcasts at most.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class Link:
    """A row of `table` for which `where` holds leads from the object `source` of kind `of` to the object `target` of kind
    `to`; source, target and where are SQL over the table's columns."""

    of: str
    to: str
    table: str
    source: str
    target: str
    where: str = "true"

    def rows(self, tables: dict[str, DataFrame]) -> DataFrame:
        """(source, target), as texts."""
        text = lambda x: F.expr(x).cast("string")
        return tables[self.table].where(self.where).select(text(self.source).alias("source"), text(self.target).alias("target")).where("target is not null")


def closure(tables: dict[str, DataFrame], links: list[Link], seeds: DataFrame, *, follow: set[tuple[str, str]] | None = None) -> DataFrame:
    """(kind, id) of all that `seeds` (kind, id) reach, themselves included, each once; null ids are none.

    Each round joins the links with what the round before found and with nothing older, reads only the tables whose
    links begin at kinds that were found, and is written before the next. What was found is the side that is broadcast,
    if it is small; else the join is by shuffle and reads a table on that side, so the links of an object that has very
    many can be split. `follow` names the links to follow as (of, to); without it all are. Circles end, as what is
    known is not found again.
    """
    front = written(seeds.select("kind", F.col("id").cast("string").alias("id")).where("kind is not null and id is not null").distinct())
    found = []
    while True:
        sizes = {r.kind: r.n for r in front.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if sizes or not found:
            found.append(front)
        parts = []
        for x in links:
            if x.of in sizes and (follow is None or (x.of, x.to) in follow):
                own = front.where(F.col("kind") == x.of).select(F.col("id").alias("source"))
                own = F.broadcast(own) if sizes[x.of] <= MOST_BROADCAST else own
                parts.append(x.rows(tables).join(own, "source").select(F.lit(x.to).alias("kind"), F.col("target").alias("id")))
        if not parts:
            return reduce(DataFrame.union, found)
        front = written(reduce(DataFrame.union, parts).distinct().join(reduce(DataFrame.union, found), ["kind", "id"], "left_anti"))


def out_of_reach(tables: dict[str, DataFrame], links: list[Link], reached: DataFrame) -> DataFrame:
    """(kind, n): objects that links lead to, or from, and that were not reached."""
    ends = [x.rows(tables).select(F.lit(kind).alias("kind"), F.col(end).alias("id")) for x in links for kind, end in ((x.of, "source"), (x.to, "target"))]
    every = reduce(DataFrame.union, ends).where("id is not null").distinct()
    return every.join(reached, ["kind", "id"], "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def certificate(objects: DataFrame, key: bytes) -> DataFrame:
    """(kind, n, digest, signature): how many objects of a kind there are, a digest of their ids that is the same in any
    order (the sum of the first 60 bits of each id's SHA-256), and a signature of all three. Nothing is gathered: counts and
    sums are made where the rows are."""
    number = F.conv(F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    counted = objects.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(number).cast("string").alias("digest"))
    return counted.withColumn("signature", hmac_sha256(F.concat_ws("|", "kind", F.col("n").cast("string"), "digest"), key))
