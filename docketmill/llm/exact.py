"""Exact duplicates by progressive refinement: length, then the hash of a prefix, then the hash of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.llm.common import cut, small

#: Characters of a normalised text that the second step hashes.
PREFIX = 64
#: Bits of the filter of shared (length, prefix): 2^25 are 4 MB, in rows of 4 KB, whatever the corpus.
FILTER_BITS = 25
#: Groups, or lengths, up to which a join broadcasts them; more are joined by shuffle.
MOST_BROADCAST = 200_000


def normalised(text: Column) -> Column:
    """A text with one space for each run of ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shared(steps: DataFrame) -> DataFrame:
    """The (size, prefix) pairs of several rows, looked for only among sizes of several rows."""
    sizes = cut(steps.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size"))
    left = steps.join(small(sizes, MOST_BROADCAST), "size", "left_semi")
    return left.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "prefix")


def _place(bits: int) -> Column:
    """The place of a row's (size, prefix) in the filter, from 1."""
    return F.pmod(F.xxhash64("size", "prefix"), F.lit(1 << bits)) + 1


def _filter(pairs: DataFrame, bits: int) -> DataFrame:
    """A bitmap of the pairs, one row for each 32,768 places of which any is taken: at most 2^bits / 8 bytes in all."""
    at = pairs.select(_place(bits).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def _taken(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap is set; never null."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", every_digest: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(key, keep_key, group_size, kept, digest): one row for each row of `docs`, dropped ones too.

    Texts are equal if they are after normalised(). keep_key is the key of the row that stays, the least of its group;
    a null key is above all others, and of repeated rows with the least key one stays. digest is the SHA-256 of the
    normalised text; of a row that the first two steps tell to be alone it is null, unless `every_digest` asks for it.
    An empty table gives no rows; null texts are empty ones; other columns are not read.

    The first reading of the texts yields sixteen bytes a row: a size and the hash of a prefix. Rows alone with their
    size, then alone with size and prefix, need no more. What is left goes into a bitmap of bounded size, by which the
    second reading hashes whole texts of surviving groups alone; a row that the bitmap lets through by chance is told
    by its digest. Texts are never shuffled, and rows that are alone not even by their digest. Groups are counted
    where the rows are, and come back from a table, so that a hot group's join can be split.
    """
    t = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("k"), t.alias("t"))
    stepped = rows.withColumns({"size": F.length("t"), "prefix": F.xxhash64(F.substring("t", 1, PREFIX))})
    bitmap = _filter(_shared(cut(stepped.select("size", "prefix"))), filter_bits)
    placed = stepped.withColumn("at", _place(filter_bits)).withColumn("bucket", F.bitmap_bucket_number("at"))
    maybe = _taken(F.col("bitmap"), F.bitmap_bit_position("at"))
    digest = F.sha2("t", 256)
    seen = placed.join(F.broadcast(bitmap), "bucket", "left").select("k", maybe.alias("maybe"), (digest if every_digest else F.when(maybe, digest)).alias("digest"))
    seen = cut(seen.withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct(F.col("k").isNull().alias("unnamed"), "k", "row")
    groups = seen.where("maybe").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("least"))
    groups = cut(groups.where("n > 1").select("digest", "n", F.col("least.k").alias("keep"), F.col("least.row").alias("first")))
    met = seen.where("maybe").join(small(groups, MOST_BROADCAST), "digest", "left")
    several = F.col("n").isNotNull()
    met = met.select("k", F.when(several, F.col("keep")).otherwise(F.col("k")).alias("keep"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"), "digest")
    alone = seen.where("not maybe").select("k", F.col("k").alias("keep"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("kept"), "digest")
    return alone.union(met).toDF(key, "keep_key", "group_size", "kept", "digest")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that stay; keys have to be there and differ."""
    gone = exact_duplicates(docs, key=key, text=text).where("not kept").select(F.col(key).alias("gone"))
    return docs.join(cut(gone), docs[key] == F.col("gone"), "left_anti")
