"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.llm.common import cut
from docketmill.llm.components import components

#: Shingles whose bits are counted at a time: bounds the memory that one long text needs.
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text as a signed integer; a text without words has 0.

    A-Z is lower-cased, words are runs of anything but ASCII white space, shingles keep their repeats; a text
    of fewer words is one shingle. A bit is set if it is set in over half of the shingles' XXH64 (seed 42).
    """
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return 0
    if len(found) < words:
        found, shingled = [b" ".join(found)], False
    else:
        shingled = words > 1
    total, ones = len(found) - (words - 1) * shingled, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SHINGLES_AT_ONCE):
        piece = found[at : min(at + SHINGLES_AT_ONCE, total) + (words - 1) * shingled]
        shingles = map(b" ".join, zip(*(piece[k:] for k in range(words)), strict=False)) if shingled else piece
        hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """fingerprint() of a text column as a BIGINT, one Arrow batch at a time."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links that connect all fingerprints `fp` within `radius` (2 or 4) of each other.

    Two fingerprints within the radius meet in a variant at most half of it from each: every fingerprint emits
    its whole ball of half the radius and the shuffle is on the variants. Fingerprints are distinct, so a
    variant gathers no more of them than a ball has members, whatever the data. Each is linked to the least of
    its variant instead of to all others; the links are deduplicated and their distance is verified.
    """
    flips = [0, *(1 << i for i in range(64))]
    if radius == 4:
        flips += [1 << i | 1 << j for i in range(64) for j in range(i)]
    elif radius != 2:
        raise ValueError("radius is 2 or 4")
    flips = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    # Balls are 65 times what they are made of and more: dealt out first, or a few tasks would make them all.
    session = distinct.sparkSession
    dealt = distinct.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), "fp")
    balls = dealt.select("fp", F.explode(F.transform(F.lit(flips), lambda f: F.col("fp").bitwiseXOR(f))).alias("v"))
    met = balls.select("fp", F.min("fp").over(Window.partitionBy("v")).alias("b"))
    pairs = met.where("b < fp").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): one row for each row of `docs`.

    component_id is the least key that a document reaches over fingerprints at most `radius` bits apart, itself
    included. Null and empty texts have fingerprint 0 and are linked like any other. Copies share a fingerprint
    and are one node, so a group of copies costs one row after the first, map-side combined aggregation. A null
    key is kept as a row and never chosen as an id unless its whole group has null keys. An empty table gives
    an empty result.
    """
    hashed = cut(docs.select(F.col(key).alias("k"), fingerprints(F.col(text), words).alias("fp")))
    nodes = hashed.groupBy("fp").agg(F.min("k").alias("first"))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return hashed.join(by_fp, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
