"""The conversation that a file came from: by its name, then by how alike the texts are to the newest ones of its owner."""

from __future__ import annotations

import difflib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.functions.text import stem_of
from docketmill.tables import written

#: Newest conversations of an owner that a text is compared with, the least likeness, and the buckets of a bag of words.
NEWEST, LIKE, BUCKETS = 10, 0.8, 64


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def likeness(a: str | None, b: str | None) -> float:
    """Share of words that two texts have in common in the same order, by longest common stretches; 1 for two empty texts."""
    return difflib.SequenceMatcher(None, words(a), words(b), autojunk=False).ratio()


def bag(text: Column) -> Column:
    """How many words of a text fall in each of BUCKETS, by a hash. The sum of the lesser counts of two bags is at least the
    number of words that the texts share, so it bounds their likeness from above."""

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            counts = np.zeros(BUCKETS, np.int32)
            for w, n in Counter(words(t)).items():
                counts[zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS] += n
            out.append(counts.tolist())
        return pd.Series(out, dtype=object)

    return of(text)


def bound(a: Column, b: Column) -> Column:
    """The greatest likeness that texts of these bags can have: twice the shared words over all words."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, n: s + n)
    both = total(a) + total(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * shared / both)


def alike(a: Column, b: Column, least: float = LIKE) -> Column:
    """likeness() of two text columns; null below `least`. A bound on lengths and one on words spare most comparisons."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([(lambda r: r if r >= least else None)(likeness(s, t)) for s, t in zip(x, y, strict=True)], dtype="float64")

    return of(a, b)


def by_name(files: DataFrame, threads: DataFrame) -> DataFrame:
    """(file_id, thread_id): the newest conversation of a file's owner whose document has the same name but for version
    marks. The newest of each name is taken before the join, so a name that very many conversations share brings one row."""
    newest = threads.withColumn("stem", stem_of(F.col("filename"))).groupBy("owner", "stem").agg(F.max(F.struct("seen_at", "thread_id")).alias("n"))
    named = files.select("file_id", "owner", stem_of(F.col("filename")).alias("stem")).where("stem <> ''")
    return named.join(newest, ["owner", "stem"]).select("file_id", F.col("n.thread_id").alias("thread_id"))


def newest_of(threads: DataFrame, most: int = NEWEST) -> DataFrame:
    """The `most` newest conversations of each owner. Each task keeps so many before rows are shuffled, and so an owner of very
    many conversations brings few."""
    w = Window.partitionBy("owner").orderBy(F.desc("seen_at"), F.desc("thread_id"))
    return threads.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def candidates(files: DataFrame, threads: DataFrame, most: int = NEWEST) -> DataFrame:
    """(file_id, thread_id, how, place): by name, place 0, and for files without such a one the newest of their owner."""
    named = written(by_name(files, threads))
    rest = files.select("file_id", "owner").join(named.select("file_id"), "file_id", "left_anti")
    recent = newest_of(threads.select("owner", "thread_id", "seen_at"), most).select("owner", "thread_id", "place")
    other = rest.join(recent, "owner").select("file_id", "thread_id", F.lit("recent").alias("how"), "place")
    return named.select("file_id", "thread_id", F.lit("name").alias("how"), F.lit(0).alias("place")).union(other)


def conversations_of(files: DataFrame, threads: DataFrame, *, most: int = NEWEST, least: float = LIKE) -> DataFrame:
    """(file_id, thread_id, how, likeness): the conversation that each file (file_id, owner, filename, text) came from,
    of conversations (thread_id, owner, filename, text, seen_at); files without one have no row.

    A name decides by itself (likeness is null). Else texts are compared with those of the owner's newest conversations,
    and the newest at least `least` alike is taken. Only bags of words meet at first, of bounded size; whole texts
    follow for pairs that the bags don't rule out, which they never do to a pair that is alike enough. Null owners match nothing;
    null texts are empty; of equal ids and times the larger id is the newer.
    """
    found = written(candidates(files, threads, most))
    bags = lambda frame, key, name: frame.select(key, bag(F.col("text")).alias(name))
    recent = found.where("how = 'recent'")
    wanted = threads.join(recent.select("thread_id").distinct(), "thread_id", "left_semi")
    asked = files.join(recent.select("file_id").distinct(), "file_id", "left_semi")
    may = recent.join(bags(asked, "file_id", "a"), "file_id").join(bags(wanted, "thread_id", "b"), "thread_id").where(bound(F.col("a"), F.col("b")) >= least)
    may = written(may.select("file_id", "thread_id", "place"))
    texts = may.join(files.select("file_id", F.col("text").alias("x")), "file_id").join(threads.select("thread_id", F.col("text").alias("y")), "thread_id")
    near = texts.select("file_id", "thread_id", "place", alike(F.col("x"), F.col("y"), least).alias("likeness")).where("likeness is not null")
    best = near.groupBy("file_id").agg(F.min(F.struct("place", "thread_id", "likeness")).alias("n")).select("file_id", "n.thread_id", F.lit("text").alias("how"), "n.likeness")
    return found.where("how = 'name'").select("file_id", "thread_id", "how", F.lit(None).cast("double").alias("likeness")).union(best)
