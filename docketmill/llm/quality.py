"""Quality rules whose thresholds adapt to each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.llm.common import cut, slices, small

SYMBOLS = "#*$%&|<>"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8
#: Relative width of a sketch's bins: a quantile is right to about 1 %.
GAMMA = 1.02
#: The rates that get thresholds, and the least spread that counts: below it, differences mean nothing.
RATES = {"word_length": 1.0, "symbol_rate": 0.1, "dup_line_rate": 0.1, "repeat_rate": 0.1}
FENCE = 4.0
LEAST_GROUP = 100
MOST_GROUPS = 50_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` (a power of two) words that stand twice or more in the text, the first included.

    Windows get exact ids by doubling: the id of 2k words is the rank of the pair of ids of its halves.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    step, counts = 1, None
    while step < window:
        key = rank[:-step] * np.int64(n) + rank[step:]
        found, rank, counts = np.unique(key, return_inverse=True, return_counts=True)
        if len(found) == len(key):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[rank] > 1)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return int((np.cumsum(edge) > 0).sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").split()
            found.append((len(words), repeated_words(words)))
        counts = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 2
        kept = ["doc_id", "lang", "source", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *counts], names=[*kept, "n_words", "n_repeat_words"])


def counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, word_chars, n_symbols, n_lines, n_dup_lines, n_words, n_repeat_words) of each row.

    Everything but the repeated windows is counted by built-in functions. A null text has no words.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    frame = docs.select(
        F.col(key).alias("doc_id"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        F.length(F.translate(whole, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.col(text).alias("text"),
    )
    fields = ", ".join(f"{c} {dict(frame.dtypes)[c]}" for c in frame.columns if c != "text")
    return frame.mapInArrow(_count, f"{fields}, n_words bigint, n_repeat_words bigint")


def rates() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return {"word_length": per_word("word_chars"), "symbol_rate": per_word("n_symbols"), "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeat_rate": per_word("n_repeat_words")}


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): a quantile sketch of each rate of each group, as rows.

    Bins grow by GAMMA, bin 0 holds zero. Sketches merge by adding n, so partial sketches are made map-side and
    coarser groups come from finer ones without reading the documents again. A group has at most a few hundred
    bins however many documents it has.
    """
    pairs = F.array(*(F.struct(F.lit(name).alias("rate"), value.alias("x")) for name, value in rates().items()))
    each = counted.select("lang", "source", F.inline(pairs))
    at = F.when(F.col("x") <= 1e-4, 0).otherwise(F.ceil(F.log("x") / np.log(GAMMA)) + 1_000)
    return each.groupBy("lang", "source", "rate", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketched: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(*keys, rate, n, q0, q1, ...): quantiles of merged sketches, each a bin's middle."""
    merged = sketched.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")
    run = merged.select(*keys, "rate", "bin", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("all"))
    middle = F.when(F.col("bin") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") - 1_000.5))
    return run.groupBy(*keys, "rate").agg(F.max("all").alias("n"), *(F.min(F.when(F.col("upto") >= F.col("all") * q, middle)).alias(f"q{i}") for i, q in enumerate(at)))


def thresholds(sketched: DataFrame) -> DataFrame:
    """(lang, source, and low_ and high_ of each rate): fences around the middle half of the group.

    A group of fewer than LEAST_GROUP documents takes the fences of its language, and a language of fewer those
    of the whole corpus, by merged sketches.
    """
    at = [0.25, 0.75]
    spread = lambda d: F.greatest(F.col("q1") - F.col("q0"), d)
    least = F.coalesce(*(F.when(F.col("rate") == r, F.lit(s)) for r, s in RATES.items()))

    def fences(keys: list[str]) -> DataFrame:
        found = quantiles(sketched, keys, at).withColumn("s", spread(least))
        made = [F.max(F.when(F.col("rate") == r, v)).alias(f"{side}_{r}") for r in RATES for side, v in (("low", F.col("q0") - FENCE * F.col("s")), ("high", F.col("q1") + FENCE * F.col("s")))]
        return found.groupBy(*keys).agg(F.max("n").alias("n"), F.struct(*made).alias("f"))

    own, by_lang, every = fences(["lang", "source"]), fences(["lang"]), fences([])
    joined = own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang"))).select("o.lang", "o.source", F.when(F.col("o.n") >= LEAST_GROUP, F.col("o.f")).when(F.col("l.n") >= LEAST_GROUP, F.col("l.f")).alias("f"))
    whole = every.select("f").scalar()
    return joined.select("lang", "source", F.coalesce("f", whole).alias("f")).select("lang", "source", "f.*")


def verdicts(docs: DataFrame, **columns: str) -> DataFrame:
    """One row for each row of `docs`: its counts, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and
    every rate inside the fences that its language and source have in this corpus. Null languages and sources
    are groups of their own; an empty table gives an empty result.
    """
    counted = cut(counts(docs, **columns))
    fences = cut(thresholds(sketch(counted)))
    inside = F.lit(True)
    for name, value in rates().items():
        inside = inside & value.between(F.col(f"low_{name}"), F.col(f"high_{name}"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fences = small(fences.withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), MOST_GROUPS)
    both = counted.join(fences, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return both.select("doc_id", *out, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"), "n_lines")
