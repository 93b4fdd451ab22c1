"""Amounts, table totals and sums that a document states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.functions.text import all_of

MONEY = r"(USD|GBP|EUR|US\$|£|€|\$)\s?([0-9][0-9,]*(?:\.[0-9]+)?)(?: ?(thousand|million|billion|k|m|bn)\b)?"
PERCENT = r"([0-9]+(?:\.[0-9]+)?) ?(?:%|per cent)"
CURRENCY = {"USD": "USD", "US$": "USD", "$": "USD", "GBP": "GBP", "£": "GBP", "EUR": "EUR", "€": "EUR"}
SCALE = {"thousand": 1_000, "k": 1_000, "million": 1_000_000, "m": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000}
VALUE = "decimal(18,2)"


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def amounts(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, at, kind, currency, value): money with its scale, and percentages."""
    # both are looked for in one pass, in lines that hold what they can't do without; rows of a document stay together
    text = F.col("text")
    signs, percents = text.rlike("USD|GBP|EUR|[$£€]"), F.contains("text", F.lit("%")) | F.contains("text", F.lit("per cent"))
    none = F.array().cast("array<struct<at:int,kind:string,c:string,n:string,s:string>>")
    row = lambda at, kind, c, n, s: F.struct(at.alias("at"), F.lit(kind).alias("kind"), c.alias("c"), n.alias("n"), s.alias("s"))
    groups = F.arrays_zip(*(all_of(text, MONEY, i).alias(n) for i, n in ((1, "c"), (2, "n"), (3, "s"))))
    money = F.when(signs, F.transform(groups, lambda x, i: row(i, "money", x["c"], x["n"], x["s"]))).otherwise(none)
    empty = F.lit(None).cast("string")
    percent = F.when(percents, F.transform(all_of(text, PERCENT, 1), lambda x, i: row(i, "percent", empty, x, empty))).otherwise(none)
    each = blocks.where(signs | percents).select("doc_id", "idx", F.inline(F.concat(money, percent)))
    scale = F.coalesce(F.try_element_at(_map(SCALE), F.col("s")), F.lit(1))
    value = F.when(F.col("kind") == "percent", F.col("n").try_cast(VALUE)).otherwise((F.replace("n", F.lit(","), F.lit("")).try_cast(VALUE) * scale).try_cast(VALUE))
    found = each.select("doc_id", "idx", "at", "kind", F.try_element_at(_map(CURRENCY), F.col("c")).alias("currency"), value.alias("value"))
    return found.where("value is not null")  # a number beyond sixteen digits is no amount


def cell_value(text: Column) -> Column:
    """The number in a cell: brackets or a minus sign make it negative, currency signs and commas go; else null."""
    bare = F.regexp_replace(text, r"[,\s$£€]|USD|GBP|EUR", "")
    inner = F.regexp_extract(bare, r"^\(?(-?[0-9]+(?:\.[0-9]+)?)\)?%?$", 1)
    return F.when(inner != "", F.when(bare.startswith("("), -inner.try_cast(VALUE)).otherwise(inner.try_cast(VALUE)).cast(VALUE))


def column_sums(cells: DataFrame, total: str = "Total") -> DataFrame:
    """(doc_id, items, summed, stated): the rows of each table against the row that says their total."""
    is_total = F.col("label") == total
    sums = cells.groupBy("doc_id").agg(F.count(F.when(~is_total, 1)).alias("items"), F.sum(F.when(~is_total, F.col("amount"))).cast(VALUE).alias("summed"), F.max(F.when(is_total, F.col("amount"))).alias("stated"))
    return sums.where("stated is not null and items >= 2")


def wrong_totals(cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Totals that are not the sum; each row may be rounded by `tolerance`."""
    off = (F.col("stated") - F.col("summed")).cast(VALUE)
    return column_sums(cells).withColumn("off", off).where(F.abs(F.col("off")) > F.col("items") * tolerance + 1e-9)


def grid(cells: DataFrame, rows: list[int]) -> DataFrame:
    """Cells of numbered rows as columns; of several cells for one place, the largest."""
    return cells.groupBy("doc_id").pivot("row_no", rows).agg(F.max("amount")).select("doc_id", *(F.col(str(r)).alias(f"row_{r}") for r in rows))


def restated(blocks: DataFrame) -> DataFrame:
    """(doc_id, currency, values): currencies in which a document states several different amounts."""
    each = amounts(blocks).where("kind = 'money'").groupBy("doc_id", "currency").agg(F.array_sort(F.collect_set("value")).alias("all")).where(F.size("all") > 1)
    return each.select("doc_id", "currency", F.array_join(F.transform("all", lambda v: v.cast("string")), ", ").alias("values"))


def splits(items: DataFrame, lead: str = "lead") -> DataFrame:
    """(doc_id, at, expected, items, summed): a lead-in that states a sum, and the run of items after it.

    items: (doc_id, idx, kind, value); a run ends at the next lead-in. Only sums that differ come back.
    """
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    runs = items.withColumn("run", F.sum((F.col("kind") == lead).cast("int")).over(w)).where("run > 0")
    is_lead = F.col("kind") == lead
    sums = runs.groupBy("doc_id", "run").agg(F.min(F.when(is_lead, F.col("idx"))).alias("at"), F.max(F.when(is_lead, F.col("value"))).alias("expected"), F.count(F.when(~is_lead, 1)).alias("items"), F.sum(F.when(~is_lead, F.col("value"))).cast(VALUE).alias("summed"))
    return sums.where("items >= 2 and expected <> summed").drop("run")


def shown(value: Column, currency: Column) -> Column:
    """An amount with its currency and thousands apart."""
    return F.concat_ws(" ", currency, F.format_number(value, 2))


def nested(amounts: DataFrame, sums: DataFrame) -> DataFrame:
    """(doc_id, amounts, table): one row for each document that has amounts or a table with a total, the amounts (idx, at,
    kind, currency, value) in the order of the text, the table (items, summed, stated, off), null without one."""
    row = F.struct("idx", "at", "kind", "currency", "value")
    lists = amounts.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("amounts"))
    table = sums.select("doc_id", F.struct("items", "summed", "stated", (F.col("stated") - F.col("summed")).cast(VALUE).alias("off")).alias("table"))
    both = lists.join(table, "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("amounts", F.array().cast(dict(lists.dtypes)["amounts"])).alias("amounts"), "table")
