"""Structure of documents: lines, clause numbers, labels, and what numbers and schedules there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.functions.text import all_of

NUMBER, SCHEDULE, POINTER = r"^(\d+)\.\s", r"^(Schedule \d+)\b", r"\b(Section|Clause|Article) (\d+)"


def order():
    return Window.partitionBy("doc_id").orderBy("idx")


def so_far():
    return order().rowsBetween(Window.unboundedPreceding, 0)


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, text): the lines of texts. Line ends of all kinds count; an empty last line is none."""
    # texts are cut at one plain character, which is fast, in a column of its own, so that each is cut once
    plain = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r\n|\r", "\n")).otherwise(F.col("text"))
    cut = docs.select("doc_id", F.split(plain, "\n", -1).alias("__lines"))
    lines = F.when(F.element_at("__lines", -1) == "", F.slice("__lines", F.lit(1), F.size("__lines") - 1)).otherwise(F.col("__lines"))
    return cut.select("doc_id", F.posexplode(lines).alias("idx", "text"))


def clause_number(text: str = "text") -> Column:
    return _or_null(F.regexp_extract(text, NUMBER, 1)).try_cast("int")


def schedule_title(text: str = "text") -> Column:
    return _or_null(F.regexp_extract(text, SCHEDULE, 1))


def with_clauses(blocks: DataFrame) -> DataFrame:
    """blocks with `number`, what a line begins with, `clause`, the top-level number in force, and `part`, the schedule that a line lies in (null in
    the body). A schedule begins the numbers anew."""
    parted = blocks.withColumn("number", clause_number()).withColumn("part", F.last(schedule_title(), ignorenulls=True).over(so_far()))
    inside = Window.partitionBy("doc_id", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return parted.withColumn("clause", F.last("number", ignorenulls=True).over(inside))


def numbered(blocks: DataFrame) -> DataFrame:
    """The lines that begin a clause, with their part: only they and the titles of schedules are looked at."""
    heads = blocks.where(clause_number().isNotNull() | schedule_title().isNotNull())
    return with_clauses(heads).where("number is not null")


def labels(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, label): where a line is, as a reader would say it."""
    return _labelled(blocks).select("doc_id", "idx", "label")


def _labelled(blocks: DataFrame) -> DataFrame:
    c = with_clauses(blocks)
    number = F.when(F.col("clause").isNotNull(), F.concat(F.when(F.col("part").isNull(), "clause ").otherwise("paragraph "), F.col("clause").cast("string")))
    return c.select("doc_id", "idx", "text", F.coalesce(F.nullif(F.concat_ws(", ", "part", number), F.lit("")), F.lit("opening")).alias("label"))


def places(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, place): the clause that a line begins, or the one that it stands under."""
    c = with_clauses(blocks)
    return c.select("doc_id", "idx", F.when(F.col("number") == F.col("clause"), F.concat(F.lit("clause "), F.col("clause").cast("string"))).when(F.col("clause").isNotNull(), F.concat(F.lit("under clause "), F.col("clause").cast("string"))).alias("place"))


def numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, part, number): the top-level numbers that are there."""
    return numbered(blocks).select("doc_id", "part", "number").distinct()


def schedules(blocks: DataFrame) -> DataFrame:
    return blocks.where(schedule_title().isNotNull()).select("doc_id", schedule_title().alias("title")).distinct()


def pointers(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, at, word, number): references to clauses, in order."""
    both = F.arrays_zip(all_of(F.col("text"), POINTER, 1).alias("word"), all_of(F.col("text"), POINTER, 2).alias("number"))
    each = blocks.select("doc_id", "idx", F.posexplode(both).alias("at", "x"))
    return each.select("doc_id", "idx", "at", "x.word", F.col("x.number").try_cast("int").alias("number"))


def clause_word(blocks: DataFrame) -> DataFrame:
    """(doc_id, word): what a document calls its clauses most often; of equals the one seen first."""
    counted = pointers(blocks).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("idx", "at")).alias("first"))
    return counted.groupBy("doc_id").agg(F.max_by("word", F.struct("n", -F.col("first.idx"), -F.col("first.at"))).alias("word"))


def budgeted(blocks: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, cut_at): lines joined while they fit a budget of characters; cut_at is the first left out."""
    run = blocks.withColumn("upto", F.sum(F.length("text") + 1).over(so_far()))
    kept = F.col("upto") <= most
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("idx", "text")))), lambda x: x["text"]), "\n")
    return run.groupBy("doc_id").agg(text.alias("text"), F.min(F.when(~kept, F.col("idx"))).alias("cut_at"))


def first_place(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, anchor, label): the label of the first line that holds an anchor; joined on the document."""
    met = _labelled(blocks).join(anchors.select("doc_id", "anchor"), "doc_id").where(F.instr(F.col("text"), F.col("anchor")) > 0)
    return met.groupBy("doc_id", "anchor").agg(F.min_by("label", "idx").alias("label"))


def renumbered(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, old, new): top-level numbers of the body, counted anew in the order they stand."""
    return numbered(blocks).where("part is null").select("doc_id", "idx", F.col("number").alias("old"), F.row_number().over(order()).alias("new"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, idx, text): hard-wrapped lines rejoined. A paragraph begins after an empty line, at a number or
    schedule title, or after a line that ends a sentence."""
    before = F.lag("text").over(order())
    begins = before.isNull() | (F.trim(before) == "") | clause_number().isNotNull() | schedule_title().isNotNull() | before.rlike(r"[.:;]\s*$")
    grouped = lines.withColumn("run", F.sum(begins.cast("int")).over(so_far())).where(F.trim("text") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.trim(x["text"])), " ")
    return grouped.groupBy("doc_id", "run").agg(F.min("idx").alias("idx"), text.alias("text")).drop("run")
