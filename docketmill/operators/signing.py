"""Signature blocks and the state of a signing: who signs what, what is missing, who is outstanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketmill.operators import checks

FIELD = r"^\s*(Name|Title|Date|By|Signature|Witness)\s*:\s*(.*)$"
ENTITY = r"^\s*(?:SIGNED|EXECUTED|Signed|Executed)(?: as a deed)? (?:by|for and on behalf of) (.+?)[,:]?\s*$"


def signature_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, entity, fields, filled, blank): runs that begin at a line naming who signs, with the fields
    after it; one other line in between is allowed, two end the run. Runs are islands of a running count."""
    text = F.col("text")
    w = Window.partitionBy("doc_id").orderBy("idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumns({"entity": F.nullif(F.regexp_extract(text, ENTITY, 1), F.lit("")), "field": F.nullif(F.regexp_extract(text, FIELD, 1), F.lit("")), "value": F.trim(F.regexp_replace(F.regexp_extract(text, FIELD, 2), r"_+|\.{3,}", ""))})
    used = F.col("entity").isNotNull() | F.col("field").isNotNull()
    gap = F.col("idx") - F.coalesce(F.max(F.when(used, F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-9)) > 2
    runs = marked.withColumn("block", F.sum((F.col("entity").isNotNull() | (F.col("field").isNotNull() & gap)).cast("int")).over(so_far)).where(used & (F.col("block") > 0))
    has = F.col("field").isNotNull()
    grouped = runs.groupBy("doc_id", "block").agg(F.max("entity").alias("entity"), F.count(F.when(has, 1)).alias("fields"), F.count(F.when(has & (F.col("value") != ""), 1)).alias("filled"), F.count(F.when(has & (F.col("value") == ""), 1)).alias("blank"))
    return grouped.where("entity is not null")


def signature_findings(blocks: DataFrame, parties: DataFrame) -> DataFrame:
    """(doc_id, who, kind): parties (doc_id, name) without a block, blocks of nobody, half-filled blocks."""
    signing = signature_blocks(blocks)
    fits = (F.col("p.doc_id") == F.col("s.doc_id")) & (F.instr(F.lower("s.entity"), F.lower("p.name")) > 0)
    p, s = parties.alias("p"), signing.alias("s")
    having = parties.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi").alias("p")
    none = having.join(s, fits, "left_anti").select(F.col("p.doc_id").alias("doc_id"), F.col("p.name").alias("who"), F.lit("party without block").alias("kind"))
    strange = s.join(p, fits, "left_anti").select("s.doc_id", F.col("s.entity").alias("who"), F.lit("block without party").alias("kind"))
    half = signing.where("filled > 0 and blank > 0").select("doc_id", F.col("entity").alias("who"), F.lit("half filled").alias("kind"))
    return none.union(strange).union(half)


def role_drift(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, role, said, opening): a party given another role's name later: `Name (the "Role")` again."""
    pattern = checks.COMPANY + r' \(the "([^"]+)"\)'
    both = F.arrays_zip(*(checks.all_of(F.col("text"), pattern, i).alias(n) for i, n in ((1, "base"), (3, "role"))))
    every = blocks.select("doc_id", "idx", F.inline(both)).withColumn("base", F.trim("base"))
    first = every.groupBy("doc_id", "base").agg(F.min_by("role", "idx").alias("opening"))
    return every.join(first, ["doc_id", "base"]).where("role <> opening").select("doc_id", "idx", "base", F.col("role").alias("said"), "opening")


def renamed_since(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, role, was, now): roles (doc_id, role, name) that another party holds in a later version."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.doc_id") == F.col("n.doc_id")) & (F.col("o.role") == F.col("n.role")))
    return both.where("o.name <> n.name").select("o.doc_id", "o.role", F.col("o.name").alias("was"), F.col("n.name").alias("now"))


def closing(pages: DataFrame) -> DataFrame:
    """(closing_id, received, total, done, outstanding): signature pages (closing_id, signatory, document, received)."""
    return pages.groupBy("closing_id").agg(F.count(F.when(F.col("received"), 1)).alias("received"), F.count(F.lit(1)).alias("total"), F.bool_and("received").alias("done"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("received"), F.col("signatory")))), ", ").alias("outstanding"))


def state_problems(pages: DataFrame, documents: DataFrame, signatories: DataFrame, previous: DataFrame) -> DataFrame:
    """(closing_id, problem, what): pages of unknown documents or people, and pages that were received before and
    no longer are."""
    lost_doc = pages.join(documents, ["closing_id", "document"], "left_anti").select("closing_id", F.lit("unknown document").alias("problem"), F.col("document").alias("what"))
    lost_who = pages.join(signatories, ["closing_id", "signatory"], "left_anti").select("closing_id", F.lit("unknown signatory").alias("problem"), F.col("signatory").alias("what"))
    keys = ["closing_id", "signatory", "document"]
    undone = previous.where("received").select(*keys).join(pages.where("received").select(*keys), keys, "left_anti").select("closing_id", F.lit("no longer received").alias("problem"), F.concat_ws(" / ", "signatory", "document").alias("what"))
    return lost_doc.union(lost_who).union(undone).distinct()
