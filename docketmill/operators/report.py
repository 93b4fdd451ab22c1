"""Reports from findings and changes: what to fix, what to ask, what was done, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections of a report in the order they stand, with the severities that go there.
SECTIONS = {1: "Before signing", 2: "To decide", 3: "Tidied up"}
COSMETIC = ["date style", "double space", "space before mark", "no space after comma", "currency notation"]


def sane(anchor: Column, replacement: Column) -> Column:
    """Whether a replacement is of a sensible size beside what it replaces."""
    return (F.length(replacement) <= F.greatest(F.lit(200), 5 * F.length(anchor))) & (anchor != replacement)


def partitioned(findings: DataFrame) -> DataFrame:
    """findings with `automatic`: minor ones whose note can stand for the anchor are written without asking."""
    return findings.withColumn("automatic", (F.col("severity") == 3) & sane(F.col("anchor"), F.col("note")) & (F.col("anchor") != ""))


def without_cosmetics(findings: DataFrame) -> DataFrame:
    """(doc_id, shown, withheld): how many findings are shown on somebody else's paper, and how many are not."""
    cosmetic = F.col("kind").isin(COSMETIC)
    return findings.groupBy("doc_id").agg(F.count(F.when(~cosmetic, 1)).alias("shown"), F.count(F.when(cosmetic, 1)).alias("withheld"))


def applied_items(findings: DataFrame, few: int = 3) -> DataFrame:
    """(doc_id, item): single edits while they are few in a document, else one line for each kind."""
    sized = findings.withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    one = sized.where(F.col("all") <= few).select("doc_id", F.concat_ws(": ", "kind", "anchor").alias("item"))
    many = sized.where(F.col("all") > few).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.concat_ws(" ", F.col("n").cast("string"), F.lit("x"), "kind").alias("item"))
    return one.union(many)


def composed(findings: DataFrame) -> DataFrame:
    """(doc_id, report): sections in order, each with its findings in the order of the text."""
    title = F.coalesce(*(F.when(F.col("severity") == s, F.lit(t)) for s, t in SECTIONS.items()))
    line = F.concat(F.lit("- "), F.concat_ws(": ", "kind", "anchor"), F.lit(" ("), "note", F.lit(")"))
    parts = findings.groupBy("doc_id", "severity").agg(F.first(title).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "kind", "anchor", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", F.concat_ws("\n", "title", "body").alias("t")))), lambda x: x["t"]), "\n\n").alias("report"))


def issues(findings: DataFrame) -> DataFrame:
    """(doc_id, place, kind, anchor, note): one numbered row for each point of substance."""
    w = Window.partitionBy("doc_id").orderBy("severity", "idx", "kind", "anchor")
    return findings.where("severity < 3").select("doc_id", F.row_number().over(w).alias("place"), "kind", "anchor", "note")


def examples(findings: DataFrame, most: int = 2) -> DataFrame:
    """The first few points of each document that can be answered, worst first."""
    return issues(findings).where(F.col("place") <= most).select("doc_id", "place", "anchor")


def change_summary(changes: DataFrame) -> DataFrame:
    """(doc_id, clause, inserted, deleted, replaced, moved): counts by clause, and of each document under null."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    counted = changes.rollup("doc_id", "clause").agg(F.grouping_id().alias("g"), n("inserted"), n("deleted"), n("replaced"), n("moved"))
    return counted.where("g < 3").select("doc_id", "clause", F.col("g").cast("int").alias("level"), "inserted", "deleted", "replaced", "moved")


def overdue_notice(jobs: DataFrame, allowed: int) -> DataFrame:
    """(job_id, notice): a line for jobs that took longer than the seconds allowed, in whole minutes."""
    took = F.unix_timestamp("last_at") - F.unix_timestamp("received_at")
    return jobs.where(took > allowed).select("job_id", F.concat(F.lit("This is taking longer than usual: "), F.ceil(took / 60).cast("string"), F.lit(" minutes so far.")).alias("notice"))


def as_csv_rows(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Rows ready for a CSV sink: the named lists joined by semicolons, everything else as text."""
    return rows.select(*((F.array_join(c, "; ") if c in lists else F.col(c).cast("string")).alias(c) for c in rows.columns))


def contact_card(people: DataFrame) -> DataFrame:
    """(address, card): vCards of (name, address)."""
    escaped = lambda c: F.regexp_replace(c, r"([,;\\])", r"\\$1")
    lines = [F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), escaped("name")), F.concat(F.lit("EMAIL;TYPE=INTERNET:"), "address"), F.lit("END:VCARD"), F.lit("")]
    return people.select("address", F.concat_ws("\r\n", *lines).alias("card"))
