"""A training corpus from raw documents: five stages, each over all that the one before kept.

STAGES: (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again before the next. All but the last return the columns of documents, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketmill.llm import decontaminate, near_copies, packing, secrets, toxicity
from docketmill.llm.common import cut, cut_alone, drop, small, table
from docketmill.llm.queries import tokenizer_file



def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with numbers of their own, as ids may be null or repeat, and the numbers' column, which is none of
    theirs. Written once, so that no later read can number them otherwise."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for i in range(len(taken) + 1) if (n := f"row_number_{i}") not in taken)
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network predicts to be toxic go."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.keep_clean(docs, labels)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a Jaccard similarity of 0.8 or more of five-word shingles), the document with the
    least id stays, and of several such rows the first. SimHash's ball hashing finds the closest of them, by fingerprints of
    these shingles and not of op3_simhash's; min-hash bands find those that lie more bits apart."""
    rows, own = _numbered(docs)
    found = near_copies.near_copies(rows.select(own, "text"), key=own).withColumnRenamed(own, "n")
    ids = rows.select(F.col(own).alias("n"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(own).alias("n")).alias("rank"))
    kept = ids.join(found, "n").groupBy("component_id").agg(F.min("rank").alias("least")).select(F.col("least.n").alias("n"))
    gone = cut(ids.select("n").join(kept, "n", "left_anti").withColumnRenamed("n", own))
    return rows.join(small(gone, near_copies.MOST_BROADCAST), own, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; n_chars follows the text."""
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into training sequences."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("simhash", keep_one_of_each), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]
#: Trained networks and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table. What a stage wrote goes when the next one's result is written, so at
    most two copies of the corpus lie in the shared folder at a time, and none after the last stage but the packed ids."""
    docs, before = table(spark, sf_dir, "documents", "*"), []
    for _, stage in STAGES[:-1]:
        docs = cut_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), *before)
        before = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads nothing but what it has written itself
    drop(docs)
    return packed
