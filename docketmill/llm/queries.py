"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketmill.llm import centroids, decontaminate, exact, language, licenses, lm, packing, passages, quality, secrets, simhash, toxicity, wand
from docketmill.llm.common import documents, table
from docketmill.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contamination(documents(spark, sf_dir, "doc_id", "text"), items)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir, "doc_id", "text")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file())


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir, "doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in a folder for their source, language and thousand of ids."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.withColumn("path", path))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir, "doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.score(documents(spark, sf_dir, "doc_id", "text"), labels)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(*centroids.clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return wand.ranked(documents(spark, sf_dir, "doc_id", "text"), items)


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(documents(spark, sf_dir, "doc_id", "text"), every_digest=True)
    return found.select("doc_id", F.col("keep_key").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_secrets, op3_simhash, op4_packing, op5_passages, op6_language, op7_licenses, op8_quality, op9_lm, op10_toxicity, op11_centroids, op12_search, op13_exact)}
