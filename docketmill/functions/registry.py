"""Names for the package's Python functions in spark.sql()."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketmill.operators.versions import hunks, likeness
from docketmill.ship import ship
from docketmill.sources.web import quoted


def register(spark: SparkSession) -> list[str]:
    """Registers text_likeness(a, b), changed_words(a, b), decode_entities(html) and mark_quotations(html)."""
    ship(spark)

    @F.pandas_udf("double")
    def text_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("array<struct<removed: string, added: string>>")
    def changed_words(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"removed": r, "added": i} for r, i in hunks(x or "", y or "")] for x, y in zip(a, b, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def decode_entities(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else html.unescape(x))

    @F.pandas_udf("string")
    def mark_quotations(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else quoted(x))

    made = {"text_likeness": text_likeness, "changed_words": changed_words, "decode_entities": decode_entities, "mark_quotations": mark_quotations}
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
