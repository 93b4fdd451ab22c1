import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls in every column, empty and long texts, ties and repeats."""
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "the", "of", "naïve", "ß", "日本"]
    long = " ".join(rnd.choice(vocabulary) for _ in range(30_000))
    rows = [
        (1, "One two three four five six seven eight nine ten", "en", "a", 48),
        (2, "One two three four five six seven eight nine ten", "en", "a", 48),
        (2, "One two three four five six seven eight nine ten", "en", "a", 48),
        (3, "", "en", "a", 0),
        (4, None, "de", None, None),
        (None, "key is null here", None, "b", 1),
        (5, " \t\n ", None, None, 4),
        (6, long, "en", "b", len(long)),
        (7, long + " tail", "en", "b", 0),
        (8, "x\ny\nx\n\n \nx y", "fr", "a", 1),
        (9, "12345 ---   \U0001f600 end", "fr", "a", 1),
        (10, "one", "es", "c", 3),
    ]
    rows += [(100 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 200))), rnd.choice(["en", "de"]), "a", 1) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns, named as columns that operators make."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("other") for c in ("fp", "k", "score", "n", "root", "sequence_id", "kept", "spans", "ids", "digest", "item_id")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
