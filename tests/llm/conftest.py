import pytest

#: Nulls in any column, empty and long texts, ties, repeated rows, and other columns
#: with names that the operators use themselves.
LONG = " ".join(f"w{i % 611}" for i in range(9000))
DOCS = [
    (1, "One two three four five six seven eight", "en", "a"), (2, "one TWO three four five six seven eight", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, "É one", "fr", None),
    (6, LONG, "en", "a"), (6, LONG, "en", "a"), (7, LONG + " end", "en", "b"), (None, "no id here", "en", "a"), (None, None, None, None), (8, "é one", "fr", "c"), (9, " \t\n", "en", "c"), (10, "one\x1ftwo", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ("id", "row", "key", "value", "name", "size", "fp", "at", "words", "score", "code", "label", "n", "u", "v", "block", "bytes")


@pytest.fixture(scope="session")
def messy(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(DOCS, SCHEMA)
    return docs.select("*", *[F.lit(None if i % 2 else "x").alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("1 = 0")
