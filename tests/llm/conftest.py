import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Rows that every operator on documents must take: nulls, empty and long texts, ties,
# repeated rows, and columns with the names the operators use themselves.
HARD = [(1, "one two three four", "en", "a", 18, "x"), (2, None, None, None, None, None), (None, "no id at all", "en", "a", 12, "y"),
        (3, "", "en", None, 0, "z"), (4, " \t\n\r ", "de", "b", 5, "z"), (5, "word " * 60_000, "en", "b", 300_000, "z"),
        (5, "word " * 60_000, "en", "b", 300_000, "z"), (6, "É à ñ ß 漢字 🙂 \x0b\x1c", "fr", "c", 10, None),
        (7, "one two three four", "en", "a", 18, "x"), (7, "another text with id seven", "en", "a", 26, "x"), (8, "123 456 !!", "xx", "c", 10, "")]
HARD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `text.x` string"
CLASHES = ("id", "fp", "word", "row", "length", "n", "key", "k1", "gone", "source_key", "range", "h", "t", "__id", "__hash", "__text", "__s", "__salt", "__mix",
           "kept", "code", "segments", "turns", "lines", "size")


@pytest.fixture(scope="session")
def hard(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, HARD_SCHEMA)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
