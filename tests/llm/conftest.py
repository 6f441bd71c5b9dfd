import pytest
from pyspark.sql import functions as F

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "a", 44, "x"),
        (2, None, "a", None, "x"),
        (3, "", None, 0, None),
        (4, "The quick brown fox jumps over the lazy dog.", "b", 44, "x"),
        (5, LONG, "c", len(LONG), "x"),
        (5, LONG, "c", len(LONG), "x"),
        (6, "  \n \t ", "c", 6, "x"),
        (None, "no id here", "d", 10, "x"),
        (7, "one", "d", 3, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, n_lines string").withColumn("spans", F.lit("own"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
