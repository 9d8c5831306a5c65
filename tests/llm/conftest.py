import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (id, text) pairs, in several partitions."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def small_documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def clashing(df):
    """Extra columns with names that operators use themselves."""
    names = ["ids", "part", "n", "score", "label", "kept", "host", "place", "block", "token", "n_lines", "base_failed", "_words", "_rest", "_starts", "_kept", "_doc_key", "_of", "_rows", "_key", "_url", "_day"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})
