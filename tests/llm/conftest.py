import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those of the operators."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30000))
    rows = [
        (1, "", "en"), (2, None, "en"), (3, "   \n\t ", None), (4, "one", "en"), (5, long, "en"), (6, long + " end", "en"), (7, "same text here now", "en"),
        (7, "same text here now", "en"), (None, "a row without an id of its own", "en"), (8, "É ß 漢字 😀 all rights reserved", "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = {n: F.lit("x") for n in ("score", "rate", "words", "removed", "keepers", "fp", "key", "root", "node", "size", "line", "para", "held_out", "predicted", "posteriors")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
