import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    long = "alpha beta gamma delta " * 5000
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (3, "two words", "b"), (None, "no id", "b"),
        (None, None, None), (4, long, "a"), (5, " \n\t ", "b"), (6, "one", "b"), (-7, "É ▁ 漢字 👍🏽\x00 <s>", "b"),
    ]
    return make_docs(rows)


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
