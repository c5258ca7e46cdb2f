import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture
def documents(spark):
    """Makes a documents table of (id, text) pairs, with the usual columns and some that clash with inner names."""

    def make(rows, lang="en"):
        df = spark.createDataFrame([(i, t, lang, None, None if t is None else len(t)) for i, t in rows], DOCS)
        clash = {c: "n_chars" for c in ("key", "fp", "u", "v", "n", "score", "ids", "block", "pid", "start")}
        return df.selectExpr("*", *[f"{e} AS {c}" for c, e in clash.items()])

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty, blank, very long, repeated and tied rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two three four"), (5, "one two three four"), (6, "one two three four"), (None, "no id here"), (7, "é ü 中文 \u0085 😀 x")]
