"""Fixtures of the corpus tests; test modules import them by name."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, lang[, source]]) as documents."""
    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def texts(spark, root):
    """(doc_id, text, lang, source) of the sample documents."""
    return [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty, blank and very long texts, and repeated rows."""
    long = "alpha beta gamma delta epsilon " * 8000
    return make_docs([
        (1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (None, None), (4, long, "en", "a"), (5, long, None, "a"),
        (6, "twice the same row", "en", "b"), (6, "twice the same row", "en", "b"), (7, "x" * 30_000), (8, "é中😀 ▁ é")])


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
