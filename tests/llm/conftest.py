from __future__ import annotations

import pytest
from pyspark.sql import types as T

from cloudsift.session import show_package

#: Columns of documents, and extra ones whose names the operators use inside.
EXTRA = ["ids", "start", "score", "key", "rep", "range", "tail", "comp", "kept", "n", "part", "at", "h", "x", "level"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA])


def table(spark, rows):
    """A documents table of (doc_id, text, lang) rows with extra columns."""
    show_package(spark)
    full = [(i, t, lang, "s", None if t is None else len(t), *["clash"] * len(EXTRA)) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


LONG = "The long text goes on, and on; it never ends. " * 4000

EDGES = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word", "de"), (5, "two words", "de"),
    (6, LONG, "en"), (7, "Σίσυφος ΑΣ İstanbul 中文字符 ﬁ é é", None), (8, "ABC abc Abc.", "en"),
    (8, "ABC abc Abc.", "en"), (None, "no id here", "en"), (9, "x" * 5000, "fr"), (10, "<|endoftext|> it's <|x", "en"),
    (-5, "negative id", "en"), (2**62, "large id", "en"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, []).filter("doc_id is not null")


@pytest.fixture(scope="session")
def tiny(spark):
    """documents of the smallest supplied table, as {doc_id: text}."""
    show_package(spark)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return {r.doc_id: r.text for r in df.collect()}
