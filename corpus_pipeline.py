"""The corpus pipeline: quality, language, near copies, personal data, packing.

Each stage is a function (spark, docs, sf_dir) and works on all documents its
predecessor kept; its result is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of ``documents``. Models
are learned from the documents that reach the stage (and ``labels``).

Rows, in every stage: null and empty texts are legal (an empty text has no
language, so the second stage drops it); extra columns stay until packing;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm import langid, neardup, packing, pii, quality_clf
from cloudsift.llm.queries import vocabulary
from cloudsift.session import bound_batches, show_package, staged

#: Near copies: runs of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: A document of whose n-grams the best language holds a smaller share has no
#: language (known ones hold over half, however many languages there are).
LEAST_LANGUAGE = 0.2


def _prepare(spark: SparkSession) -> None:
    """What every stage needs: executors keep the heap that earlier stages
    filled, so that its Python workers get their rows in small batches."""
    show_package(spark)
    bound_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier scores below 0.5."""
    _prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_clf.fit(quality_clf.features(docs), quality_clf.training(labels))
    return quality_clf.select_good(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a language."""
    _prepare(spark)
    return langid.select_known(docs, langid.learn(langid.training(docs)), LEAST_LANGUAGE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of copies."""
    _prepare(spark)
    return neardup.deduplicate(docs, SHINGLE, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    _prepare(spark)
    return pii.redact(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with the ids of each piece."""
    _prepare(spark)
    pieces = packing.pack(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("near_duplicates", near_copies),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Trained stages and the tokenizer have no SQL form; tests compare run() with
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
