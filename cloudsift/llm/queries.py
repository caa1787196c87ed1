"""The registered queries of the llm operators, opN_<name>, and their DuckDB
SQL where SQL can express the result. A query applies its operator to its
whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm import (bpe, fingerprints, langid, lm, neardup, packing, pii, quality_clf, quality_rules, repeats, spelling, sql,
                           token_counts, whitening)
from cloudsift.session import show_package


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    show_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _in_fold(modulus: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_documents(spark, sf_dir), vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document: 20 code points go at a quarter of it,
    its first 12 come in at the middle, its last 10 turn to capitals."""
    import public_tokenizers
    docs = _documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    quarter = (n / 4).cast("int")
    gone = F.least(F.lit(20), n - quarter)
    left = n - gone
    head = F.substring(text, 1, 12)
    grown = left + F.length(head)
    tail = F.greatest(F.lit(0), grown - 10)
    edit = lambda a, b, s: F.struct(a.alias("start"), b.alias("end"), s.alias("new"))
    middle = (left / 2).cast("int")
    edits = F.array(edit(quarter, quarter + gone, F.lit("")), edit(middle, middle, head), edit(tail, grown, F.upper(F.substring(text, -10, 10))))
    counted = token_counts.count_edits(docs, vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN, edits)
    return counted.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii.find(docs, pii.train(docs))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    told = langid.predict(docs, langid.learn(langid.training(docs)))
    return told.select("doc_id", _in_fold(5, 0).alias("held_out"), "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), vocabulary())


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir), vocabulary())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_clf.score(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return scored.select("doc_id", _in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    show_package(spark)
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_documents(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_personal_data": op3_personal_data,
    "op4_fingerprints": op4_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_lm_scores": op8_lm_scores,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE: dict[str, str] = {
    "op7_near_duplicates": sql.near_duplicates(),
    "op9_quality_rules": sql.quality_rules(),
    "op13_substring_dedup": sql.substring_dedup(),
}
