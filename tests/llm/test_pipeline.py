"""The corpus pipeline against its stages' brute-force versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cloudsift import session
from cloudsift.llm import langid, packing, pii, quality_clf, queries
from cloudsift.session import staged

from .conftest import EDGES, table
from .test_copies import brute
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    """Each stage's decision taken again, text by text, outside of Spark (the
    trained models come from the stages' own fitting functions)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    here = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    model = quality_clf.fit(quality_clf.features(docs), quality_clf.training(labels))
    here = {i: t for i, t in here.items() if model.score(quality_clf.statistics(*one(t)))[0] >= 0.5}
    left = docs.filter(F.col("doc_id").isin(list(here)))
    f = langid.learn(langid.training(left))
    told = {i: f.judge(*one(t)) for i, t in here.items()}
    here = {i: t for i, t in here.items() if told[i][0][0] != "und" and told[i][2][0] >= cp.LEAST_LANGUAGE}
    groups = brute(here, cp.SHINGLE, cp.PERCENT)
    here = {i: t for i, t in here.items() if groups[i][1] == i}
    left = docs.filter(F.col("doc_id").isin(list(here)))
    tagger = pii.train(left)
    here = {i: pii.masked(t, every) for (i, t), (_, every) in zip(here.items(), pii.find_spans(tagger, list(here.values())))}
    lib = Tokenizer.from_file(queries.vocabulary())
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, packing.END] for i, t in here.items()}
    got = cp.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    check_packing(got, want, packing.LENGTH)


@pytest.mark.parametrize("rows", [EDGES, []])
def test_stages_keep_columns_and_handle_edges(spark, rows):
    docs = table(spark, rows) if rows else table(spark, EDGES).limit(0)
    n = len(rows)
    for i, (name, stage) in enumerate(cp.STAGES):
        out = staged(stage(spark, docs, SF), "test-stage")
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.count() <= n
            n = out.count()
        docs = out
    assert docs.count() >= n


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.language(spark, staged(cp.quality(spark, docs, SF), "test-q"), SF).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in good]) > 0.95
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.2


def test_workers_get_small_batches(spark):
    """Every stage bounds the batches of its Python workers: one ends with the
    row that passes the limit; a session's own limit stays."""
    key, rows = session._BATCH_KEY, [(i, "a b " * 125_000, "en") for i in range(40)] + [(99, "a b " * 1_500_000, "en")]
    docs = table(spark, rows).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([len(b.column(1).buffers()[2])])], names=["n", "bytes"])

    at_first = spark.conf.get(key)
    try:
        for stage in (cp.quality, cp.language, cp.near_copies, cp.personal_data, cp.pack):
            spark.conf.unset(key)
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(50), SF)
            assert spark.conf.get(key) == f"{session.BATCH_BYTES}b"
        got = docs.select("doc_id", "text").mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 41
        assert 6_000_000 <= max(r.bytes for r in got) <= session.BATCH_BYTES + 6_000_000
        assert sum(r.bytes > session.BATCH_BYTES + 500_000 for r in got) == 1       # with the long row
        spark.conf.set(key, "9000000b")
        cp._prepare(spark)
        assert spark.conf.get(key) == "9000000b"
    finally:
        spark.conf.set(key, at_first)
