"""10. Quality classifier: regularised quadratic discriminant.

Each text gives a vector of transformed statistics (``STATS``). Per label the
mean and covariance come from sums over all labelled training rows; Spark adds
them up, the driver gets one row per label and matrix entry. Covariances are
shrunk towards the pooled one and a scaled identity, so they stay invertible
whatever the labels are. The Cholesky factors are cached in the model; a
score is the logistic value of the difference of the log densities
(Mahalanobis distances and log determinants).

Only the text is an input of a score. Rows: null text is the empty text (it
has a score too); repeated rows score alike; labels that are null, and label
rows without a document, are left out; a document with several label rows
counts once for each. With fewer than two labels in the training rows there
is no difference to take: all scores are 0.5.

An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text
from cloudsift.llm.quality_rules import Judged
from cloudsift.session import staged

#: Names of the statistics, in the order of the vector.
STATS = [
    "log_words", "word_length", "symbols", "upper", "digits", "exclamation", "commas_stops", "wide",
    "repeat_words", "dup_lines", "distinct_words", "top_word", "words_per_line", "bad_lines", "long_words", "stutter",
]
SHRINK_POOLED, SHRINK_IDENTITY = 0.3, 0.05
SMOOTH = 1.0


def statistics(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Transformed statistics (rows x STATS) of a chunk of texts."""
    g, n = Judged(b, offs), len(offs) - 1
    w = g.w
    nw = np.maximum(w.count, 1)
    part = lambda flags: _share(flags, offs)
    size = w.end - w.start
    lines = np.maximum(np.bincount(g.row, minlength=n), 1)
    o = np.lexsort((w.hash, w.row))
    new = np.ones(len(o), bool)
    new[1:] = (w.hash[o[1:]] != w.hash[o[:-1]]) | (w.row[o[1:]] != w.row[o[:-1]])
    begin = np.flatnonzero(new)
    often = np.diff(np.append(begin, len(o)))
    kinds = np.bincount(w.row[o[begin]], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, w.row[o[begin]], often)
    few = lambda x, of: np.log((x + SMOOTH) / (of + 10 * SMOOTH))  # noqa: E731  short texts prove little
    rare = lambda x: np.log(x + 1e-3)
    stutter = np.zeros(n, np.int64)
    if len(w.hash) > 1:
        twice = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        stutter = np.bincount(w.row[1:][twice], minlength=n)
    marred = g.punctuation | g.navigation
    lost = np.bincount(g.row[marred], weights=g.words[marred], minlength=n)
    out = np.stack([
        np.log1p(w.count),
        np.log(np.maximum(g.word_chars, 1) / nw),
        few(g.symbols, w.count),
        rare(part((b >= 65) & (b <= 90))),
        rare(part((b >= 48) & (b <= 57))),
        rare(part(b == 0x21)),
        np.sqrt(part((b == 0x2C) | (b == 0x2E))),
        rare(part((b & 0xC0) == 0xC0)),
        few(g.repeat_words, w.count),
        few(g.dup_lines, np.bincount(g.row, minlength=n)),
        np.log(np.maximum(kinds, 1)) / np.log(nw + 1),
        few(top, w.count),
        np.log(nw / lines),
        few(lost, w.count),
        few(np.bincount(w.row[size > 20], minlength=n), w.count),
        few(stutter, w.count),
    ], axis=1)
    return out


def _share(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    acc = np.concatenate([[0], np.cumsum(flags)])
    return (acc[offs[1:]] - acc[offs[:-1]]) / np.maximum(np.diff(offs), 1)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log terms of labels 0 and 1."""
    means: np.ndarray
    whiten: np.ndarray
    log_terms: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = [(x - m) @ f.T for m, f in zip(self.means, self.whiten)]
        d = [t - 0.5 * (v * v).sum(1) for v, t in zip(z, self.log_terms)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))


def fit_moments(count: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Discriminant:
    """Model from the labels' counts, sums and sums of outer products."""
    p = total.shape[1]
    means = total / count[:, None]
    cov = outer / count[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (count[:, None, None] * cov).sum(0) / count.sum()
    scale = np.trace(pooled) / p
    cov = (1 - SHRINK_POOLED - SHRINK_IDENTITY) * cov + SHRINK_POOLED * pooled + SHRINK_IDENTITY * max(scale, 1e-9) * np.eye(p)
    chol = np.linalg.cholesky(cov)
    whiten = np.stack([np.linalg.solve(c, np.eye(p)) for c in chol])
    logs = np.log(count / count.sum()) - np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1)
    return Discriminant(means, whiten, logs)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""
    def run(batches):
        for b in batches:
            for i, j, raw, offs in _text.chunks(b.column(1)):
                x = statistics(raw, offs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on all rows of ``labels`` (doc_id, quality 0 or 1); None with fewer
    than two labels."""
    p = len(STATS)

    def moments(batches):
        sums = np.zeros((2, 1 + p + p * p))
        for b in batches:
            y = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, p)
            for c in (0, 1):
                v = x[y == c]
                sums[c] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        at = np.arange(sums.shape[1])
        for c in (0, 1):
            if sums[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[c])], names=["y", "at", "v"])

    known = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    rows = vectors.join(known, "doc_id").select("y", "x").mapInArrow(moments, "y int, at int, v double")
    got = rows.groupBy("y", "at").agg(F.sum("v").alias("v")).collect()      # 2 x (1 + p + p*p) rows
    sums = np.zeros((2, 1 + p + p * p))
    for r in got:
        sums[r.y, r.at] = r.v
    if not sums[:, 0].all():
        return None
    return fit_moments(sums[:, 0], sums[:, 1:1 + p], sums[:, 1 + p:].reshape(2, p, p))


def training(labels: DataFrame) -> DataFrame:
    """The label rows to learn from: crc32 of the id's text, modulo 3, not 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row; the statistics are taken once, staged in
    the shared folder."""
    vectors = staged(features(docs), "quality-features")
    model = fit(vectors, training(labels))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(STATS))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return vectors.mapInArrow(run, "doc_id long, score double")


def select_good(docs: DataFrame, model: Discriminant | None, least: float = 0.5) -> DataFrame:
    """``docs`` whose score reaches ``least``; all columns stay."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            keep = [np.zeros(0, bool)]
            for _, _, raw, offs in _text.chunks(b.column(at)):
                keep.append(model.score(statistics(raw, offs)) >= least if model else np.ones(len(offs) - 1, bool))
            yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
