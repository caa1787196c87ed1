"""4. Document fingerprints by winnowing.

Every window of ``K`` code points has a rolling hash; of every ``W``
neighbouring hashes the smallest is chosen, the rightmost one of equals. The
chosen hashes, in order of position, are the fingerprint, and the positions
are kept: any passage of at least ``K + W - 1`` code points that two texts
share gives them a chosen hash in common, at positions whose difference is
that of the passage. A text of fewer than K code points has the hash of the
whole text; an empty text has none.

The likeness of two fingerprints is the share of common hashes among all
distinct ones; two empty fingerprints have likeness 1.

``neighbours`` runs over the table in order of doc_id in one shuffle of the
texts: rows are dealt to ranges of ids, each range also gets the first
document of the next range (the last one that of the whole table), and a task
streams its range in order, holding two texts.

Rows: null text is the empty text. Rows with equal doc_id are ordered by text,
and each is a document. Null doc_ids come first. Other columns are not read.

An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text

K, W = 24, 64
RANGE_CHARS = 4_000_000
MAX_RANGES = 10_000


def hashes(cp: np.ndarray, k: int = K) -> np.ndarray:
    """Hash (32 bit) of every window of k code points: h(i) = sum of
    code(i + j) * base^j, rolled up by doubling."""
    with np.errstate(over="ignore"):
        one = _text.mix64(cp.astype(np.uint64) * _text._GOLD)
        have, size, at = one, 1, None
        done = 0
        left = k
        power = _text._BASE
        while left:
            if left & 1:
                part = have[done:]
                if at is None:
                    at = part.copy()
                else:
                    m = len(part)
                    at = at[:m] + part * np.uint64(pow(_text._BASE, done, 1 << 64))
                done += size
            left >>= 1
            if left:
                have = have[:-size] + have[size:] * np.uint64(power) if len(have) > size else have[:0]
                power = power * power % (1 << 64)
                size *= 2
        return (_text.mix64(at[:max(0, len(cp) - k + 1)]) >> np.uint64(32)).astype(np.uint32)


def winnow(cp: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from a text's code points."""
    if len(cp) < k:
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return hashes(cp, len(cp)), np.zeros(1, np.int64)
    h = hashes(cp, k)
    # the smallest key has the smallest hash, and of equals the last position
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    size = 1
    w = min(w, len(key))
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < w:
        key = np.minimum(key[:len(key) - (w - size)], key[w - size:])
    pick = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (pick >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (pick & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common share of two arrays of distinct sorted hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hex(h: np.ndarray) -> str:
    return h.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hashes (array<long>) and positions (array<long>) of every
    text."""
    def run(batches):
        for b in batches:
            for i, j in _text.spans(_text.utf8(b.column(1))[1]):
                got = [winnow(_points(x or "")) for x in b.column(1)[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))],
                    names=["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """(range, doc_id, text, tail) and the number of ranges: every row in its
    range of ids; tail rows are the first document of the next range, once
    more. Range limits are quantiles of the ids, so ranges hold about as many
    documents each, whatever the ids are."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("doc_id").alias("n")).first()
    parts = max(1, min(MAX_RANGES, (size.chars or 0) // RANGE_CHARS + 1))
    limits = []
    if size.n and parts > 1:
        at = [i / parts for i in range(1, parts)]
        got = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * parts)).alias("q")).first()   # at most MAX_RANGES values
        limits = sorted({float(x) for x in got.q})
    keyed = rows.withColumn("id_number", F.col("doc_id").cast("double"))
    if limits:
        keyed = Bucketizer(splits=[-math.inf, *limits, math.inf], inputCol="id_number", outputCol="place", handleInvalid="keep").transform(keyed)
    else:
        keyed = keyed.withColumn("place", F.lit(0))
    dealt = keyed.select(F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("place").cast("int")).alias("range"), "doc_id", "text")
    # the first document of every range, from the ids alone
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("f")
    firsts = dealt.groupBy("range").agg(first).orderBy("range").collect()                # one row per range
    tails = [(firsts[i].f.doc_id, firsts[i - 1].range) for i in range(len(firsts))]      # the first range's go to the last
    small = docs.sparkSession.createDataFrame(tails, "id long, to int")
    here, there = F.struct(F.col("range"), F.lit(False).alias("tail")), F.struct(F.col("to").alias("range"), F.lit(True).alias("tail"))
    both = dealt.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    both = both.withColumn("at", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return both.select("at.range", "doc_id", "text", "at.tail"), len(limits) + 1


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter of
    its code points, rounded down, replaced by the first as many of the next
    document's), and their likenesses."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
              " near_edited double, near_next double, positions array<long>")
    dealt, n = _ranges(docs)

    def emit(doc_id, text, nxt, own, after):
        cut = len(text) // 4
        edited = text[:len(text) - cut] + nxt[:cut]
        h, p = own
        e, _ = winnow(_points(edited)) if cut else own
        u = np.unique(h)
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), _hex(h), _hex(e),
                likeness(u, np.unique(e)), likeness(u, np.unique(after[0])), p)

    def batch(rows):
        names = [c.split()[0] for c in schema.replace("array<long>", "x").split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        held, at, rows, size = None, None, [], 0
        for b in batches:
            for i, j in _text.spans(_text.utf8(b.column(2))[1]):
                cols = [c[i:j].to_pylist() for c in b.columns]
                for rng, doc_id, text, tail in zip(*cols):
                    own = winnow(_points(text))
                    if held is not None and rng == at:
                        rows.append(emit(*held[:2], text, held[2], own))
                        size += len(rows[-1][3]) + len(rows[-1][4])
                    held, at = (None, None) if tail else ((doc_id, text, own), rng)
                    if size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    ordered = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "tail", "doc_id", "text")
    return ordered.select("range", "doc_id", "text", "tail").mapInArrow(run, schema)
