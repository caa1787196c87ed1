"""11. Embedding whitening by bit-sliced scatter.

Vectors become whole numbers x = floor(256 * c). The covariance is exact: in
chunks of rows, each dimension is shifted by the chunk's minimum, its bit
planes are packed across rows into 64-bit words, and the cross-product of two
dimensions is the sum over plane pairs (p, q) of 2^(p+q) times the popcount of
the words' AND. The shifts are undone in whole numbers, Spark adds up the
chunks, and the driver centres the sums as whole numbers (n * sum(x y) -
sum(x) sum(y)) before ``eigh``. What reaches the driver is d * (d + 1) / 2
sums, whatever the number of rows.

Rows: a null vector, a null or non-finite entry, or one whose x does not fit
2^62 drops the row. The dimension is the length that most distinct vectors
have (ties: the longest); rows of another length, and empty vectors, are
dropped. Equal vectors count once in the fit and each row gets its result.
Null ids stay. Extra columns are ignored. An empty table gives no rows. A
component without variance (fewer distinct vectors than components, constant
dimensions) has null ``whitened``, and ``explained`` is null if nothing varies.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.session import staged

#: Components returned, and rows whose planes are packed at a time.
COMPONENTS = 4
ROWS = 4096
#: A component whose eigenvalue is below this share of the largest has no variance.
NO_VARIANCE = 1e-12
_LIMIT = float(1 << 62)


def whole_numbers(vector: Column) -> Column:
    """floor(256 c) of every entry, null if the vector is to be dropped."""
    scaled = F.transform(vector, lambda c: c.cast("double") * 256.0)
    fit = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < _LIMIT, F.lit(False)))     # null, NaN and infinity fail
    return F.when((F.size(vector) > 0) & fit, F.transform(scaled, lambda c: F.floor(c)))


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words [plane, word], dimension and weight of each plane, shift of each
    dimension) of rows x [row, dimension]."""
    low = x.min(axis=0)
    up = (x - low).astype(np.uint64)
    top = up.max(axis=0)
    dim = np.repeat(np.arange(x.shape[1]), [int(t).bit_length() for t in top])
    weight = np.arange(len(dim)) - np.searchsorted(dim, dim)
    pad = -len(x) % 64
    up = np.pad(up, ((0, pad), (0, 0))).T                                             # added rows are 0 in every plane
    bits = (up[dim] >> weight.astype(np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), dim, weight, low


def scatter(x: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """(rows, sums, cross-products) of whole numbers x, exact."""
    n, d = x.shape
    words, dim, weight, low = planes(x)
    pop = np.zeros((len(dim), len(dim)), np.int64)
    for i in range(len(dim)):
        pop[i, i:] = pop[i:, i] = np.bitwise_count(words[i] & words[i:]).sum(axis=1, dtype=np.uint32)
    small = 2 * int(weight.max(initial=0)) + 2 + n.bit_length() < 62
    two = np.array([1 << int(w) for w in weight], np.int64 if small else object)
    varies, first = np.unique(dim, return_index=True)
    part = (pop if small else pop.astype(object)) * two[:, None] * two
    cross = np.zeros((d, d), np.int64 if small else object)
    shifted = [0] * d
    if len(varies):
        cross[np.ix_(varies, varies)] = np.add.reduceat(np.add.reduceat(part, first, axis=0), first, axis=1)
        for i, t in zip(varies, np.add.reduceat(pop.diagonal() * two, first)):
            shifted[i] = int(t)
    cross = cross.tolist()
    m = [int(v) for v in low]
    sums = [s + n * k for s, k in zip(shifted, m)]
    full = [[cross[i][j] + m[i] * shifted[j] + m[j] * shifted[i] + n * m[i] * m[j] if j >= i else 0 for j in range(d)] for i in range(d)]
    return n, sums, full


def _vectors(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


_PART = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.decimal128(38, 0))])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: (-1, -1) rows, (-1, i) sums, (i, j) cross-products."""
    held, total, rows = [], None, 0

    def add(parts):
        nonlocal total
        n, sums, cross = scatter(np.concatenate(parts))
        flat = np.array([n, *sums, *(v for i, r in enumerate(cross) for v in r[i:])], object)
        total = flat if total is None else total + flat
        return len(sums)

    d = 0
    for b in batches:
        x = _vectors(b.column(0))
        for at in range(0, len(x), ROWS):
            held.append(x[at:at + ROWS])
            rows += len(held[-1])
            if rows >= ROWS:
                d, held, rows = add(held), [], 0
    if rows:
        d = add(held)
    if total is None:
        return
    keys = [(-1, -1), *((-1, i) for i in range(d)), *((i, j) for i in range(d) for j in range(i, d))]
    i, j = zip(*keys)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                      pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], schema=_PART)


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> dict | None:
    """The whitening of the distinct vectors of ``column`` (arrays of bigint of
    one length, no nulls): n, sums, eigenvalues, components, trace. None
    without vectors."""
    rows = vectors.select(column).mapInArrow(_partials, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not rows:
        return None
    got = {(r.i, r.j): int(r.s) for r in rows}
    n = got[-1, -1]
    d = sum(k[0] == -1 for k in got) - 1
    sums = [got[-1, i] for i in range(d)]
    cov = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (n * got[i, j] - sums[i] * sums[j]) / (n * n)       # whole numbers until here
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], vectors_[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    varies = values > NO_VARIANCE * max(values[0], 0.0) if trace > 0 else np.zeros(len(values), bool)
    return {"n": n, "sums": sums, "values": values, "axes": axes, "trace": trace, "varies": varies}


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened rows (centred as whole numbers where they fit, then divided)."""
    n, sums = model["n"], model["sums"]
    near = max(abs(s) for s in sums) < 1 << 61 and int(np.abs(x).max(initial=0)) < (1 << 61) // n
    centred = (x * n - np.array(sums)).astype(float) if near else (x.astype(object) * n - np.array(sums, object)).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return centred / n @ model["axes"] / np.sqrt(model["values"])


def _spread(model: dict):
    """Sums of whitened values and of their products, of a task."""
    k = len(model["values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                w = np.where(model["varies"], project(_vectors(b.column(0).slice(at, ROWS)), model), 0.0)
                s, p = s + w.sum(axis=0), p + w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(k, -1), i], pa.int32()), pa.array(np.r_[np.arange(k), j], pa.int32()), pa.array(np.r_[s, p.ravel()])], names=["i", "j", "s"])

    return run


def identity_error(vectors: DataFrame, model: dict, column: str = "x") -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity,
    measured on the vectors; null if no component varies."""
    live = np.flatnonzero(model["varies"])
    if not len(live):
        return None
    rows = vectors.select(column).mapInArrow(_spread(model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    got = {(r.i, r.j): r.s / model["n"] for r in rows}
    return float(max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in live for j in live))


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                  ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_text", pa.string())])


def _result(model: dict, error: float | None):
    k, n = len(model["values"]), model["n"]
    told = [float(v) / model["trace"] if model["trace"] > 0 else None for v in model["values"]]

    def deviations(x: np.ndarray) -> list[int]:
        off = (x * float(n) - np.array(model["sums"], float))
        if (off * off).sum(axis=1).max(initial=0.0) < 2.0**62 and int(np.abs(x).max(initial=0)) < (1 << 61) // n:
            exact = x * n - np.array(model["sums"], np.int64)
            return (exact * exact).sum(axis=1).tolist()
        exact = x.astype(object) * n - np.array(model["sums"], object)
        return (exact * exact).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                ids, x = b.column(0).slice(at, ROWS), _vectors(b.column(1).slice(at, ROWS))
                rows = np.repeat(np.arange(len(x)), k)
                dev = deviations(x)
                white = np.where(model["varies"], project(x, model), np.nan).ravel()
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)),
                    pa.array([v if v < 1 << 63 else None for v in dev], pa.int64()).take(pa.array(rows)), pa.array(white, mask=np.isnan(white)),
                    pa.array(told * len(x), pa.float64()), pa.array([error] * len(rows), pa.float64()),
                    pa.array([str(v) for v in dev]).take(pa.array(rows))], schema=_OUT)

    return run


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per kept row and component (numbered from 1 by falling
    eigenvalue): ``vec_id``, ``component``, ``n`` (distinct vectors),
    ``deviation`` (null if beyond a long; ``deviation_text`` always has it),
    ``whitened``, ``explained``, ``identity_error``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), whole_numbers(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    once = staged(rows.select("x").distinct(), "distinct-vectors")
    length = once.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string")
    of_length = F.size("x") == length.d
    once = once.where(of_length)
    model = fit(once, "x", components)
    done = _result(model, identity_error(once, model))
    return rows.where(of_length).mapInArrow(done, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string")
