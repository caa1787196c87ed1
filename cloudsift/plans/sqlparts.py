"""SQL (DuckDB dialect) fragments for the oracle side of the catalog.

Each colour stage is its own SELECT so no expression is repeated; the
floating-point operations are written in the same order as the Column
expressions in ``cloudsift.functions.color``.
"""

from __future__ import annotations

import math

from cloudsift.operators import permute as PM

THIRD = "(1::DOUBLE/3)"
SIXTH = "(1::DOUBLE/6)"
TWO3 = "(2::DOUBLE/3)"
TAN_HALF_FOV = f"CAST('{math.tan(math.radians(75.0) / 2)!r}' AS DOUBLE)"


def sql_hash(v: str) -> str:
    """X1 over code points (equal to UTF-16 units for BMP text)."""
    return ("CASE WHEN {v} = '' THEN 0::BIGINT ELSE list_reduce(list_transform(string_split({v}, ''), "
            "lambda c: unicode(c)::BIGINT), lambda h, u: u + (((h * 32 + 2147483648) % 4294967296 "
            "+ 4294967296) % 4294967296 - 2147483648) - h, 0::BIGINT) END").format(v=v)


def sql_rgb(inner: str, h: str, s: str, l: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    """Wrap a SELECT: add INTEGER columns r, g, b from HSL expressions (0..1)
    over its columns; temporaries are dropped."""
    s1 = (f"SELECT *, ((CAST({h} AS DOUBLE) % 1.0) + 1.0) % 1.0 AS _hh, "
          f"least(greatest(CAST({s} AS DOUBLE), 0.0), 1.0) AS _ss, "
          f"least(greatest(CAST({l} AS DOUBLE), 0.0), 1.0) AS _ll FROM ({inner}) _c1")
    s2 = f"SELECT *, CASE WHEN _ll <= 0.5 THEN _ll * (_ss + 1.0) ELSE _ll + _ss - _ll * _ss END AS _p FROM ({s1}) _c2"
    s3 = (f"SELECT *, _ll * 2.0 - _p AS _q, _hh + {THIRD} AS _t0, _hh AS _t1, _hh - {THIRD} AS _t2 "
          f"FROM ({s2}) _c3")
    s4 = ("SELECT *, " + ", ".join(f"CASE WHEN _t{i} < 0 THEN _t{i} + 1.0 ELSE _t{i} END AS _u{i}"
                                   for i in range(3)) + f" FROM ({s3}) _c4")
    s5 = ("SELECT *, " + ", ".join(f"CASE WHEN _u{i} > 1 THEN _u{i} - 1.0 ELSE _u{i} END AS _w{i}"
                                   for i in range(3)) + f" FROM ({s4}) _c5")

    def chan(i: int) -> str:
        w = f"_w{i}"
        return (f"CASE WHEN _ss = 0 THEN _ll WHEN {w} < {SIXTH} THEN _q + (_p - _q) * 6 * {w} "
                f"WHEN {w} < 0.5 THEN _p WHEN {w} < {TWO3} THEN _q + (_p - _q) * 6 * ({TWO3} - {w}) "
                f"ELSE _q END")

    s6 = f"SELECT *, {chan(0)} AS _x0, {chan(1)} AS _x1, {chan(2)} AS _x2 FROM ({s5}) _c6"
    tmp = "_hh, _ss, _ll, _p, _q, _t0, _t1, _t2, _u0, _u1, _u2, _w0, _w1, _w2, _x0, _x1, _x2"
    return (f"SELECT * EXCLUDE ({tmp}), CAST(floor(_x0 * 255 + 0.5) AS INTEGER) AS {r}, "
            f"CAST(floor(_x1 * 255 + 0.5) AS INTEGER) AS {g}, CAST(floor(_x2 * 255 + 0.5) AS INTEGER) AS {b} "
            f"FROM ({s6}) _c7")


def sql_hash_rgb(inner: str, v: str, r: str = "r", g: str = "g", b: str = "b", grey_empty: bool = True) -> str:
    """Wrap a SELECT: hash colour of column v (grey for null / '')."""
    s0 = f"SELECT *, {sql_hash(v)} AS _hv FROM ({inner}) _k0"
    h = "CAST(((_hv % 360) + 360) % 360 AS DOUBLE) / 360.0"
    s = "CAST(70 + _hv % 20 AS DOUBLE) / 100.0"
    l = "CAST(50 + _hv % 20 AS DOUBLE) / 100.0"
    col = sql_rgb(s0, h, s, l, "_r8", "_g8", "_b8")
    if not grey_empty:
        return f"SELECT * EXCLUDE (_hv, _r8, _g8, _b8), _r8 AS {r}, _g8 AS {g}, _b8 AS {b} FROM ({col}) _k1"
    nul = f"({v} IS NULL OR {v} = '')"
    return (f"SELECT * EXCLUDE (_hv, _r8, _g8, _b8), CASE WHEN {nul} THEN 136 ELSE _r8 END AS {r}, "
            f"CASE WHEN {nul} THEN 136 ELSE _g8 END AS {g}, CASE WHEN {nul} THEN 136 ELSE _b8 END AS {b} "
            f"FROM ({col}) _k1")


def sql_number_text(v: str) -> str:
    return (f"CASE WHEN {v} = floor({v}) THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({v} AS VARCHAR) END")


def sql_gradient_rgb(inner: str, v: str, lo: str, hi: str) -> str:
    """Wrap a SELECT: X4 colour of column v against columns lo, hi (grey for
    null; flat range → hash of the number text)."""
    s0 = (f"SELECT *, ({v} - {lo}) / ({hi} - {lo}) AS _n, {sql_number_text(v)} AS _vt "
          f"FROM ({inner}) _g0")
    grad = sql_rgb(s0, "(1 - _n) * 0.7", "0.8", "0.5", "_gr", "_gg", "_gb")
    hashed = sql_hash_rgb(grad, "_vt", "_hr", "_hg", "_hb", grey_empty=False)

    def pick(c: str) -> str:
        return (f"CASE WHEN {v} IS NULL THEN 136 WHEN {hi} > {lo} THEN _g{c} ELSE _h{c} END AS {c}")

    return (f"SELECT * EXCLUDE (_n, _vt, _gr, _gg, _gb, _hr, _hg, _hb), {pick('r')}, {pick('g')}, {pick('b')} "
            f"FROM ({hashed}) _g1")


def sql_permutation(numbered: str, keep: str, seed: int) -> str:
    """W1 as a keyed bijection: rows of the CTE ``numbered`` (columns ``keep``
    and ``num`` 0 .. n-1) with ``row_idx``. A list of CTEs (recursive: the walk
    back below n), the last one named ``permuted``."""
    p, q, keys = PM.P, PM.Q, PM.Permutation(1, seed).keys

    def network(inner: str) -> str:
        text = f"SELECT *, v // b AS l, v % b AS r FROM ({inner}) n0"
        for i, (add, first, second) in enumerate(keys):
            half, other, size = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
            mixed = f"((({half} + {add}) % {p}) * {first} % {p}) * {second} % {q}"
            text = f"SELECT * REPLACE (({other} + {mixed}) % {size} AS {other}) FROM ({text}) n{i + 1}"
        return f"SELECT num, n, a, b, k + 1 AS k, l * b + r AS v FROM ({text}) w"

    return f"""total AS (SELECT count(*) AS n FROM {numbered}),
grid AS (SELECT n, CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT) + 1 AS a FROM total),
sides AS (SELECT n, a, greatest((n + a - 1) // a, 1) AS b FROM grid),
walk AS (SELECT num, n, a, b, CAST(0 AS BIGINT) AS k, CAST(num AS BIGINT) AS v FROM {numbered}, sides
  UNION ALL {network("SELECT * FROM walk WHERE k = 0 OR v >= n")}),
permuted AS (SELECT {keep}, v AS row_idx FROM {numbered} JOIN walk USING (num) WHERE k > 0 AND v < n)"""
