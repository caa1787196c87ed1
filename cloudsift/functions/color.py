"""Colour expressions (X1–X6), all JVM-side.

The conversion chain is applied in stages (one projection per stage), so no
stage is recomputed per channel: Catalyst keeps a projection separate when an
expensive expression would otherwise be inlined several times.

The colour of a categorical value is a pure function of its text, so it can
be computed over the (small) domain and joined, or computed per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grey for null / empty, gradient hue span, saturation, lightness.
NULL_RGB8 = (136, 136, 136)  # #888888
GRADIENT_HUE_SPAN = 0.7
GRADIENT_S = 0.8
GRADIENT_L = 0.5
HUE_ASSIGN_S = 0.8
HUE_ASSIGN_L = 0.5

_TWO31 = 2 ** 31
_TWO32 = 2 ** 32
_TMP = ("_hh", "_ss", "_ll", "_p", "_q", "_t0", "_t1", "_t2", "_u0", "_u1", "_u2",
        "_w0", "_w1", "_w2", "_x0", "_x1", "_x2")


def utf16_units(s: Column) -> Column:
    """array<bigint> of the UTF-16 code units of a string."""
    hexs = F.hex(F.encode(s, "UTF-16BE"))
    return F.transform(F.regexp_extract_all(hexs, F.lit("([0-9A-F]{4})"), 1),
                       lambda u: F.conv(u, 16, 10).cast("bigint"))


def category_hash(s: Column) -> Column:
    """h = unit + ((h << 5) - h) over UTF-16 units, where only the shift
    wraps to 32 bits (the subtraction and the sum stay exact)."""
    return F.aggregate(
        utf16_units(s), F.lit(0).cast("bigint"),
        lambda h, u: u + (F.pmod(h * 32 + F.lit(_TWO31), F.lit(_TWO32)) - F.lit(_TWO31)) - h)


def category_hsl(h: Column) -> tuple[Column, Column, Column]:
    """(hue, saturation, lightness) in 0..1 from a hash column; %
    truncates, so saturation and lightness keep the sign of h."""
    hue = F.pmod(h, F.lit(360)).cast("double") / 360.0
    sat = (F.lit(70) + h % 20).cast("double") / 100.0
    light = (F.lit(50) + h % 20).cast("double") / 100.0
    return hue, sat, light


def with_rgb(df: DataFrame, h: Column, s: Column, l: Column,
             names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """X3 + X6: add 8-bit r, g, b from HSL (0..1) columns, in stages."""
    c = F.col
    t = df.withColumns({"_hh": ((h % 1.0) + 1.0) % 1.0,  # euclidean modulo, rounding included
                        "_ss": F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)),
                        "_ll": F.least(F.greatest(l, F.lit(0.0)), F.lit(1.0))})
    t = t.withColumn("_p", F.when(c("_ll") <= 0.5, c("_ll") * (c("_ss") + 1.0))
                     .otherwise(c("_ll") + c("_ss") - c("_ll") * c("_ss")))
    t = t.withColumns({"_q": c("_ll") * 2.0 - c("_p"), "_t0": c("_hh") + 1.0 / 3,
                       "_t1": c("_hh"), "_t2": c("_hh") - 1.0 / 3})
    t = t.withColumns({f"_u{i}": F.when(c(f"_t{i}") < 0, c(f"_t{i}") + 1.0).otherwise(c(f"_t{i}"))
                       for i in range(3)})
    t = t.withColumns({f"_w{i}": F.when(c(f"_u{i}") > 1, c(f"_u{i}") - 1.0).otherwise(c(f"_u{i}"))
                       for i in range(3)})

    def chan(i: int) -> Column:
        w, a, b = c(f"_w{i}"), c("_q"), c("_p")
        return (F.when(c("_ss") == 0, c("_ll"))
                .when(w < 1.0 / 6, a + (b - a) * 6 * w)
                .when(w < 1.0 / 2, b)
                .when(w < 2.0 / 3, a + (b - a) * 6 * (2.0 / 3 - w))
                .otherwise(a))

    t = t.withColumns({f"_x{i}": chan(i) for i in range(3)})
    t = t.withColumns({n: to_rgb8(c(f"_x{i}")) for i, n in enumerate(names)})
    return t.drop(*_TMP)


def to_rgb8(c: Column) -> Column:
    """0..1 → 0..255, round half up."""
    return F.floor(c * 255 + 0.5).cast("int")


def _grey(df: DataFrame, is_grey: Column, names=("r", "g", "b")) -> DataFrame:
    return df.withColumns({n: F.when(is_grey, F.lit(g)).otherwise(F.col(n))
                           for n, g in zip(names, NULL_RGB8)})


def with_hash_rgb(df: DataFrame, value: str, names=("r", "g", "b"), grey_empty: bool = True) -> DataFrame:
    """X5 + X1–X3: colour of a text column; grey for null or ''."""
    v = F.col(value).cast("string")
    t = df.withColumn("_hv", category_hash(v))
    t = with_rgb(t, *category_hsl(F.col("_hv")), names=names).drop("_hv")
    return _grey(t, v.isNull() | (v == ""), names) if grey_empty else t


def number_text(v: Column) -> Column:
    """Text of a number: whole numbers without a decimal point, others as
    Spark writes them. The reference's number printer differs for very large
    and very small values (exponents); that only changes which colour a flat
    range of such values gets."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def with_gradient_rgb(df: DataFrame, value: str, lo: Column, hi: Column, names=("r", "g", "b")) -> DataFrame:
    """Blue at min, red at max; a flat range falls back to the hash of the
    value's text (the hash is only evaluated then); null is grey."""
    c = F.col
    v = F.nanvl(c(value).cast("double"), F.lit(None).cast("double"))
    t = df.withColumns({"_v": v, "_lo": lo.cast("double"), "_hi": hi.cast("double")})
    flat = ~F.coalesce(c("_hi") > c("_lo"), F.lit(False))  # no range or a flat one
    t = t.withColumns({
        "_n": F.when(~flat, (c("_v") - c("_lo")) / (c("_hi") - c("_lo"))),
        "_fh": F.when(flat, category_hash(number_text(c("_v"))))})
    fh, fs, fl = category_hsl(c("_fh"))
    t = t.withColumns({
        "_gh": F.when(flat, fh).otherwise((1 - c("_n")) * GRADIENT_HUE_SPAN),
        "_gs": F.when(flat, fs).otherwise(F.lit(GRADIENT_S)),
        "_gl": F.when(flat, fl).otherwise(F.lit(GRADIENT_L))})
    t = with_rgb(t, c("_gh"), c("_gs"), c("_gl"), names)
    t = _grey(t, c("_v").isNull(), names)
    return t.drop("_v", "_lo", "_hi", "_n", "_fh", "_gh", "_gs", "_gl")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """8-bit channels → '#rrggbb'."""
    return F.format_string("#%02x%02x%02x", r, g, b)


def hex_rgb8(h: Column) -> Column:
    """X6: '#rrggbb' → struct(r,g,b) 8-bit."""
    return F.struct(*(F.conv(F.substring(h, 2 + 2 * i, 2), 16, 10).cast("int").alias(n)
                      for i, n in enumerate("rgb")))
