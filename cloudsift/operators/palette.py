"""Palettes and colour encoding.

A palette is a small table (attribute, value, r, g, b) built on a domain,
never on the rows. It reaches the rows through a join that is broadcast only
after its size was counted and found under the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.functions import color as C
from cloudsift.operators.profile import attribute_domain
from cloudsift.operators.ranks import two_level_rank
from cloudsift.roles import Roles
from cloudsift.session import BROADCAST_MAX_ROWS, small_or_whole

def build_palette(domain: DataFrame, attribute: str) -> DataFrame:
    """J1 (build side): hash colour of each domain value of one attribute; ''
    is grey (X5)."""
    dom = domain.where(F.col("attribute") == attribute).select("attribute", "value")
    return C.with_hash_rgb(dom, "value")


def overrides_table(spark: SparkSession, attribute: str, colours: dict[str, str]) -> DataFrame:
    """User colours as a table (attribute, value, hex)."""
    rows = [(attribute, str(v), h) for v, h in colours.items()]
    return spark.createDataFrame(rows, "attribute string, value string, hex string")


def palette_override(palette: DataFrame, overrides: DataFrame) -> DataFrame:
    """Colours given by the user win over generated ones. ``overrides``
    has (attribute, value) and either ``hex`` text or r, g, b (such as the
    table of ``hue_assignment``)."""
    colour = C.hex_rgb8(F.col("hex")) if "hex" in overrides.columns else F.struct("r", "g", "b")
    o = small_or_whole(overrides.select("attribute", "value", colour.alias("o")))
    j = palette.join(o, ["attribute", "value"], "left")
    return j.select("attribute", "value",
                    *(F.coalesce(F.col(f"o.{c}"), F.col(c)).alias(c) for c in "rgb"))


def palette_join(df: DataFrame, attribute: str, palette: DataFrame,
                 max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Per-row colour by value; null (no partner) is grey."""
    p = palette.where(F.col("attribute") == attribute).select(
        F.col("value").alias("_pv"), F.col("r").alias("_pr"), F.col("g").alias("_pg"),
        F.col("b").alias("_pb"))
    p = small_or_whole(p, max_broadcast_rows)
    j = df.join(p, F.col(attribute).cast("string") == F.col("_pv"), "left")
    grey = C.NULL_RGB8
    return j.select(*df.columns, *(F.coalesce(F.col(f"_p{c}"), F.lit(g)).alias(c)
                                   for c, g in zip("rgb", grey)))


def hue_assignment(domain: DataFrame, attribute: str, roles: Roles, seed: int = 42) -> DataFrame:
    """Evenly spaced hues i/n*360 dealt to the values in a seeded shuffled
    order (s = 0.8, l = 0.5). The permutation rank uses md5 buckets, so no
    single-partition sort."""
    if attribute in roles.continuous:
        raise ValueError("hue assignment is for categorical attributes only")
    dom = domain.where(F.col("attribute") == attribute).select("attribute", "value")
    k = F.md5(F.concat(F.lit(f"{seed}:"), F.col("value")))
    keyed = dom.withColumn("_k", k)
    # 16^4 buckets: only non-empty ones reach the count table, so a small
    # domain pays nothing and a huge one keeps small windows
    ranked = two_level_rank(keyed, F.conv(F.substring("_k", 1, 4), 16, 10).cast("int"),
                            [F.col("_k"), F.col("value")], "perm", keep_total=True)
    hue = F.col("perm").cast("double") / F.col("n_rows").cast("double")
    out = C.with_rgb(ranked, hue, F.lit(C.HUE_ASSIGN_S), F.lit(C.HUE_ASSIGN_L))
    return out.select("attribute", "value", "perm", "r", "g", "b")


def range_bounds(ranges: DataFrame, attribute: str) -> tuple[Column, Column]:
    """(min, max) of one attribute from an A4 table, as scalar subqueries."""
    one = ranges.where(F.col("attribute") == attribute)
    return one.select("min_value").scalar(), one.select("max_value").scalar()


def color_encode(df: DataFrame, attribute: str, roles: Roles, ranges: DataFrame | None = None,
                 palette: DataFrame | None = None) -> DataFrame:
    """Add r, g, b. Categoricals get their colour by a join with the
    palette (J1), which is built on the values once, not per row; continuous
    ones by the gradient."""
    if attribute in roles.categorical:
        if palette is None:
            palette = build_palette(attribute_domain(df, roles, (attribute,)), attribute)
        return palette_join(df, attribute, palette)
    if attribute in roles.continuous:
        if ranges is None:
            raise ValueError("continuous colours need a range table (A4)")
        lo, hi = range_bounds(ranges, attribute)
        return C.with_gradient_rgb(df, attribute, lo, hi)
    return C.with_hash_rgb(df, attribute)
