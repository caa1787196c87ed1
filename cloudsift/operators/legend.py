"""Legends (L1, L2, O4) — small tables derived from profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudsift.functions import color as C
from cloudsift.functions.text import fixed
from cloudsift.operators.ranks import range_rank

LEGEND_LIMIT = 100  # fixed value: legend rows the viewer shows; not a default here
MORE_RGB8 = (149, 165, 166)  # fixed value: text colour of the '... and N more' line
STOPS = 100  # fixed value: gradient stops 0..100


def legend_top(domain: DataFrame, attribute: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first `limit` sorted values (a distributed top-k) and the count
    of the rest; without a limit all values, ranked in sampled ranges (no
    one-partition sort, whatever prefix the values share)."""
    dom = domain.where(F.col("attribute") == attribute)
    if limit is None:
        top = range_rank(dom, ["value"], "_pos")
        top = top.withColumn("ord", F.col("_pos").cast("int") + 1).drop("_pos")
        return top, dom.agg(F.lit(0).cast("bigint").alias("remaining"))
    top = dom.orderBy("value").limit(limit)
    top = top.withColumn("ord", F.row_number().over(Window.orderBy("value")))  # ≤ limit rows
    rest = dom.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).cast("bigint").alias("remaining"))
    return top, rest


def legend_categorical(domain: DataFrame, attribute: str, palette: DataFrame | None = None,
                       limit: int | None = None) -> DataFrame:
    """L1: (ord, value, label, r, g, b) of all values, or of the first
    ``limit`` plus one '... and N more' row (ord = limit + 1) when values
    remain."""
    top, rest = legend_top(domain, attribute, limit)
    if palette is not None:
        p = palette.where(F.col("attribute") == attribute).select("value", "r", "g", "b")
        items = top.join(p, "value", "left").select(
            "ord", "value", *(F.coalesce(F.col(c), F.lit(g)).alias(c) for c, g in zip("rgb", C.NULL_RGB8)))
    else:
        items = C.with_hash_rgb(top.select("ord", "value"), "value")
    items = items.select(
        F.col("ord").cast("int").alias("ord"), "value",
        F.when(F.col("value") == "", F.lit("(empty)")).otherwise(F.col("value")).alias("label"),
        "r", "g", "b")
    if limit is None:
        return items
    more = rest.where(F.col("remaining") > 0).select(
        F.lit(limit + 1).alias("ord"), F.lit(None).cast("string").alias("value"),
        F.concat(F.lit("... and "), F.col("remaining").cast("string"), F.lit(" more")).alias("label"),
        *(F.lit(v).alias(n) for v, n in zip(MORE_RGB8, "rgb")))
    return items.unionByName(more)


def legend_continuous(ranges: DataFrame, attribute: str, stops: int = STOPS) -> DataFrame:
    """L2: stops i/stops with value min+(max-min)*i/stops and its colour, plus
    the end labels to 4 places; no rows when the attribute has no data."""
    rng = ranges.where(F.col("attribute") == attribute)
    st = rng.select("min_value", "max_value", F.explode(F.sequence(F.lit(0), F.lit(stops))).alias("stop"))
    pos = F.col("stop").cast("double") / stops
    val = F.col("min_value") + (F.col("max_value") - F.col("min_value")) * pos
    st = st.select("stop", "min_value", "max_value", val.alias("value"))
    st = C.with_gradient_rgb(st, "value", F.col("min_value"), F.col("max_value"))
    st = st.withColumns({"min_label": fixed("min_value", 4), "max_label": fixed("max_value", 4)})
    return st.select(F.col("stop").cast("int").alias("stop"), "value", "r", "g", "b", "min_label", "max_label")
