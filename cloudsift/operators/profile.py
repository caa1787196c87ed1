"""Attribute profiles: domains (A3), ranges (A4), distinct counts (A5),
load summary (A2), domain merge (U3), sorted domain (O1).

Domains come from one scan for all categoricals (unpivot + groupBy with
partial aggregation); the outputs are small tables sized by the number of
distinct values, never by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.operators.ranks import range_rank
from cloudsift.roles import Roles

# Slider step = max((max - min) / 1000, 1e-4), 1e-4 when flat.
MIN_STEP = 1e-4
STEP_DIVISOR = 1000


def clean_number(c: Column) -> Column:
    """NaN → null (as the pandas → Parquet path does), so min/max ignore it."""
    d = c.cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def attribute_domain(df: DataFrame, roles: Roles, attributes: tuple[str, ...] | None = None,
                     include_empty: bool = True) -> DataFrame:
    """A3: (attribute, value, n) over all categoricals in one pass; null is left
    out, '' kept when it occurs (unless include_empty is False)."""
    attrs = [a for a in (attributes or roles.categorical) if a in df.columns]
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
                      for a in attrs))
    long = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    if not include_empty:
        long = long.where(F.col("value") != "")
    return long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def slider_step(lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.greatest((hi - lo) / STEP_DIVISOR, F.lit(MIN_STEP))).otherwise(F.lit(MIN_STEP))


def attribute_range(df: DataFrame, roles: Roles, attributes: tuple[str, ...] | None = None) -> DataFrame:
    """A4: (attribute, min, max, step) of each continuous attribute; no row
    for an attribute with no non-null value."""
    attrs = [a for a in (attributes or roles.continuous) if a in df.columns]
    aggs = []
    for a in attrs:
        v = clean_number(F.col(a))
        aggs += [F.min(v).alias(f"{a}__min"), F.max(v).alias(f"{a}__max")]
    wide = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"{a}__min").alias("min_value"),
                              F.col(f"{a}__max").alias("max_value")) for a in attrs))
    out = wide.select(F.inline(rows)).where(F.col("min_value").isNotNull())
    return out.withColumn("step", slider_step(F.col("min_value"), F.col("max_value")))


def distinct_counts(df: DataFrame, roles: Roles, exact_id: bool = True) -> DataFrame:
    """A5: distinct values per categorical and for the id column (nulls not
    counted). Categoricals are counted from their domain (A3), which partial
    aggregation keeps small; the near-unique id has an aggregate of its own,
    or the HyperLogLog sketch."""
    attrs = [a for a in roles.categorical if a in df.columns]
    found = attribute_domain(df, roles, tuple(attrs)).groupBy("attribute").agg(F.count(F.lit(1)).cast("bigint").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(a,) for a in attrs], "attribute string")
    out = names.join(found, "attribute", "left").select("attribute", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"))
    if roles.id_col and roles.id_col in df.columns:
        idc = F.col(roles.id_col)
        n = F.count_distinct(idc) if exact_id else F.approx_count_distinct(idc)
        out = out.unionByName(df.agg(n.cast("bigint").alias("n_distinct")).select(F.lit(roles.id_col).alias("attribute"), "n_distinct"))
    return out


def load_summary(df: DataFrame, visible: Column, shards_loaded: int, rendered_cap: int | None = None,
                 shard_percent: int = 10) -> DataFrame:
    """A2: loaded, percent loaded, visible, rendered (all visible rows without
    a cap), capped?"""
    out = df.agg(F.count(F.lit(1)).alias("loaded"),
                 F.sum(F.when(visible, 1).otherwise(0)).cast("bigint").alias("visible"))
    out = out.withColumn("visible", F.coalesce(F.col("visible"), F.lit(0).cast("bigint")))
    return out.select(
        "loaded", F.lit(shards_loaded * shard_percent).alias("percent_loaded"), "visible",
        (F.col("visible") if rendered_cap is None else F.least(F.col("visible"), F.lit(rendered_cap).cast("bigint"))).alias("rendered"),
        (F.lit(False) if rendered_cap is None else F.col("visible") > rendered_cap).alias("capped"))


def domain_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Domain of old rows ∪ domain of new rows (counts summed)."""
    return (old.unionByName(new).groupBy("attribute", "value")
            .agg(F.sum("n").cast("bigint").alias("n")))


def sorted_domain(domain: DataFrame) -> DataFrame:
    """O1: values in binary string order within each attribute (a distributed
    range sort, not a one-partition window)."""
    return domain.orderBy("attribute", "value")


def ranked_domain(domain: DataFrame) -> DataFrame:
    """O1 with positions: each (attribute, value) and ``ord``, its 0-based
    place in binary string order over all attributes, ranked in sampled
    ranges."""
    return range_rank(domain, ["attribute", "value"], "ord")
