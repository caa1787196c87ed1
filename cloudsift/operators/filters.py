"""Filter lists (F1–F8, J4): an ordered list of specs ANDed into one Column.

A spec without attribute or type, a categorical spec with an empty value set,
or a continuous spec without a range is skipped (keeps every row).
Categorical values compare after null → '' (so null and '' are one value).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.roles import Roles
from cloudsift.session import small_or_whole


@dataclass(frozen=True)
class FilterSpec:
    id: int
    attribute: str | None = None
    type: str | None = None  # 'categorical' | 'continuous' | None
    values: tuple[str, ...] | None = None
    range: tuple[float, float] | None = None
    #: All values without naming them (for domains too large to list): rows with
    #: a value, and with ``"empty"`` also those whose value is null or ''.
    whole: str | None = None

    def is_active(self) -> bool:
        if not self.attribute or not self.type:
            return False
        if self.type == "continuous":
            return self.range is not None
        if self.type == "categorical":
            return bool(self.values) or self.whole is not None
        return False


def norm_category(c: Column) -> Column:
    """Categorical value as string, null → ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def filter_in(attribute: str, values) -> Column:
    """category in the chosen set (null == '')."""
    return norm_category(F.col(attribute)).isin(list(values))


def filter_range(attribute: str, lo: float, hi: float) -> Column:
    """lo <= v <= hi, both ends inclusive; null rejected."""
    return F.col(attribute).between(F.lit(lo), F.lit(hi))


def compile_spec(spec: FilterSpec) -> Column | None:
    """None when the spec is skipped."""
    if not spec.is_active():
        return None
    if spec.type == "continuous":
        return filter_range(spec.attribute, *spec.range)
    if spec.whole is not None:
        return F.lit(True) if spec.whole == "empty" else F.col(spec.attribute).isNotNull()
    return filter_in(spec.attribute, spec.values)


def compile_filters(specs: list[FilterSpec]) -> Column:
    """AND of the whole list, in order; an empty list keeps everything."""
    preds = [p for p in (compile_spec(s) for s in specs) if p is not None]
    return functools.reduce(lambda a, b: a & b, preds, F.lit(True))


def filter_all(df: DataFrame, specs: list[FilterSpec]) -> DataFrame:
    return df.where(compile_filters(specs))


def add_filter(specs: list[FilterSpec]) -> list[FilterSpec]:
    """A new filter is added empty (and so skipped)."""
    nxt = max((s.id for s in specs), default=0) + 1
    return specs + [FilterSpec(id=nxt)]


def remove_filter(specs: list[FilterSpec], filter_id: int) -> list[FilterSpec]:
    return [s for s in specs if s.id != filter_id]


def default_spec(filter_id: int, attribute: str, roles: Roles, domain_values=None,
                 value_range: tuple[float, float] | None = None) -> FilterSpec:
    """all domain values, or the full [min, max], or [0, 1] without range."""
    if attribute in roles.continuous:
        return FilterSpec(filter_id, attribute, "continuous", None, value_range or (0.0, 1.0))
    if attribute in roles.categorical:
        return FilterSpec(filter_id, attribute, "categorical", tuple(domain_values or ()), None)
    return FilterSpec(filter_id, attribute, None, None, None)


def push_range(spec: FilterSpec, end: str, value: float) -> FilterSpec:
    """moving one end past the other drags the other end along."""
    lo, hi = spec.range
    if end == "min":
        lo, hi = value, max(value, hi)
    else:
        lo, hi = min(value, lo), value
    return replace(spec, range=(lo, hi))


def push_range_columns(lo: Column, hi: Column, end: Column, value: Column) -> tuple[Column, Column]:
    """F6 over a table of specs."""
    new_lo = F.when(end == "min", value).otherwise(F.least(value, lo))
    new_hi = F.when(end == "min", F.greatest(value, hi)).otherwise(value)
    return new_lo, new_hi


def filter_frame(df: DataFrame, frame_key: str, rank) -> DataFrame:
    """on top of the filters, rows of one time rank (null rank is 0)."""
    return df.where(F.coalesce(F.col(frame_key).cast("int"), F.lit(0)) == F.lit(rank))


def filter_funnel(df: DataFrame, specs: list[FilterSpec]) -> DataFrame:
    """F8: rows before → after each filter in order, in one pass, plus a final
    row (step 0) with total → visible."""
    conds: list[Column] = []
    acc = F.lit(True)
    for s in specs:
        p = compile_spec(s)
        if p is not None:
            acc = acc & F.coalesce(p, F.lit(False))
        conds.append(acc)
    aggs = [F.count(F.lit(1)).alias("n0")]
    aggs += [F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(f"n{i + 1}") for i, c in enumerate(conds)]
    counts = df.agg(*aggs)
    rows = [F.struct(F.lit(0).alias("step"), F.lit("(all)").alias("attribute"),
                     F.lit(True).alias("applied"), F.col("n0").alias("n_before"),
                     F.col(f"n{len(specs)}").alias("n_after"))]
    for i, s in enumerate(specs):
        rows.append(F.struct(F.lit(i + 1).alias("step"),
                             F.lit(s.attribute or "").alias("attribute"),
                             F.lit(s.is_active()).alias("applied"),
                             F.col(f"n{i}").alias("n_before"), F.col(f"n{i + 1}").alias("n_after")))
    return counts.select(F.inline(F.array(*rows)))


def filter_semi(df: DataFrame, attribute: str, values: DataFrame, value_col: str = "value",
                empty_keeps_all: bool = False) -> DataFrame:
    """F1 with the value set as a table: rows whose value is in it. An
    empty table keeps nothing, or everything with ``empty_keeps_all`` (the
    rule of an empty filter, F4).

    The value table is broadcast only when it is known to be small; otherwise
    both sides shuffle on the value."""
    vals = small_or_whole(values.select(F.col(value_col).cast("string").alias("_v")).distinct())
    if empty_keeps_all and vals.isEmpty():
        return df
    return df.join(vals, norm_category(F.col(attribute)) == F.col("_v"), "left_semi")
