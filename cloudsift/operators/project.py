"""Projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.functions.text import fixed
from cloudsift.operators.filters import norm_category
from cloudsift.roles import Roles


def coord(df: DataFrame, name: str) -> Column:
    """A coordinate option as double; null or a column the table lacks → 0."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def map_axes(df: DataFrame, roles: Roles, x: str | None = None, y: str | None = None,
             z: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any three coordinate options as display x/y/z (by position)."""
    axes = (x or roles.default_axes[0], y or roles.default_axes[1], z or roles.default_axes[2])
    for a in axes:
        if a not in roles.coords:
            raise ValueError(f"{a!r} is not a coordinate option")
    kept = [c for c in keep if c in df.columns]
    return df.select(*kept, *(coord(df, a).alias(n) for a, n in zip(axes, ("x", "y", "z"))),
                     *[c for c in df.columns if c not in kept and c not in ("x", "y", "z")])


def raw_coords(df: DataFrame, roles: Roles) -> DataFrame:
    """Every coordinate option as raw_<name>, null → 0."""
    return df.select("*", *(coord(df, c).alias(f"raw_{c}") for c in roles.coords if c in df.columns))


def normalise_categories(df: DataFrame, roles: Roles) -> DataFrame:
    """Categoricals as string, null → ''."""
    return df.withColumns({c: norm_category(F.col(c)) for c in roles.categorical if c in df.columns})


def with_point_details(df: DataFrame, roles: Roles, x=None, y=None, z=None,
                       out: str = "details") -> DataFrame:
    """P5: one text line per point: chosen coordinates to 2 places, non-empty
    categoricals `name: value`, non-null continuous to 4 places; '; ' between."""
    axes = (x or roles.default_axes[0], y or roles.default_axes[1], z or roles.default_axes[2])
    parts = [F.concat_ws(", ", *(F.concat(F.lit(f"{a}: "), fixed(coord(df, a), 2)) for a in axes))]
    for c in roles.categorical:
        if c in df.columns:
            v = F.col(c).cast("string")
            parts.append(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{c}: "), v)))
    for c in roles.continuous:
        if c in df.columns:
            parts.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), fixed(c, 4))))
    return df.withColumn(out, F.concat_ws("; ", *parts))


def late_column(df: DataFrame, source: DataFrame, column: str, key: str = "row_idx") -> DataFrame:
    """Attach one more column read separately, matched by row key.
    Rows without a partner keep null (left join; no reliance on file order)."""
    extra = source.select(key, column)
    return df.join(extra, key, "left")
