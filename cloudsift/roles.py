"""Column roles of a point table (the only user-editable configuration)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    coords: tuple[str, ...]
    categorical: tuple[str, ...]
    continuous: tuple[str, ...]
    frame_key: str | None
    row_key: str | None
    id_col: str | None
    default_axes: tuple[str, str, str]
    float_cols: tuple[str, ...] = field(default=())
    smallint_cols: tuple[str, ...] = field(default=())

    def attributes(self) -> tuple[str, ...]:
        return self.categorical + self.continuous

# The reference's column roles and narrow-type lists.
REFERENCE_ROLES = Roles(
    coords=("x", "y", "z", "transformedX", "transformedY", "transformedZ",
            "Adj_transformedZ", "X_shifted", "TimeRank"),
    categorical=("Structure", "HF", "Sample", "Group", "CellType", "Gene"),
    continuous=("Time",),
    frame_key="TimeRank",
    row_key=None,
    id_col="cell",
    default_axes=("transformedX", "transformedZ", "transformedY"),
    float_cols=("x", "y", "z", "transformedX", "transformedY", "transformedZ",
                "X_shifted", "Time"),
    smallint_cols=("TimeRank",),
)

# Roles of the `cells` binding view over the supplied test tables.
BINDING_ROLES = Roles(
    coords=("x", "y", "z", "time_rank"),
    categorical=("structure", "hf", "sample", "grp", "cell_type", "gene"),
    continuous=("t",),
    frame_key="time_rank",
    row_key="row_id",
    id_col="cell",
    default_axes=("x", "y", "z"),
    float_cols=("x", "y", "z", "t"),
    smallint_cols=("time_rank",),
)


def essential_columns(roles: Roles, df: DataFrame, extra: tuple[str, ...] = ()) -> list[str]:
    """The column set of the first view: coordinate options present in the
    table, continuous attributes, the first categorical, plus bookkeeping."""
    present = set(df.columns)
    cols = [c for c in extra if c in present]
    cols += [c for c in roles.coords if c in present and c not in cols]
    cols += [c for c in roles.continuous if c in present and c not in cols]
    if roles.categorical and roles.categorical[0] in present and roles.categorical[0] not in cols:
        cols.append(roles.categorical[0])
    return cols


def attribute_catalog(df: DataFrame, roles: Roles) -> DataFrame:
    """Every selectable attribute and coordinate option with its role, type,
    the default axis it serves, and its statistics from the data in one scan:
    the domain size of a categorical (A3), min/max of a number (A4). Numbers
    get no distinct count (that would shuffle every distinct double). All
    statistics are doubles (one table of mixed statistics)."""
    dtypes = dict(df.dtypes)
    axes = {name: axis for axis, name in zip(("x", "y", "z"), roles.default_axes)}
    entries = []
    for name in roles.categorical:
        entries.append((name, "categorical"))
    for name in roles.continuous:
        entries.append((name, "continuous"))
    for name in roles.coords:
        entries.append((name, "coordinate"))
    aggs = []
    for i, (name, role) in enumerate(entries):
        if name in dtypes:
            c = F.col(name)
            if role == "categorical":
                stats = [F.count_distinct(c), F.lit(None).cast("double"), F.lit(None).cast("double")]
            else:
                v = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
                stats = [F.lit(None).cast("bigint"), F.min(v), F.max(v)]
        else:
            stats = [F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("double")]
        aggs.append(F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("attribute"), F.lit(role).alias("role"),
            F.lit(dtypes.get(name, "absent")).alias("data_type"),
            F.lit(axes.get(name)).cast("string").alias("default_axis"),
            stats[0].cast("double").alias("n_distinct"), stats[1].alias("min_value"),
            stats[2].alias("max_value")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
