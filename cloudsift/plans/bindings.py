"""Bindings of the supplied test tables to the point-table schema.

`cells` is the main binding (one row per event); the SQL text in
``CELLS_SQL`` is its DuckDB twin and is used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators.ranks import assign_shards, shuffle_rank
from cloudsift.roles import BINDING_ROLES, Roles
from cloudsift.session import BROADCAST_MAX_ROWS, small_or_whole

SEED = 42
N_SHARDS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid, ts, uid = F.col("event_id"), F.col("ts"), F.col("user_id")
    null = F.lit(None)
    return ev.select(
        eid.alias("row_id"),
        eid.cast("string").alias("cell"),
        F.col("value").alias("x"),
        uid.cast("double").alias("y"),
        (F.hour(ts) * 60 + F.minute(ts)).cast("double").alias("z"),
        F.when(eid % 50 == 0, null.cast("double")).otherwise(F.col("value")).alias("t"),
        F.when(eid % 97 == 0, null.cast("smallint"))
        .otherwise(F.dayofmonth(ts).cast("smallint")).alias("time_rank"),
        F.when(eid % 23 == 0, null.cast("string")).when(eid % 29 == 0, F.lit(""))
        .otherwise(F.col("event_type")).alias("structure"),
        F.concat(F.lit("HF"), (uid % 37).cast("string")).alias("hf"),
        F.concat(F.lit("S"), (eid % 3).cast("string")).alias("sample"),
        F.when(F.hour(ts) < 12, F.lit("AM")).otherwise(F.lit("PM")).alias("grp"),
        F.regexp_extract(F.col("props"), "[0-9]+", 0).alias("cell_type"),
        F.concat(F.lit("g"), uid.cast("string")).alias("gene"),
    )


def points(spark: SparkSession, sf_dir: str, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """cells + row_idx (seeded permutation, W1) + shard."""
    ranked = shuffle_rank(cells(spark, sf_dir), key="cell", tiebreak="row_id", seed=seed)
    return assign_shards(ranked, n_shards)


_written: dict[tuple, str] = {}


def shards_path(spark: SparkSession, sf_dir: str) -> str:
    """The ingest output (S3) for this table set: cells → W1 → W2 → sharded
    Parquet in the shared folder, written once per application."""
    from cloudsift.session import shared_dir
    from cloudsift.sources.shards import write_shards

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = shared_dir(spark, "shards")
        write_shards(points(spark, sf_dir).drop("n_rows"), path)
        _written[key] = path
    return _written[key]


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All written shards (what the viewer loads at 100 %)."""
    return spark.read.parquet(shards_path(spark, sf_dir))


def loaded(spark: SparkSession, sf_dir: str, k: int = N_SHARDS) -> DataFrame:
    """The first k shards (k * 10 % sample; default all): partition pruning on
    the scan."""
    return sharded(spark, sf_dir).where(F.col("shard") <= k)


ROLES = BINDING_ROLES

# Volume binding: lineitem ⋈ part (no unique key in lineitem, so the row key
# is (file, row index in file), as a raw-file ingest keys by (file, line)).
ITEM_ROLES = Roles(
    coords=("x", "y", "z", "year_rank"),
    categorical=("returnflag", "linestatus", "brand", "ptype"),
    continuous=("discount",),
    frame_key="year_rank",
    row_key="item_key",
    id_col="item_key",
    default_axes=("x", "y", "z"),
    float_cols=("x", "y", "z", "discount"),
    smallint_cols=("year_rank",),
)


def _lineitem_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("_metadata.file_name"), F.lit(":"), F.col("_metadata.row_index").cast("string"))
        .alias("item_key"),
        "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus",
        "l_shipdate")


def _with_part(spark: SparkSession, sf_dir: str, li: DataFrame, max_broadcast_rows: int,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Attach brand and type (a left join: one partner per part key, so the
    row count is unchanged)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    # part grows with the scale factor: broadcast only under a measured bound
    part = small_or_whole(part, max_broadcast_rows)
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.select(
        *keep, "item_key", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"),
        F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("z"),
        F.col("l_discount").alias("discount"), F.year("l_shipdate").cast("smallint").alias("year_rank"),
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"))


def items(spark: SparkSession, sf_dir: str, max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    return _with_part(spark, sf_dir, _lineitem_keyed(spark, sf_dir), max_broadcast_rows)


def item_points(spark: SparkSession, sf_dir: str, n_rows: int | None = None,
                max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rank lineitem rows first (the count pass reads only the key), then
    attach part: the join does not change the row count."""
    ranked = shuffle_rank(_lineitem_keyed(spark, sf_dir), key="item_key", seed=SEED, n_rows=n_rows)
    sharded = assign_shards(ranked, N_SHARDS)
    return _with_part(spark, sf_dir, sharded, max_broadcast_rows, keep=("row_idx", "shard"))


CELLS_SQL = """SELECT event_id AS row_id, CAST(event_id AS VARCHAR) AS cell,
  value AS x, CAST(user_id AS DOUBLE) AS y,
  CAST(hour(ts)*60+minute(ts) AS DOUBLE) AS z,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS t,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(day(ts) AS SMALLINT) END AS time_rank,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '' ELSE event_type END AS structure,
  concat('HF', CAST(user_id % 37 AS VARCHAR)) AS hf,
  concat('S', CAST(event_id % 3 AS VARCHAR)) AS sample,
  CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS grp,
  regexp_extract(props, '[0-9]+', 0) AS cell_type,
  concat('g', CAST(user_id AS VARCHAR)) AS gene
FROM events"""

# DuckDB twin of ``items`` without its row key.
ITEMS_SQL = """SELECT l_extendedprice AS x, l_quantity AS y,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS z,
  l_discount AS discount, CAST(year(l_shipdate) AS SMALLINT) AS year_rank, l_returnflag AS returnflag,
  l_linestatus AS linestatus, p_brand AS brand, p_type AS ptype
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""

# WITH-clause prefix defining cells, points (row_idx, shard), loaded (all
# shards: the 100 % load) and loaded1 (shard 1: the first 10 % view).
POINTS_CTE = f"""WITH cells AS ({CELLS_SQL}),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat('{SEED}:', cell, ':', CAST(row_id AS VARCHAR))), row_id) - 1 AS row_idx,
  count(*) OVER () AS n_rows FROM cells),
points AS (SELECT * EXCLUDE (n_rows),
  CAST(CASE WHEN n_rows < {N_SHARDS} THEN {N_SHARDS}
       ELSE least(row_idx // (n_rows // {N_SHARDS}), {N_SHARDS - 1}) + 1 END AS INTEGER) AS shard
  FROM ranked),
loaded AS (SELECT * FROM points),
loaded1 AS (SELECT * FROM points WHERE shard <= 1)"""
