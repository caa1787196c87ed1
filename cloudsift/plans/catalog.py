"""The query catalog: every operator of the inventory bound to the supplied
test tables, as a Spark plan (``QUERIES``) and, where the result is
engine-independent, an equivalent DuckDB SQL text (``ORACLE``).

Every query reads the given tables (through the ``cells`` binding over
``events``) or data Spark derived from them (shards, text files written into
the shared checkpoint folder) and runs over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudsift.functions import color as C
from cloudsift.functions.text import fixed, grouped, part_name, percent_ratio
from cloudsift.operators import bitmaps as BM
from cloudsift.operators import extent as E
from cloudsift.operators import filters as FL
from cloudsift.operators import frames as FR
from cloudsift.operators import legend as LG
from cloudsift.operators import palette as PL
from cloudsift.operators import permute as PM
from cloudsift.operators import pick as PK
from cloudsift.operators import profile as PF
from cloudsift.operators import project as PJ
from cloudsift.operators import ranks as RK
from cloudsift.operators import sketches as SK
from cloudsift.operators.export import export_points, render_cap, render_table
from cloudsift.plans import bindings as B
from cloudsift.plans.ingest import run_ingest
from cloudsift.plans.sqlparts import (TAN_HALF_FOV, sql_gradient_rgb, sql_hash, sql_hash_rgb,
                                      sql_permutation, sql_rgb)
from cloudsift.roles import attribute_catalog, essential_columns
from cloudsift.session import shared_dir
from cloudsift.sources import shards as SH
from cloudsift.sources import tables as TB
from cloudsift.sources import text_split as TS
from cloudsift.streaming import progressive as PG

R = B.ROLES
P = B.POINTS_CTE
Q = Callable[[SparkSession, str], DataFrame]

# The filter list of the exploration queries: a categorical filter (with ''),
# a range filter, a filter without attribute and an empty value set (both
# skipped).
FILTERS = [
    FL.FilterSpec(1, "structure", "categorical", ("click", "view", "")),
    FL.FilterSpec(2, "t", "continuous", None, (10.0, 400.0)),
    FL.FilterSpec(3),
    FL.FilterSpec(4, "sample", "categorical", ()),
]
FILTER_SQL = "coalesce(structure, '') IN ('click', 'view', '') AND t BETWEEN 10.0 AND 400.0"
CAT_ATTRS = R.categorical

QUERIES: dict[str, Q] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Q) -> Q:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- helpers

def loaded(spark, sf, k: int = B.N_SHARDS) -> DataFrame:
    """Loaded shards; the exploration queries load all (whole table), the
    sampling features pass their own k."""
    return B.loaded(spark, sf, k)


def visible(spark, sf, k: int = B.N_SHARDS) -> DataFrame:
    return FL.filter_all(loaded(spark, sf, k), FILTERS)


def cte(*parts: str) -> str:
    """POINTS_CTE plus more named CTEs."""
    return P + "".join(f",\n{p}" for p in parts)


VISIBLE_CTE = f"visible AS (SELECT * FROM loaded WHERE {FILTER_SQL})"
VISIBLE1_CTE = f"visible1 AS (SELECT * FROM loaded1 WHERE {FILTER_SQL})"
VISIBLE_ALL_CTE = f"visible_all AS (SELECT * FROM points WHERE {FILTER_SQL})"


def domain_sql(src: str, attrs=CAT_ATTRS) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS value, count(*) AS n FROM {src} "
        f"WHERE {a} IS NOT NULL GROUP BY {a}" for a in attrs)


_cache: dict[tuple, str] = {}
ROWS_PER_TEXT_FILE = 250_000        # gzip is not split: a file is a task of its reader


def _text_files(spark: SparkSession, sf: str) -> int:
    """Tasks that write the cells as text, by their number."""
    return max(1, -(-B.cells(spark, sf).count() // ROWS_PER_TEXT_FILE))


def _written(spark: SparkSession, sf: str, what: str) -> str:
    """Data derived from the tables and written once per session into the
    shared folder: 'shards' (S3 output), 'tsv' (cells as gzipped TSV files),
    'lines' (gzipped TSV files with header in row_id order), 'by-sample' (a
    folder of files per value of sample)."""
    if what == "shards":
        return B.shards_path(spark, sf)
    key = (spark.sparkContext.applicationId, sf, what)
    if key in _cache:
        return _cache[key]
    if what == "tsv":
        path = shared_dir(spark, "tsv")
        (B.cells(spark, sf).write.mode("overwrite").option("sep", "\t").option("header", True)
         .option("compression", "gzip").csv(path))
    elif what == "lines":
        path = shared_dir(spark, "lines-in")
        (B.cells(spark, sf).repartitionByRange(max(8, _text_files(spark, sf)), "row_id").sortWithinPartitions("row_id").write.mode("overwrite")
         .option("sep", "\t").option("header", True).option("compression", "gzip").csv(path))
    elif what == "by-sample":
        path = shared_dir(spark, "by-sample")
        (B.cells(spark, sf).repartition(_text_files(spark, sf)).withColumn("file", F.col("sample")).write.mode("overwrite")
         .partitionBy("file").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path))
    else:
        raise ValueError(what)
    _cache[key] = path
    return path


# ================================================================ flagship

FIRST_VIEW_SQL = sql_hash_rgb(
    cte(VISIBLE1_CTE) + """
SELECT row_idx, CAST(row_number() OVER (ORDER BY row_idx) - 1 AS BIGINT) AS ordinal,
  CAST(coalesce(x, 0.0) AS FLOAT) AS x, CAST(coalesce(y, 0.0) AS FLOAT) AS y,
  CAST(coalesce(z, 0.0) AS FLOAT) AS z, structure FROM visible1""", "structure")
FIRST_VIEW_SQL = f"SELECT row_idx, ordinal, x, y, z, r, g, b FROM ({FIRST_VIEW_SQL}) f"


@register("first_view", FIRST_VIEW_SQL)
def first_view(spark, sf):
    """First 10 % sample, filters, coloured by structure through the palette
    of the loaded domain, render-ready."""
    ld = loaded(spark, sf, 1)
    vis = FL.filter_all(ld, FILTERS)
    pal = PL.build_palette(PF.attribute_domain(ld, R, ("structure",)), "structure")
    return render_table(vis, R, "structure", palette=pal)


# ================================================================ sources

@register("read_tables", """WITH c AS (""" + B.CELLS_SQL + """)
SELECT row_id, cell, x, y, z, t, CAST(time_rank AS DOUBLE) AS time_rank,
  CASE WHEN structure = '' THEN NULL ELSE structure END AS structure, hf, sample, grp,
  cell_type, gene FROM c""")
def q_read_tables(spark, sf):
    """The cells written as gzipped TSV, read back (types inferred, missing
    tokens and empty fields null; ids and categories stay text)."""
    path = _written(spark, sf, "tsv")
    return TB.read_tables(spark, f"{path}/*.csv.gz", text_columns=(*R.categorical, R.id_col)).select(
        "row_id", "cell", "x", "y", "z", "t", "time_rank", "structure", "hf", "sample", "grp",
        "cell_type", "gene")


@register("read_unlike_headers", """WITH c AS (""" + B.CELLS_SQL + """)
SELECT row_id, concat(cell, 'd') AS cell, y, x, CASE WHEN grp = 'PM' THEN gene END AS gene,
  concat('line one', chr(10), 'line "two" ', cell) AS note FROM c""")
def q_read_unlike_headers(spark, sf):
    """Two sets of files whose headers have other columns and another
    order, ids like 12d, quoted headers, quotes and line breaks inside fields;
    columns meet by name."""
    out = shared_dir(spark, "unlike")
    note = F.concat(F.lit('line one\nline "two" '), F.col("cell"))
    c = B.cells(spark, sf).withColumns({"note": note, "cell": F.concat("cell", F.lit("d"))})
    for name, rows, cols in (("a", "AM", ["x", "cell", "note", "y", "row_id"]), ("b", "PM", ["row_id", "gene", "y", "x", "cell", "note"])):
        (c.where(F.col("grp") == rows).select(*cols).write.option("sep", "\t").option("header", True).option("quoteAll", True)
         .option("escape", '"').option("compression", "gzip").csv(f"{out}/{name}"))
    got = TB.read_tables(spark, f"{out}/*/*.csv.gz", text_columns=("cell",))
    return got.select("row_id", "cell", "y", "x", "gene", "note")


INGEST_SQL = ("WITH RECURSIVE c AS (" + B.CELLS_SQL + """),
numbered AS (SELECT row_id, gene, row_number() OVER (ORDER BY row_id) - 1 AS num FROM c),
""" + sql_permutation("numbered", "row_id, gene", B.SEED))


@register("ingest_raw", INGEST_SQL + f"""
SELECT row_id, gene, hf, row_idx, CAST(CASE WHEN n < {B.N_SHARDS} THEN {B.N_SHARDS} ELSE least(row_idx // (n // {B.N_SHARDS}), {B.N_SHARDS - 1}) + 1 END AS INTEGER) AS shard
FROM permuted JOIN c USING (row_id, gene), total WHERE row_id % 3 > 0""")
def q_ingest_raw(spark, sf):
    """The whole ingest job over gzipped text files: types, permutation of the
    line numbers, shards; then a filter and a join on an inferred number."""
    done = run_ingest(spark, f"{_written(spark, sf, 'lines')}/*.gz", shared_dir(spark, "ingest"), R, B.N_SHARDS, B.SEED)
    rows = spark.read.parquet(done.path).where(F.col("row_id") % 3 > 0).select("row_id", "gene", "row_idx", "shard")
    return rows.join(B.cells(spark, sf).select("row_id", "hf"), "row_id")


@register("normalise_types", "WITH c AS (" + B.CELLS_SQL + """)
SELECT row_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z,
  CAST(t AS FLOAT) AS t, CAST(CAST(time_rank AS SMALLINT) AS DOUBLE) AS time_rank, structure, hf, sample, grp,
  cell_type, gene, 'x:float,y:float,z:float,t:float,time_rank:smallint' AS narrowed_types FROM c""")
def q_normalise_types(spark, sf):
    """coordinates/continuous → float, frame key → smallint, categoricals →
    string. The frame key's values are shown as double (a nullable integer
    column converts differently per engine), its narrowed type in
    ``narrowed_types``, read from the normalised schema."""
    df = TB.normalise_types(B.cells(spark, sf), R)
    types = dict(df.dtypes)
    narrowed = ",".join(f"{c}:{types[c]}" for c in ("x", "y", "z", "t", "time_rank"))
    return df.select("row_id", "x", "y", "z", "t", F.col("time_rank").cast("double").alias("time_rank"),
                     *CAT_ATTRS, F.lit(narrowed).alias("narrowed_types"))


@register("write_shards", P + "\nSELECT row_id, row_idx, shard FROM points")
def q_write_shards(spark, sf):
    """S3: shuffled, sharded Parquet dataset, read back."""
    return spark.read.parquet(_written(spark, sf, "shards")).select("row_id", "row_idx", "shard")


@register("replace_outputs", P + "\nSELECT shard, count(*) AS n FROM points GROUP BY shard")
def q_replace_outputs(spark, sf):
    """Writing twice to the same dataset replaces it (no duplicates)."""
    path = shared_dir(spark, "replace")
    pts = B.points(spark, sf).drop("n_rows")
    SH.write_shards(pts, path)
    SH.write_shards(pts, path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@register("read_shards", P + "\nSELECT row_idx, x, structure FROM points WHERE shard <= 3")
def q_read_shards(spark, sf):
    """First 3 shards, three columns (partition + column pruning)."""
    return SH.read_shards(spark, _written(spark, sf, "shards"), 3, ["row_idx", "x", "structure"])


@register("sample_rate", P + "\nSELECT row_idx, t FROM points WHERE shard <= 4")
def q_sample_rate(spark, sf):
    """35 % → 4 shards."""
    return SH.sample_rate(spark, _written(spark, sf, "shards"), 35, ["row_idx", "t"])


N_PARTS = 120

SPLIT_SQL = """WITH c AS (""" + B.CELLS_SQL + f"""),
n AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM c),
k AS (SELECT count(*) AS total FROM c),
p AS (SELECT n.*, total // {N_PARTS} AS base, total % {N_PARTS} AS rem FROM n, k),
q AS (SELECT row_id, pos, CAST(CASE WHEN pos < rem * (base + 1) THEN pos // (base + 1)
      ELSE rem + (pos - rem * (base + 1)) // base END + 1 AS INTEGER) AS part FROM p),
d AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY pos) AS BIGINT) AS line, row_id FROM q)
SELECT part, line, CAST(row_id AS VARCHAR) AS first_field FROM d
UNION ALL SELECT DISTINCT part, CAST(0 AS BIGINT) AS line, 'row_id' AS first_field FROM d"""


def _split(spark, sf, name: str) -> str:
    out = shared_dir(spark, name)
    TS.split_with_header(spark, f"{_written(spark, sf, 'lines')}/*.gz", out, N_PARTS, every_file_has_header=True)
    return out


@register("split_with_header", SPLIT_SQL)
def q_split_with_header(spark, sf):
    """The cells' lines (several gzipped TSV files, one text) split into
    120 parts with the header repeated; read back as (part, line in part,
    first field of the line)."""
    lines = TS.read_parts(spark, _split(spark, sf, "split"))
    per_file = Window.partitionBy("file").orderBy("g")
    return lines.select(
        F.regexp_extract("file", r"\.part(\d+)\.", 1).cast("int").alias("part"),
        (F.row_number().over(per_file) - 1).cast("bigint").alias("line"),
        F.split("value", "\t").getItem(0).alias("first_field"))


EXPORT_SQL = sql_hash_rgb(
    cte(VISIBLE_CTE) + """
SELECT row_idx, CAST(row_number() OVER (ORDER BY row_idx) - 1 AS BIGINT) AS ordinal,
  CAST(coalesce(x, 0.0) AS FLOAT) AS x, CAST(coalesce(y, 0.0) AS FLOAT) AS y,
  CAST(coalesce(z, 0.0) AS FLOAT) AS z, gene FROM visible""", "gene")
EXPORT_SQL = f"SELECT row_idx, ordinal, x, y, z, r, g, b FROM ({EXPORT_SQL}) f"


@register("export_points", EXPORT_SQL)
def q_export_points(spark, sf):
    """The render-ready table of all loaded visible rows written as
    Parquet and read back."""
    path = shared_dir(spark, "export")
    export_points(render_table(visible(spark, sf), R, "gene"), path)
    return spark.read.parquet(path)


@register("late_columns", P + "\nSELECT row_idx, x, structure, gene FROM loaded")
def q_late_columns(spark, sf):
    """One more column for the loaded rows — just a wider projection of
    the same pruned scan."""
    ess = loaded(spark, sf).select("row_idx", "x", "structure")
    return loaded(spark, sf).select(*ess.columns, "gene")


# ================================================================ projections

@register("map_axes", P + """
SELECT row_idx, coalesce(CAST(time_rank AS DOUBLE), 0.0) AS x, coalesce(x, 0.0) AS y,
  coalesce(y, 0.0) AS z FROM loaded""")
def q_map_axes(spark, sf):
    """time_rank, x, y as the display axes (null → 0)."""
    m = PJ.map_axes(loaded(spark, sf), R, "time_rank", "x", "y", keep=("row_idx",))
    return m.select("row_idx", "x", "y", "z")


@register("raw_coords", P + """
SELECT row_idx, coalesce(x, 0.0) AS raw_x, coalesce(y, 0.0) AS raw_y, coalesce(z, 0.0) AS raw_z,
  coalesce(CAST(time_rank AS DOUBLE), 0.0) AS raw_time_rank FROM loaded""")
def q_raw_coords(spark, sf):
    """Every coordinate option as raw_<name>."""
    return PJ.raw_coords(loaded(spark, sf), R).select(
        "row_idx", "raw_x", "raw_y", "raw_z", "raw_time_rank")


def _catalog_sql2() -> str:
    entries = ([(a, "categorical") for a in R.categorical] + [(a, "continuous") for a in R.continuous]
               + [(a, "coordinate") for a in R.coords])
    types = {"t": "double", "x": "double", "y": "double", "z": "double", "time_rank": "smallint"}
    rows = []
    for i, (a, role) in enumerate(entries):
        ax = f"'{a}'" if a in ("x", "y", "z") else "CAST(NULL AS VARCHAR)"
        lo = "CAST(NULL AS DOUBLE)" if role == "categorical" else f"min(CAST({a} AS DOUBLE))"
        hi = "CAST(NULL AS DOUBLE)" if role == "categorical" else f"max(CAST({a} AS DOUBLE))"
        nd = f"CAST(count(DISTINCT {a}) AS DOUBLE)" if role == "categorical" else "CAST(NULL AS DOUBLE)"
        rows.append(f"SELECT {i} AS ord, '{a}' AS attribute, '{role}' AS role, "
                    f"'{types.get(a, 'string')}' AS data_type, {ax} AS default_axis, "
                    f"{nd} AS n_distinct, {lo} AS min_value, "
                    f"{hi} AS max_value FROM points")
    return P + "\n" + " UNION ALL ".join(rows)


@register("attribute_catalog", _catalog_sql2())
def q_attribute_catalog(spark, sf):
    """Selectable attributes and coordinate options with role, type,
    default axis and statistics."""
    return attribute_catalog(B.sharded(spark, sf), R).select(
        F.col("ord").cast("int").alias("ord"), "attribute", "role", "data_type", "default_axis",
        "n_distinct", "min_value", "max_value")


@register("normalise_categories", P + "\nSELECT row_idx, " + ", ".join(
    f"coalesce({a}, '') AS {a}" for a in CAT_ATTRS) + " FROM loaded")
def q_normalise_categories(spark, sf):
    """Categoricals as strings, null → ''."""
    return PJ.normalise_categories(loaded(spark, sf), R).select("row_idx", *CAT_ATTRS)


def _details_sql() -> str:
    coords = ", ".join(f"concat('{a}: ', printf('%.2f', coalesce({a}, 0.0)))" for a in ("x", "y", "z"))
    cats = ", ".join(f"CASE WHEN {a} IS NOT NULL AND {a} <> '' THEN concat('{a}: ', {a}) END" for a in CAT_ATTRS)
    return (P + f"\nSELECT row_idx, concat_ws('; ', concat_ws(', ', {coords}), {cats}, "
            f"CASE WHEN t IS NOT NULL THEN concat('t: ', printf('%.4f', t)) END) AS details FROM loaded")


@register("point_details", _details_sql())
def q_point_details(spark, sf):
    """P5: one text line per point."""
    return PJ.with_point_details(loaded(spark, sf), R).select("row_idx", "details")


@register("essential_columns", P + "\nSELECT row_idx, x, y, z, CAST(time_rank AS DOUBLE) AS time_rank, t, structure FROM loaded")
def q_essential_columns(spark, sf):
    """The column set of the first view (the frame key shown as a
    coordinate value, double)."""
    ld = loaded(spark, sf)
    cols = essential_columns(R, ld, extra=("row_idx",))
    return ld.select(*(F.col(c).cast("double").alias(c) if c == R.frame_key else F.col(c) for c in cols))


@register("color_encode", sql_hash_rgb(P + "\nSELECT row_idx, gene FROM loaded", "gene"))
def q_color_encode(spark, sf):
    """Colour of each loaded row by gene, through the values' palette."""
    ld = loaded(spark, sf).select("row_idx", "gene")
    return PL.color_encode(ld, "gene", R)


# ================================================================ filters

@register("filter_in", P + "\nSELECT row_idx, structure FROM loaded WHERE coalesce(structure, '') IN ('click', '')")
def q_filter_in(spark, sf):
    """structure in {click, ''} (null counts as '')."""
    return loaded(spark, sf).where(FL.filter_in("structure", ("click", ""))).select("row_idx", "structure")


@register("filter_range", P + "\nSELECT row_idx, t FROM loaded WHERE t BETWEEN 10.0 AND 400.0")
def q_filter_range(spark, sf):
    """10 <= t <= 400, null rejected."""
    return loaded(spark, sf).where(FL.filter_range("t", 10.0, 400.0)).select("row_idx", "t")


@register("filter_all", cte(VISIBLE_CTE) + "\nSELECT row_idx, row_id FROM visible")
def q_filter_all(spark, sf):
    """the whole filter list."""
    return visible(spark, sf).select("row_idx", "row_id")


@register("filter_skip_rule", P + "\nSELECT row_idx FROM loaded")
def q_filter_skip_rule(spark, sf):
    """filters without attribute, with an empty set, without range: all kept."""
    specs = [FL.FilterSpec(1), FL.FilterSpec(2, "sample", "categorical", ()),
             FL.FilterSpec(3, "t", "continuous", None, None), FL.FilterSpec(4, "gene", None, ("g1",))]
    return FL.filter_all(loaded(spark, sf), specs).select("row_idx")


@register("filter_default", P + """
SELECT row_idx FROM loaded
WHERE coalesce(structure, '') IN (SELECT structure FROM loaded WHERE structure IS NOT NULL)
  AND t BETWEEN (SELECT min(t) FROM loaded) AND (SELECT max(t) FROM loaded)""")
def q_filter_default(spark, sf):
    """default filters: all values of structure's domain (a table, J4) and
    the full range of t."""
    ld = loaded(spark, sf)
    dom = PF.attribute_domain(ld, R, ("structure",))
    rng = PF.attribute_range(ld, R, ("t",))
    lo, hi = PL.range_bounds(rng, "t")
    kept = FL.filter_semi(ld, "structure", dom).where(F.col("t").between(lo, hi))
    return kept.select("row_idx")


@register("filter_range_push", P + """,
r AS (SELECT sample, min(t) AS lo, max(t) AS hi FROM loaded WHERE t IS NOT NULL GROUP BY sample)
SELECT sample, 100.0 AS min_lo, greatest(100.0, hi) AS min_hi, least(50.0, lo) AS max_lo, 50.0 AS max_hi FROM r""")
def q_filter_range_push(spark, sf):
    """per-sample range specs; move the min end to 100 and the max end to 50."""
    r = loaded(spark, sf).where(F.col("t").isNotNull()).groupBy("sample").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"))
    a_lo, a_hi = FL.push_range_columns(F.col("lo"), F.col("hi"), F.lit("min"), F.lit(100.0))
    b_lo, b_hi = FL.push_range_columns(F.col("lo"), F.col("hi"), F.lit("max"), F.lit(50.0))
    return r.select("sample", a_lo.alias("min_lo"), a_hi.alias("min_hi"), b_lo.alias("max_lo"),
                    b_hi.alias("max_hi"))


FRAMES_CTE = """frames AS (SELECT time_rank, CAST(row_number() OVER (ORDER BY time_rank) - 1 AS INTEGER) AS frame_idx,
  CAST(count(*) OVER () AS INTEGER) AS n_frames FROM (SELECT DISTINCT CAST(coalesce(time_rank, 0) AS INTEGER) AS time_rank FROM loaded) d)"""


@register("filter_frame", cte(VISIBLE_CTE, FRAMES_CTE) + """
SELECT row_idx, CAST(coalesce(time_rank, 0) AS INTEGER) AS time_rank FROM visible
WHERE coalesce(time_rank, 0) = (SELECT time_rank FROM frames WHERE frame_idx = 3)""")
def q_filter_frame(spark, sf):
    """visible rows of the frame at index 3."""
    frames = FR.frame_index(loaded(spark, sf), "time_rank")
    rank = FR.frame_at(frames, 3).select("time_rank").scalar()
    vis = visible(spark, sf)
    return vis.where(FR.frame_value("time_rank") == rank).select(
        "row_idx", FR.frame_value("time_rank").alias("time_rank"))


@register("filter_funnel", P + """,
c AS (SELECT count(*) AS n0,
  CAST(sum(CASE WHEN coalesce(coalesce(structure, '') IN ('click', 'view', ''), false) THEN 1 ELSE 0 END) AS BIGINT) AS n1,
  CAST(sum(CASE WHEN coalesce(coalesce(structure, '') IN ('click', 'view', ''), false)
                 AND coalesce(t BETWEEN 10.0 AND 400.0, false) THEN 1 ELSE 0 END) AS BIGINT) AS n2 FROM loaded)
SELECT 0 AS step, '(all)' AS attribute, true AS applied, n0 AS n_before, n2 AS n_after FROM c
UNION ALL SELECT 1, 'structure', true, n0, n1 FROM c
UNION ALL SELECT 2, 't', true, n1, n2 FROM c
UNION ALL SELECT 3, '', false, n2, n2 FROM c
UNION ALL SELECT 4, 'sample', false, n2, n2 FROM c""")
def q_filter_funnel(spark, sf):
    """F8: rows before → after each filter, and total → visible, one pass."""
    return FL.filter_funnel(loaded(spark, sf), FILTERS)


def _bitmaps(spark, sf) -> BM.BitmapIndex:
    """The bitmap index of the written shards, built once per application."""
    key = (spark.sparkContext.applicationId, sf, "bitmaps")
    if key not in _cache:
        _cache[key] = BM.build_index(loaded(spark, sf), R).path
    return BM.BitmapIndex(spark, _cache[key], CAT_ATTRS, R.continuous)


@register("bitmap_filter", cte(VISIBLE_CTE) + "\nSELECT row_idx FROM visible")
def q_bitmap_filter(spark, sf):
    """F3 from the bitmap index: the filter list as an AND of bitmaps."""
    return BM.bitmap_filter(_bitmaps(spark, sf), FILTERS)


@register("bitmap_funnel", ORACLE["filter_funnel"])
def q_bitmap_funnel(spark, sf):
    """F8 from the bitmap index: popcounts of the running ANDs."""
    return BM.bitmap_funnel(_bitmaps(spark, sf), FILTERS)


# ================================================================ joins

@register("palette_join", sql_hash_rgb(P + "\nSELECT row_idx, gene FROM loaded", "gene"))
def q_palette_join(spark, sf):
    """Palette built on the gene domain, joined to the rows."""
    ld = loaded(spark, sf)
    pal = PL.build_palette(PF.attribute_domain(ld, R, ("gene",)), "gene")
    return PL.palette_join(ld.select("row_idx", "gene"), "gene", pal)


OVERRIDES = {"click": "#ff0000", "view": "#00ff80"}


@register("palette_override", "SELECT attribute, value, "
          "CASE value WHEN 'click' THEN 255 WHEN 'view' THEN 0 ELSE r END AS r, "
          "CASE value WHEN 'click' THEN 0 WHEN 'view' THEN 255 ELSE g END AS g, "
          "CASE value WHEN 'click' THEN 0 WHEN 'view' THEN 128 ELSE b END AS b FROM ("
          + sql_hash_rgb(P + "\nSELECT DISTINCT 'structure' AS attribute, structure AS value FROM loaded "
                         "WHERE structure IS NOT NULL", "value") + ") o")
def q_palette_override(spark, sf):
    """User colours win over the generated palette."""
    ld = loaded(spark, sf)
    pal = PL.build_palette(PF.attribute_domain(ld, R, ("structure",)), "structure")
    return PL.palette_override(pal, PL.overrides_table(spark, "structure", OVERRIDES))


@register("column_merge", P + """
SELECT l.row_idx, l.x, e.gene FROM loaded l LEFT JOIN (SELECT row_idx, gene FROM points WHERE grp = 'AM') e
ON l.row_idx = e.row_idx""")
def q_column_merge(spark, sf):
    """A column read separately (only morning rows carry it) attached by
    row key; rows without a partner keep null."""
    pts = B.sharded(spark, sf)
    return PJ.late_column(pts.select("row_idx", "x"), pts.where(F.col("grp") == "AM"), "gene")


@register("filter_semi", P + """
SELECT row_idx, gene FROM loaded WHERE coalesce(gene, '') IN
  (SELECT gene FROM points WHERE grp = 'AM' AND gene IS NOT NULL AND sample = 'S1' AND hf < 'HF2')""")
def q_filter_semi(spark, sf):
    """Keep rows whose gene is in a value table (the genes of some rows)."""
    pts = B.sharded(spark, sf)
    some = pts.where((F.col("grp") == "AM") & (F.col("sample") == "S1") & (F.col("hf") < "HF2"))
    vals = PF.attribute_domain(some, R, ("gene",))
    return FL.filter_semi(loaded(spark, sf), "gene", vals).select("row_idx", "gene")


def _rays(vis: DataFrame) -> DataFrame:
    """Rays derived from the visible rows: from the fitted camera position
    through the box centre of each gene's points, and from that centre towards
    the camera and sideways (points lie behind these origins)."""
    f32 = {a: F.col(a).cast("float").cast("double") for a in "xyz"}
    pts = vis.select("gene", *(f32[a].alias(a) for a in "xyz"))
    cam = E.view_frame(E.bounding_box(pts))
    tgt = pts.groupBy(F.coalesce(F.col("gene"), F.lit("(null)")).alias("g")).agg(
        *(((F.min(a) + F.max(a)) * 0.5).alias(f"t{a}") for a in "xyz"))
    o = cam.select(F.struct("pos_x", "pos_y", "pos_z").alias("o")).scalar()  # one subquery
    r = tgt.select("g", o.pos_x.alias("ox"), o.pos_y.alias("oy"), o.pos_z.alias("oz"), "tx", "ty", "tz")
    down = r.select(F.concat(F.lit("d:"), "g").alias("ray_id"), "ox", "oy", "oz", "tx", "ty", "tz")
    up = r.select(F.concat(F.lit("u:"), "g").alias("ray_id"), F.col("tx").alias("ox"), F.col("ty").alias("oy"), F.col("tz").alias("oz"),
                  F.col("ox").alias("tx"), F.col("oy").alias("ty"), F.col("oz").alias("tz"))
    side = r.select(F.concat(F.lit("s:"), "g").alias("ray_id"), F.col("tx").alias("ox"), F.col("ty").alias("oy"), F.col("tz").alias("oz"),
                    (F.col("tx") + 1.0).alias("tx"), (F.col("ty") + 3.0).alias("ty"), (F.col("tz") - 2.0).alias("tz"))
    return PK.normalise_rays(down.union(up).union(side))


PICK_SQL = cte(VISIBLE_CTE, """pts AS (SELECT row_idx, gene, CAST(CAST(coalesce(x, 0.0) AS FLOAT) AS DOUBLE) AS x,
  CAST(CAST(coalesce(y, 0.0) AS FLOAT) AS DOUBLE) AS y, CAST(CAST(coalesce(z, 0.0) AS FLOAT) AS DOUBLE) AS z FROM visible)""",
               """box AS (SELECT (min(x) + max(x)) * 0.5 AS cx, (min(y) + max(y)) * 0.5 AS cy, (min(z) + max(z)) * 0.5 AS cz,
  max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz FROM pts)""",
               f"""cam AS (SELECT cx AS ox, cy AS oy, cz + greatest((greatest(sx, sy) / 2) / {TAN_HALF_FOV} * 1.1, sz * 1.5, 100.0) AS oz FROM box)""",
               """tg AS (SELECT coalesce(gene, '(null)') AS g, (min(x) + max(x)) * 0.5 AS tx,
  (min(y) + max(y)) * 0.5 AS ty, (min(z) + max(z)) * 0.5 AS tz FROM pts GROUP BY 1)""",
               """r0 AS (SELECT concat('d:', g) AS ray_id, ox, oy, oz, tx - ox AS dx, ty - oy AS dy, tz - oz AS dz FROM tg, cam
  UNION ALL SELECT concat('u:', g), tx, ty, tz, ox - tx, oy - ty, oz - tz FROM tg, cam
  UNION ALL SELECT concat('s:', g), tx, ty, tz, (tx + 1.0) - tx, (ty + 3.0) - ty, (tz - 2.0) - tz FROM tg)""",
               """rays AS (SELECT ray_id, ox, oy, oz, dx / sqrt(dx * dx + dy * dy + dz * dz) AS dx,
  dy / sqrt(dx * dx + dy * dy + dz * dz) AS dy, dz / sqrt(dx * dx + dy * dy + dz * dz) AS dz FROM r0
  WHERE sqrt(dx * dx + dy * dy + dz * dz) > 0)""",
               """h0 AS (SELECT ray_id, row_idx, x, y, z, ox, oy, oz, dx, dy, dz,
  (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS tt FROM pts, rays)""",
               """h1 AS (SELECT *, CASE WHEN tt < 0 THEN ox ELSE dx * tt + ox END AS cx,
  CASE WHEN tt < 0 THEN oy ELSE dy * tt + oy END AS cy, CASE WHEN tt < 0 THEN oz ELSE dz * tt + oz END AS cz FROM h0)""",
               """h2 AS (SELECT ray_id, row_idx, sqrt((ox - cx) * (ox - cx) + (oy - cy) * (oy - cy) + (oz - cz) * (oz - cz)) AS dist
  FROM h1 WHERE (cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z) < 25.0)""") + """
SELECT ray_id, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY dist, row_idx) AS rn FROM h2) w
WHERE rn = 1"""


@register("pick_points", PICK_SQL)
def q_pick_points(spark, sf):
    """Nearest visible point along each ray within 5 × point size."""
    vis = visible(spark, sf)
    pts = vis.select("row_idx", *(PJ.coord(vis, a).alias(a) for a in "xyz"))
    return PK.pick_points(pts, _rays(vis)).select("ray_id", "row_idx")


@register("fetch_rows", cte(VISIBLE_CTE, """o AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS ordinal FROM visible)""",
                          """f AS (SELECT coalesce(time_rank, 0) AS fr, count(*) AS n FROM visible GROUP BY 1)""",
                          """t AS (SELECT coalesce(sum(n) OVER (ORDER BY fr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM f)""") + """
SELECT ordinal, row_idx, x, y, z FROM o WHERE ordinal IN (SELECT ordinal FROM t)""")
def q_fetch_rows(spark, sf):
    """Rows at given ordinals of the rendered set (the first ordinal of
    each frame, from the frame counts)."""
    vis = visible(spark, sf)
    counts = FR.frame_counts(vis, "time_rank")
    before = Window.orderBy("time_rank").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("ordinal"))
    return PK.fetch_rows(vis, firsts).select("ordinal", "row_idx", "x", "y", "z")


# ================================================================ aggregations

@register("row_counts", "WITH c AS (" + B.CELLS_SQL + ")\nSELECT sample AS file, count(*) AS n FROM c GROUP BY ROLLUP (sample)")
def q_row_counts(spark, sf):
    """A1: rows per input and in total. The inputs are folders named by
    sample (single file names are the writer's choice)."""
    path = _written(spark, sf, "by-sample")
    frames = [TB.read_tables(spark, f"{path}/file={v}/*.csv.gz", infer=False).select(F.lit(v).alias("source_file"))
              for v in [r.file for r in spark.read.option("sep", "\t").csv(path).select("file").distinct().collect()]]
    return TB.row_counts(TB.union_tables(frames))


@register("load_summary", cte(VISIBLE_CTE) + """
SELECT (SELECT count(*) FROM loaded) AS loaded, 100 AS percent_loaded, count(*) AS visible,
  least(count(*), 2000) AS rendered, count(*) > 2000 AS capped FROM visible""")
def q_load_summary(spark, sf):
    """A2: loaded, percent loaded, visible, rendered, capped."""
    return PF.load_summary(loaded(spark, sf), FL.compile_filters(FILTERS), shards_loaded=B.N_SHARDS, rendered_cap=2000)


@register("attribute_domain", P + "\n" + domain_sql("loaded"))
def q_attribute_domain(spark, sf):
    """A3: distinct values (with counts) of every categorical, one scan."""
    return PF.attribute_domain(loaded(spark, sf), R)


@register("attribute_range", P + """
SELECT 't' AS attribute, min(t) AS min_value, max(t) AS max_value,
  CASE WHEN max(t) > min(t) THEN greatest((max(t) - min(t)) / 1000, 0.0001) ELSE 0.0001 END AS step
FROM loaded HAVING min(t) IS NOT NULL""")
def q_attribute_range(spark, sf):
    """A4: min, max and slider step of each continuous attribute."""
    return PF.attribute_range(loaded(spark, sf), R)


@register("distinct_counts", "WITH c AS (" + B.CELLS_SQL + ")\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, CAST(count(DISTINCT {a}) AS BIGINT) AS n_distinct FROM c"
    for a in CAT_ATTRS + ("cell",)))
def q_distinct_counts(spark, sf):
    """A5: distinct values per categorical and of the id column (whole table)."""
    return PF.distinct_counts(B.cells(spark, sf), R)


BOX_COLS = """n, min_x, max_x, (min_x + max_x) * 0.5 AS center_x, max_x - min_x AS size_x,
  min_y, max_y, (min_y + max_y) * 0.5 AS center_y, max_y - min_y AS size_y,
  min_z, max_z, (min_z + max_z) * 0.5 AS center_z, max_z - min_z AS size_z,
  greatest(max_x - min_x, max_y - min_y) AS xy_extent"""


def _box_sql(src: str) -> str:
    return (f"SELECT {BOX_COLS} FROM (SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, "
            f"max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM {src}) b")


MAPPED_VISIBLE = "mv AS (SELECT coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y, coalesce(z, 0.0) AS z FROM visible)"


@register("sketch_distinct", P + "\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, CAST(count(DISTINCT {a}) AS BIGINT) AS n_distinct, true AS close FROM loaded" for a in (*CAT_ATTRS, R.id_col)))
def q_sketch_distinct(spark, sf):
    """A5/U3 from mergeable sketches per shard: the exact count beside whether
    the union's estimate is within 2 % of it."""
    store = shared_dir(spark, "sketches")
    SK.update_sketches(spark, _written(spark, sf, "shards"), store, R)
    est = SK.estimated_counts(spark.read.parquet(store)).withColumnRenamed("n_distinct", "estimate")
    exact = PF.distinct_counts(loaded(spark, sf), R)
    return exact.join(est, "attribute").select("attribute", "n_distinct", (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.02 * F.col("n_distinct")).alias("close"))


@register("bounding_box", cte(VISIBLE_CTE, MAPPED_VISIBLE) + "\n" + _box_sql("mv"))
def q_bounding_box(spark, sf):
    """Box of the visible points on the default axes."""
    vis = visible(spark, sf)
    return E.bounding_box(vis.select(*(PJ.coord(vis, a).alias(a) for a in "xyz")))


def _frame_sql(box: str) -> str:
    h = f"greatest((xy_extent / 2) / {TAN_HALF_FOV} * 1.1, size_z * 1.5, 100.0)"
    return (f"SELECT center_x AS target_x, center_y AS target_y, center_z AS target_z, {h} AS height, "
            f"center_x AS pos_x, center_y AS pos_y, center_z + {h} AS pos_z FROM ({box}) bx WHERE n > 0")


@register("view_frame", cte(VISIBLE_CTE, MAPPED_VISIBLE) + "\n" + _frame_sql(_box_sql("mv")))
def q_view_frame(spark, sf):
    """Camera fit for a 75° field of view."""
    vis = visible(spark, sf)
    return E.view_frame(E.bounding_box(vis.select(*(PJ.coord(vis, a).alias(a) for a in "xyz"))))


@register("extent_head", P + """
SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, max(x) - min(x) AS span_x,
  min(y) AS min_y, max(y) AS max_y, max(y) - min(y) AS span_y,
  min(z) AS min_z, max(z) AS max_z, max(z) - min(z) AS span_z
FROM (SELECT coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y, coalesce(z, 0.0) AS z FROM points WHERE row_idx < 700) h""")
def q_extent_head(spark, sf):
    """Extents over the first 700 rows in load order."""
    pts = B.sharded(spark, sf)
    m = pts.select("row_idx", *(PJ.coord(pts, a).alias(a) for a in "xyz"))
    return E.extent_head(m, 700, idx="row_idx")


STRIDE_CTE = """st AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS ordinal, count(*) OVER () AS n_vis
  FROM (SELECT row_idx, coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y, coalesce(z, 0.0) AS z FROM visible_all) v)"""
STRIDE_TARGET = 100
STRIDE_WHERE = f"ordinal % greatest(1, n_vis // {STRIDE_TARGET}) = 0"


@register("extent_stride", cte(VISIBLE_ALL_CTE, STRIDE_CTE) + "\n"
          + _frame_sql(_box_sql(f"(SELECT * FROM st WHERE {STRIDE_WHERE}) s")))
def q_extent_stride(spark, sf):
    """Box + camera fit over every s-th visible row (all shards)."""
    vis = FL.filter_all(B.sharded(spark, sf), FILTERS)
    return E.extent_stride(vis.select("row_idx", *(PJ.coord(vis, a).alias(a) for a in "xyz")), STRIDE_TARGET)


@register("shard_report", P + """
SELECT CAST(shard AS DOUBLE) AS shard, count(*) AS rows, false AS over_limit, true AS sized FROM points GROUP BY ROLLUP (shard)""")
def q_shard_report(spark, sf):
    """A10: per shard rows, over-limit flag and that files and bytes are
    there, and the total (file sizes are the writer's)."""
    rep = SH.shard_report(spark, _written(spark, sf, "shards"))
    return rep.select(F.col("shard").cast("double").alias("shard"), F.col("rows").cast("bigint").alias("rows"), "over_limit",
                      ((F.col("files") > 0) & (F.col("bytes") > 0) & (F.col("max_file_bytes") <= F.col("bytes"))).alias("sized"))


@register("footer_report", P + "\nSELECT shard, count(*) AS rows, min(t) AS min_t, max(t) AS max_t FROM points GROUP BY shard")
def q_footer_report(spark, sf):
    """A10/A4 from the footers of the written shards: rows and the range of t
    per shard, no data read."""
    return SH.footer_report(spark, _written(spark, sf, "shards"), ("t",))


@register("size_reduction", P + """
SELECT count(DISTINCT shard) > 0 AS written, count(*) AS rows, true AS adds_up FROM points""")
def q_size_reduction(spark, sf):
    """Gzipped TSV bytes vs shard bytes: the percentage follows from the
    two sums, and the shards hold all rows (byte counts are the writer's)."""
    path = _written(spark, sf, "shards")
    red = SH.size_reduction(spark, f"{_written(spark, sf, 'tsv')}/*.csv.gz", path)
    rows = spark.read.parquet(path).agg(F.count(F.lit(1))).scalar()
    same = F.abs(F.col("reduction_pct") - 100 * (F.col("old_bytes") - F.col("new_bytes")) / F.col("old_bytes")) < 1e-9
    return red.select((F.col("new_files") > 0).alias("written"), rows.alias("rows"), same.alias("adds_up"))


@register("part_report", "WITH c AS (" + B.CELLS_SQL + f""")
SELECT CAST({N_PARTS} AS BIGINT) AS parts, count(*) AS data_lines, false AS any_over_limit, true AS ordered FROM c""")
def q_part_report(spark, sf):
    """Number of parts, flags and the lines they hold (sizes are the
    writer's)."""
    out = _split(spark, sf, "split-report")
    rep = TS.part_report(spark, out)
    lines = spark.read.text(f"{out}/*.gz").agg(F.count(F.lit(1)) - N_PARTS).scalar()
    inside = (F.col("min_mib") > 0) & (F.col("min_mib") <= F.col("avg_mib")) & (F.col("avg_mib") <= F.col("max_mib"))
    return rep.select("parts", lines.alias("data_lines"), "any_over_limit", inside.alias("ordered"))


@register("frame_counts", cte(VISIBLE_CTE) + """
SELECT CAST(coalesce(time_rank, 0) AS INTEGER) AS time_rank, count(*) AS n FROM visible GROUP BY 1""")
def q_frame_counts(spark, sf):
    """Visible points per time rank (all frames, one job)."""
    return FR.frame_counts(visible(spark, sf), "time_rank")


# ================================================================ windows / ordinals

@register("shuffle_rank", P + "\nSELECT row_id, row_idx FROM points")
def q_shuffle_rank(spark, sf):
    """Seeded uniform permutation → row_idx."""
    return RK.shuffle_rank(B.cells(spark, sf), "cell", "row_id", seed=B.SEED).select("row_id", "row_idx")


@register("keyed_permutation", INGEST_SQL + "\nSELECT row_id, row_idx FROM permuted")
def q_keyed_permutation(spark, sf):
    """W1 where rows are numbered (raw text): a keyed bijection of the line
    numbers, without a sort, a count per bucket or a window."""
    rows = TB.read_tables(spark, f"{_written(spark, sf, 'lines')}/*.gz", with_number=True, text_columns=(*CAT_ATTRS, R.id_col))
    return PM.permute_rows(rows, "source_row", rows.count(), B.SEED).select("row_id", "row_idx")


@register("line_number", "WITH c AS (" + B.CELLS_SQL + """)
SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS line, row_id FROM c""")
def q_line_number(spark, sf):
    """Exact line positions of text files (cells written in row_id
    order, several files)."""
    path = shared_dir(spark, "lines")
    B.cells(spark, sf).orderBy("row_id").write.mode("overwrite").option("sep", "\t").csv(path)
    lines = RK.line_number(spark.read.text(f"{path}/*.csv"))
    return lines.select("line", F.split("value", "\t").getItem(0).cast("bigint").alias("row_id"))


@register("shard_floor", P + "\nSELECT row_id, shard FROM points")
def q_shard_floor(spark, sf):
    """floor(rows/10) per shard, remainder in the last."""
    ranked = RK.shuffle_rank(B.cells(spark, sf), "cell", "row_id", seed=B.SEED)
    return RK.assign_shards(ranked, 10).select("row_id", "shard")


@register("shard_even", "WITH c AS (" + B.CELLS_SQL + """)
SELECT row_id, CAST(ntile(7) OVER (ORDER BY md5(concat('42:', cell, ':', CAST(row_id AS VARCHAR))), row_id) AS INTEGER) AS part FROM c""")
def q_shard_even(spark, sf):
    """7 parts, remainder over the first parts (ntile assignment)."""
    ranked = RK.shuffle_rank(B.cells(spark, sf), "cell", "row_id", seed=B.SEED)
    return RK.assign_even_parts(ranked, 7).select("row_id", "part")


@register("frame_index", cte(FRAMES_CTE) + """
SELECT frame_idx, time_rank, n_frames, printf('TimeRank: %d (%d/%d)', time_rank, frame_idx + 1, n_frames) AS label,
  CAST((frame_idx + 1) % n_frames AS INTEGER) AS next_idx FROM frames""")
def q_frame_index(spark, sf):
    """Sorted frames, 0-based index, label, cyclic next."""
    return FR.frame_index(loaded(spark, sf), "time_rank")


@register("visible_ordinal", cte(VISIBLE_CTE) + """
SELECT row_idx, CAST(row_number() OVER (ORDER BY row_idx) - 1 AS BIGINT) AS ordinal FROM visible""")
def q_visible_ordinal(spark, sf):
    """Position of each visible row in load order."""
    return RK.visible_ordinal(visible(spark, sf)).select("row_idx", "ordinal")


@register("cumulative_size", P + """
SELECT shard, n AS rows, CAST(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_rows
FROM (SELECT shard, count(*) AS n FROM points GROUP BY shard) s""")
def q_cumulative_size(spark, sf):
    """Running totals over the written shards (rows; bytes in the
    library function)."""
    cum = SH.cumulative_size(SH.shard_report(spark, _written(spark, sf, "shards")))
    return cum.select("shard", F.col("rows").cast("bigint").alias("rows"),
                      F.col("cum_rows").cast("bigint").alias("cum_rows"))


HUE_SQL = sql_rgb(P + """,
d AS (SELECT DISTINCT gene AS value FROM loaded WHERE gene IS NOT NULL),
p AS (SELECT value, CAST(row_number() OVER (ORDER BY md5(concat('42:', value)), value) - 1 AS BIGINT) AS perm,
  count(*) OVER () AS n FROM d)
SELECT 'gene' AS attribute, value, perm, CAST(perm AS DOUBLE) / CAST(n AS DOUBLE) AS hue FROM p""",
                  "hue", "0.8", "0.5")
HUE_SQL = f"SELECT attribute, value, perm, r, g, b FROM ({HUE_SQL}) hh"


@register("hue_assignment", HUE_SQL)
def q_hue_assignment(spark, sf):
    """Evenly spaced hues dealt to the gene values in seeded order."""
    return PL.hue_assignment(PF.attribute_domain(loaded(spark, sf), R, ("gene",)), "gene", R, seed=B.SEED)


# ================================================================ sorts / limits

def _positions(spark, ordered: DataFrame, name: str) -> DataFrame:
    """The rows of a sorted result with their position: written as it comes
    (files in order, rows in order inside) and numbered as read (W1b)."""
    path = shared_dir(spark, name)
    cols = ordered.columns
    ordered.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)
    lines = RK.line_number(spark.read.text(path), out="ord")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return lines.select(F.from_json("value", schema).alias("v"), "ord").select("v.*", "ord")


@register("sorted_domain", P + "\nSELECT *, row_number() OVER (ORDER BY attribute, value) - 1 AS ord FROM (" + domain_sql("loaded") + ") d")
def q_sorted_domain(spark, sf):
    """O1: domain values in binary string order, with the position at which
    each comes."""
    return _positions(spark, PF.sorted_domain(PF.attribute_domain(loaded(spark, sf), R)), "sorted-domain")


@register("ranked_domain", P + "\nSELECT *, row_number() OVER (ORDER BY attribute, value) - 1 AS ord FROM (" + domain_sql("loaded") + ") d")
def q_ranked_domain(spark, sf):
    """O1: domain values with their positions, ranked in sampled ranges."""
    return PF.ranked_domain(PF.attribute_domain(loaded(spark, sf), R))


@register("sorted_frames", P + """
SELECT time_rank, row_number() OVER (ORDER BY time_rank) - 1 AS ord
FROM (SELECT DISTINCT CAST(coalesce(time_rank, 0) AS INTEGER) AS time_rank FROM loaded) d""")
def q_sorted_frames(spark, sf):
    """O2: time ranks in numeric order, with the position at which each
    comes."""
    return _positions(spark, FR.sorted_frames(loaded(spark, sf), "time_rank"), "sorted-frames")


@register("render_cap", cte(VISIBLE_CTE) + """
SELECT row_idx, ordinal FROM (SELECT row_idx, CAST(row_number() OVER (ORDER BY row_idx) - 1 AS BIGINT) AS ordinal
FROM visible) v WHERE ordinal < 300""")
def q_render_cap(spark, sf):
    """O3: first min(visible, 300) visible rows in load order (a cap below the
    number of visible rows)."""
    return render_cap(visible(spark, sf), 300, width=128).select("row_idx", "ordinal")


@register("legend_top", P + """,
d AS (SELECT DISTINCT gene AS value FROM loaded WHERE gene IS NOT NULL),
s AS (SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS ord FROM d)
SELECT ord, value, (SELECT CAST(greatest(count(*) - 100, 0) AS BIGINT) FROM d) AS remaining FROM s WHERE ord <= 100""")
def q_legend_top(spark, sf):
    """First 100 sorted gene values and the count of the rest."""
    top, rest = LG.legend_top(PF.attribute_domain(loaded(spark, sf), R, ("gene",)), "gene", 100)
    return top.select(F.col("ord").cast("int").alias("ord"), "value",
                      rest.select("remaining").scalar().alias("remaining"))


@register("head_rows", P + "\nSELECT row_idx, row_id, x, y, z FROM loaded ORDER BY row_idx LIMIT 5")
def q_head_rows(spark, sf):
    """First 5 loaded rows."""
    return E.head_rows(loaded(spark, sf)).select("row_idx", "row_id", "x", "y", "z")


@register("stride_sample", cte(VISIBLE_ALL_CTE, STRIDE_CTE) + f"\nSELECT row_idx, ordinal FROM st WHERE {STRIDE_WHERE}")
def q_stride_sample(spark, sf):
    """Every s-th visible row, s = max(1, floor(n / 100)) (all shards)."""
    vis = FL.filter_all(B.sharded(spark, sf), FILTERS)
    return E.stride_sample(vis.select("row_idx"), STRIDE_TARGET).select("row_idx", "ordinal")


# ================================================================ legends

LEGEND_CAT_SQL = sql_hash_rgb(P + """,
d AS (SELECT DISTINCT gene AS value FROM loaded WHERE gene IS NOT NULL),
s AS (SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS ord FROM d)
SELECT ord, value FROM s WHERE ord <= 100""", "value")
LEGEND_CAT_SQL = (f"SELECT ord, value, CASE WHEN value = '' THEN '(empty)' ELSE value END AS label, r, g, b "
                  f"FROM ({LEGEND_CAT_SQL}) lc UNION ALL SELECT * FROM (" + P + """
SELECT 101 AS ord, CAST(NULL AS VARCHAR) AS value, concat('... and ', CAST(count(*) - 100 AS VARCHAR), ' more') AS label,
  149 AS r, 165 AS g, 166 AS b
FROM (SELECT DISTINCT gene FROM loaded WHERE gene IS NOT NULL) d HAVING count(*) > 100) more""")


@register("legend_categorical", LEGEND_CAT_SQL)
def q_legend_categorical(spark, sf):
    """L1: legend of gene: first 100 values with colours, then '... and N more'."""
    return LG.legend_categorical(PF.attribute_domain(loaded(spark, sf), R, ("gene",)), "gene", limit=100)


LEGEND_ALL_SQL = sql_hash_rgb(P + """,
d AS (SELECT DISTINCT gene AS value FROM loaded WHERE gene IS NOT NULL)
SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS ord, value FROM d""", "value")
LEGEND_ALL_SQL = f"SELECT ord, value, CASE WHEN value = '' THEN '(empty)' ELSE value END AS label, r, g, b FROM ({LEGEND_ALL_SQL}) la"


@register("legend_categorical_all", LEGEND_ALL_SQL)
def q_legend_categorical_all(spark, sf):
    """L1 without a limit: all values of gene."""
    return LG.legend_categorical(PF.attribute_domain(loaded(spark, sf), R, ("gene",)), "gene")


LEGEND_CONT_SQL = sql_gradient_rgb(P + """,
rg AS (SELECT min(t) AS min_value, max(t) AS max_value FROM loaded HAVING min(t) IS NOT NULL)
SELECT CAST(i AS INTEGER) AS stop, min_value, max_value,
  min_value + (max_value - min_value) * (CAST(i AS DOUBLE) / 100) AS value FROM rg, range(0, 101) s(i)""",
                                   "value", "min_value", "max_value")
LEGEND_CONT_SQL = (f"SELECT stop, value, r, g, b, printf('%.4f', min_value) AS min_label, "
                   f"printf('%.4f', max_value) AS max_label FROM ({LEGEND_CONT_SQL}) lq")


@register("legend_continuous", LEGEND_CONT_SQL)
def q_legend_continuous(spark, sf):
    """L2: 101 gradient stops of t with colours and end labels."""
    return LG.legend_continuous(PF.attribute_range(loaded(spark, sf), R), "t")


# ================================================================ set operations

@register("union_tables", P + """
SELECT row_idx, x, structure FROM points WHERE shard <= 5
UNION ALL SELECT row_idx, x, CAST(NULL AS VARCHAR) AS structure FROM points WHERE shard > 5""")
def q_union_tables(spark, sf):
    """Inputs with unlike columns stacked by name (missing → null)."""
    pts = B.sharded(spark, sf)
    a = pts.where(F.col("shard") <= 5).select("row_idx", "x", "structure")
    b = pts.where(F.col("shard") > 5).select("row_idx", "x")
    return TB.union_tables([a, b])


@register("append_shards", P + "\nSELECT row_idx, shard FROM points WHERE shard <= 5")
def q_append_shards(spark, sf):
    """2 shards loaded, target 5 → shards 1..5, no row twice."""
    path = _written(spark, sf, "shards")
    return SH.append_shards(spark, path, loaded=2, target=5, columns=["row_idx", "shard"])


@register("domain_merge", P + "\nSELECT attribute, value, CAST(sum(n) AS BIGINT) AS n FROM ("
          + domain_sql("(SELECT * FROM points WHERE shard <= 5) a") + " UNION ALL "
          + domain_sql("(SELECT * FROM points WHERE shard > 5) b") + ") u GROUP BY attribute, value")
def q_domain_merge(spark, sf):
    """Domain of the rows loaded first (shards 1-5) ∪ domain of the rows
    appended later (shards 6-10)."""
    pts = B.sharded(spark, sf)
    d1 = PF.attribute_domain(pts.where(F.col("shard") <= 5), R)
    d2 = PF.attribute_domain(pts.where(F.col("shard") > 5), R)
    return PF.domain_merge(d1, d2)


# ================================================================ scalar expressions

CELLS_DOMAIN = "WITH c AS (" + B.CELLS_SQL + "), d AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{a}' AS attribute, {a} AS value FROM c WHERE {a} IS NOT NULL" for a in CAT_ATTRS) + ")"


def _cells_domain(spark, sf) -> DataFrame:
    return PF.attribute_domain(B.cells(spark, sf), R).select("attribute", "value")


@register("category_hash", CELLS_DOMAIN + f"\nSELECT attribute, value, {sql_hash('value')} AS hash FROM d")
def q_category_hash(spark, sf):
    """String hash of every categorical value (whole table)."""
    return _cells_domain(spark, sf).select("attribute", "value", C.category_hash(F.col("value")).alias("hash"))


@register("category_hsl", CELLS_DOMAIN + f"""
SELECT attribute, value, CAST(((h % 360) + 360) % 360 AS INTEGER) AS hue, CAST(70 + h % 20 AS INTEGER) AS saturation,
  CAST(50 + h % 20 AS INTEGER) AS lightness FROM (SELECT *, {sql_hash('value')} AS h FROM d) x""")
def q_category_hsl(spark, sf):
    """Hue, saturation, lightness (integers) from the hash."""
    h = C.category_hash(F.col("value"))
    d = _cells_domain(spark, sf).withColumn("h", h)
    return d.select("attribute", "value", F.pmod(F.col("h"), F.lit(360)).cast("int").alias("hue"),
                    (F.lit(70) + F.col("h") % 20).cast("int").alias("saturation"),
                    (F.lit(50) + F.col("h") % 20).cast("int").alias("lightness"))


@register("hsl_to_rgb", "SELECT attribute, value, r, g, b FROM ("
          + sql_hash_rgb(CELLS_DOMAIN + "\nSELECT attribute, value FROM d", "value", grey_empty=False) + ") q")
def q_hsl_to_rgb(spark, sf):
    """RGB (8-bit) of every categorical value's HSL."""
    return C.with_hash_rgb(_cells_domain(spark, sf), "value", grey_empty=False)


GRADIENT_SQL = sql_gradient_rgb(P + """,
rg AS (SELECT min(t) AS lo, max(t) AS hi FROM loaded)
SELECT row_idx, t, lo, hi FROM loaded, rg""", "t", "lo", "hi")
GRADIENT_SQL = f"SELECT row_idx, r, g, b FROM ({GRADIENT_SQL}) gq"


@register("gradient_color", GRADIENT_SQL)
def q_gradient_color(spark, sf):
    """blue→red gradient of t over its loaded range (null → grey)."""
    ld = loaded(spark, sf).select("row_idx", "t")
    out = PL.color_encode(ld, "t", R, ranges=PF.attribute_range(ld, R))
    return out.select("row_idx", "r", "g", "b")


@register("null_color", P + """
SELECT row_idx, 136 AS r, 136 AS g, 136 AS b FROM loaded WHERE structure IS NULL OR structure = ''""")
def q_null_color(spark, sf):
    """Rows whose structure is null or '' are grey."""
    ld = loaded(spark, sf).where(F.col("structure").isNull() | (F.col("structure") == ""))
    return PL.color_encode(ld.select("row_idx", "structure"), "structure", R).select("row_idx", "r", "g", "b")


RGB_HEX_SQL = sql_hash_rgb(P + "\nSELECT DISTINCT structure AS value FROM loaded WHERE structure IS NOT NULL", "value")
RGB_HEX_SQL = (f"SELECT value, printf('#%02x%02x%02x', r, g, b) AS hex, r, g, b FROM ({RGB_HEX_SQL}) x")


@register("rgb_hex", RGB_HEX_SQL)
def q_rgb_hex(spark, sf):
    """Palette colours as '#rrggbb' and back to 8-bit channels."""
    pal = PL.build_palette(PF.attribute_domain(loaded(spark, sf), R, ("structure",)), "structure")
    hexed = pal.select("value", C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    back = C.hex_rgb8(F.col("hex"))
    return hexed.select("value", "hex", back.r.alias("r"), back.g.alias("g"), back.b.alias("b"))


@register("fixed_text", P + """
SELECT row_idx, printf('%.2f', x) AS x_2, printf('%.4f', t) AS t_4, format('{:,}', row_id * 1000) AS id_grouped FROM loaded""")
def q_fixed_text(spark, sf):
    """Fixed decimals and grouped thousands."""
    return loaded(spark, sf).select("row_idx", fixed("x", 2).alias("x_2"), fixed("t", 4).alias("t_4"),
                                    grouped(F.col("row_id") * 1000).alias("id_grouped"))


@register("part_name", "WITH c AS (" + B.CELLS_SQL + """)
SELECT DISTINCT CAST(CAST(substr(hf, 3) AS INTEGER) * 37 + 1 AS INTEGER) AS part,
  concat('cells.v2.part', CASE WHEN CAST(substr(hf, 3) AS INTEGER) * 37 + 1 < 10 THEN '0' ELSE '' END,
         CAST(CAST(substr(hf, 3) AS INTEGER) * 37 + 1 AS VARCHAR), '.tsv.gz') AS name FROM c""")
def q_part_name(spark, sf):
    """Output names of parts whose numbers come from the cells (one to
    four digits)."""
    part = (F.substring("hf", 3, 10).cast("int") * 37 + 1).alias("part")
    nums = B.cells(spark, sf).select(part).distinct()
    return nums.select("part", part_name(F.lit("/data/in/cells.v2.tsv.gz"), F.col("part")).alias("name"))


@register("percent_ratio", P + """,
s AS (SELECT shard, count(*) AS n FROM points GROUP BY shard)
SELECT shard, CAST(sum(n) OVER (ORDER BY shard) AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS pct_loaded FROM s""")
def q_percent_ratio(spark, sf):
    """Percent of rows loaded with 1..10 shards."""
    s = B.sharded(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    cum = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    tot = F.sum("n").over(Window.partitionBy())
    return s.select("shard", percent_ratio(cum, tot).alias("pct_loaded"))


# ================================================================ streaming

@register("progressive_load", P + "\nSELECT row_idx, shard, x, structure FROM points")
def q_progressive_load(spark, sf):
    """Shards arriving one per trigger; the end state is every shard."""
    return PG.progressive_load(spark, _written(spark, sf, "shards"), ["row_idx", "shard", "x", "structure"])


@register("progressive_domain", P + "\n" + domain_sql("points"))
def q_progressive_domain(spark, sf):
    """Running domains; end state equals the batch domain."""
    return PG.progressive_domain(spark, _written(spark, sf, "shards"), R)


@register("progressive_summary", P + """
SELECT count(*) AS rows, min(t) AS min_t, max(t) AS max_t, min(coalesce(x, 0.0)) AS min_x, max(coalesce(x, 0.0)) AS max_x,
  min(coalesce(y, 0.0)) AS min_y, max(coalesce(y, 0.0)) AS max_y, min(coalesce(z, 0.0)) AS min_z,
  max(coalesce(z, 0.0)) AS max_z FROM points""")
def q_progressive_summary(spark, sf):
    """Running count, range and extents; the end state."""
    _, end = PG.progressive_summary(spark, _written(spark, sf, "shards"), R)
    return end


@register("progressive_history", P + """
SELECT s.shard AS shard, count(*) AS rows, min(t) AS min_t, max(t) AS max_t, min(coalesce(x, 0.0)) AS min_x, max(coalesce(x, 0.0)) AS max_x,
  min(coalesce(y, 0.0)) AS min_y, max(coalesce(y, 0.0)) AS max_y, min(coalesce(z, 0.0)) AS min_z, max(coalesce(z, 0.0)) AS max_z
FROM (SELECT DISTINCT shard FROM points) s JOIN points p ON p.shard <= s.shard GROUP BY s.shard""")
def q_progressive_history(spark, sf):
    """Count, range and extents after each of the ten shards."""
    return PG.progressive_summary(spark, _written(spark, sf, "shards"), R)[0]


@register("progressive_filter", cte(VISIBLE_ALL_CTE) + "\nSELECT row_idx, row_id FROM visible_all")
def q_progressive_filter(spark, sf):
    """T4: the filter list on arriving rows."""
    return PG.progressive_filter(spark, _written(spark, sf, "shards"), FILTERS, ["row_idx", "row_id"])


# ================================================================ the volume binding (lineitem ⋈ part)

IR = B.ITEM_ROLES
I_CTE = "WITH items AS (" + B.ITEMS_SQL + ")"
ITEM_FILTERS = [
    FL.FilterSpec(1, "returnflag", "categorical", ("A", "R")),
    FL.FilterSpec(2, "discount", "continuous", None, (0.02, 0.06)),
]
I_WHERE = "returnflag IN ('A', 'R') AND discount BETWEEN 0.02 AND 0.06"


def _items(spark, sf) -> DataFrame:
    return B.items(spark, sf).drop("item_key")


@register("items_domain", I_CTE + "\n" + domain_sql("items", IR.categorical))
def q_items_domain(spark, sf):
    """A3 over lineitem ⋈ part."""
    return PF.attribute_domain(_items(spark, sf), IR)


@register("items_range", I_CTE + """
SELECT 'discount' AS attribute, min(discount) AS min_value, max(discount) AS max_value,
  CASE WHEN max(discount) > min(discount) THEN greatest((max(discount) - min(discount)) / 1000, 0.0001) ELSE 0.0001 END AS step
FROM items HAVING min(discount) IS NOT NULL""")
def q_items_range(spark, sf):
    """A4 over lineitem ⋈ part."""
    return PF.attribute_range(_items(spark, sf), IR)


@register("items_distinct", I_CTE + "\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, CAST(count(DISTINCT {a}) AS BIGINT) AS n_distinct FROM items" for a in IR.categorical))
def q_items_distinct(spark, sf):
    """A5 over lineitem ⋈ part."""
    return PF.distinct_counts(_items(spark, sf), IR)


@register("items_funnel", I_CTE + f"""
SELECT 0 AS step, '(all)' AS attribute, true AS applied, count(*) AS n_before, count(*) FILTER (WHERE {I_WHERE}) AS n_after FROM items
UNION ALL SELECT 1, 'returnflag', true, count(*), count(*) FILTER (WHERE returnflag IN ('A', 'R')) FROM items
UNION ALL SELECT 2, 'discount', true, count(*) FILTER (WHERE returnflag IN ('A', 'R')), count(*) FILTER (WHERE {I_WHERE}) FROM items""")
def q_items_funnel(spark, sf):
    """F8 over lineitem ⋈ part."""
    return FL.filter_funnel(_items(spark, sf), ITEM_FILTERS)


@register("items_bitmap_funnel", ORACLE["items_funnel"])
def q_items_bitmap_funnel(spark, sf):
    """F8 from a bitmap index over lineitem ⋈ part."""
    return BM.bitmap_funnel(BM.build_index(B.item_points(spark, sf), IR), ITEM_FILTERS)


@register("items_frame_counts", I_CTE + f"""
SELECT CAST(coalesce(year_rank, 0) AS INTEGER) AS time_rank, count(*) AS n FROM items WHERE {I_WHERE} GROUP BY 1""")
def q_items_frame_counts(spark, sf):
    """A13 over the filtered lineitem ⋈ part."""
    return FR.frame_counts(FL.filter_all(_items(spark, sf), ITEM_FILTERS), "year_rank")


@register("items_box", I_CTE + "\n" + _box_sql(f"(SELECT * FROM items WHERE {I_WHERE})"))
def q_items_box(spark, sf):
    """A6 over the filtered lineitem ⋈ part."""
    return E.bounding_box(FL.filter_all(_items(spark, sf), ITEM_FILTERS))


@register("items_view_frame", I_CTE + "\n" + _frame_sql(_box_sql("items")))
def q_items_view_frame(spark, sf):
    """A7 over lineitem ⋈ part."""
    return E.view_frame(E.bounding_box(_items(spark, sf)))


@register("items_legend", "SELECT ord, value, CASE WHEN value = '' THEN '(empty)' ELSE value END AS label, r, g, b FROM ("
          + sql_hash_rgb(I_CTE + """
SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS ord, value
FROM (SELECT DISTINCT ptype AS value FROM items WHERE ptype IS NOT NULL) d""", "value") + ") l")
def q_items_legend(spark, sf):
    """L1 over the part types."""
    return LG.legend_categorical(PF.attribute_domain(_items(spark, sf), IR, ("ptype",)), "ptype")


@register("items_summary", I_CTE + f"""
SELECT count(*) AS loaded, 100 AS percent_loaded, count(*) FILTER (WHERE {I_WHERE}) AS visible,
  count(*) FILTER (WHERE {I_WHERE}) AS rendered, false AS capped FROM items""")
def q_items_summary(spark, sf):
    """A2 over lineitem ⋈ part, without a cap."""
    return PF.load_summary(_items(spark, sf), FL.compile_filters(ITEM_FILTERS), shards_loaded=B.N_SHARDS)


@register("items_colours", sql_hash_rgb(I_CTE + "\nSELECT brand AS value, count(*) AS n FROM items GROUP BY brand", "value"))
def q_items_colours(spark, sf):
    """P7/J1 over lineitem ⋈ part: rows by brand and colour."""
    done = PL.color_encode(_items(spark, sf).select("brand"), "brand", IR)
    return done.groupBy(F.col("brand").alias("value"), "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@register("items_ranks", I_CTE + """
SELECT shard, count(*) AS n FROM (SELECT CAST(least(i // (t // 10), 9) + 1 AS INTEGER) AS shard
FROM (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS t FROM items) r) s GROUP BY shard""")
def q_items_ranks(spark, sf):
    """W1 + W2 over lineitem ⋈ part: rows per shard."""
    return B.item_points(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
