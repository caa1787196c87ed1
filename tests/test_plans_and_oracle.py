"""Plan shape checks and the DuckDB oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from cloudsift.plans import catalog
from tests.conftest import SF_TINY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["row_idx", "ordinal", "x", "y", "z", "r", "g", "b"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_first_view_plan(spark):
    plan = _plan(E.queries()["first_view"](spark, SF_TINY))
    assert "PartitionFilters: [isnotnull(shard" in plan
    assert "BroadcastHashJoin" in plan  # palette join
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_TINY}/{t}.parquet'")
    return c


def _norm(df: pd.DataFrame):
    out = []
    for rec in df[sorted(df.columns)].itertuples(index=False):
        vals = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and v != v):
                vals.append("NULL")
                continue
            v = v.item() if hasattr(v, "item") else v
            if isinstance(v, float) and v.is_integer():
                v = int(v)
            vals.append(repr(v))
        out.append("|".join(vals))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, con, name):
    s = catalog.QUERIES[name](spark, SF_TINY).toPandas()
    o = con.sql(catalog.ORACLE[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert _norm(s) == _norm(o)


VIEW_QUERIES = ["first_view", "filter_all", "filter_funnel", "palette_join", "attribute_domain",
                "frame_counts", "render_cap", "visible_ordinal", "legend_categorical", "pick_points",
                "extent_stride", "shuffle_rank", "bounding_box", "hue_assignment", "stride_sample"]


def _tree(plan: str):
    """(depth, text, parent index) per plan line, from the tree drawing."""
    nodes, stack = [], []
    for line in plan.splitlines():
        stripped = line.lstrip(" :|")
        if stripped.startswith("+- "):
            stripped = stripped[3:]
        depth = len(line) - len(line.lstrip(" :|+-"))
        while stack and nodes[stack[-1]][0] >= depth:
            stack.pop()
        nodes.append((depth, stripped, stack[-1] if stack else None))
        stack.append(len(nodes) - 1)
    return nodes


def _rows_reach_single_partition(plan: str) -> list[str]:
    """Scans whose rows reach an `Exchange SinglePartition` without an
    aggregate between them."""
    nodes = _tree(plan)
    bad = []
    for i, (_, text, parent) in enumerate(nodes):
        if not text.startswith("FileScan"):
            continue
        j, aggregated = parent, False
        while j is not None:
            t = nodes[j][1]
            if "HashAggregate" in t or "ObjectHashAggregate" in t:
                aggregated = True
            if t.startswith("Exchange SinglePartition") and not aggregated:
                bad.append(text[:80])
                break
            j = nodes[j][2]
    return bad


@pytest.mark.parametrize("name", VIEW_QUERIES)
def test_no_single_partition_over_rows(spark, name):
    """A one-partition exchange may only gather aggregated output (global
    aggregates, the bucket-count table), never point rows."""
    plan = _plan(E.queries()[name](spark, SF_TINY))
    assert _rows_reach_single_partition(plan) == [], name
    assert "CartesianProduct" not in plan


def test_plan_walker_flags_a_global_sort(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{SF_TINY}/events.parquet")
    bad = df.select(F.row_number().over(Window.orderBy("event_id")).alias("r"))
    assert _rows_reach_single_partition(_plan(bad))
    good = df.agg(F.count(F.lit(1)))
    assert not _rows_reach_single_partition(_plan(good))


def test_no_python_or_cartesian_in_any_registered_plan(spark):
    """Every registered query stays JVM-side (no Python evaluation) and has no
    Cartesian product."""
    bad = []
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SF_TINY))
        for marker in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "PythonUDF"):
            if marker in plan:
                bad.append((name, marker))
    assert bad == []


def _row_exchanges(plan: str) -> int:
    """Shuffles that carry unaggregated rows (below them a scan without an
    aggregate or a broadcast between)."""
    nodes = _tree(plan)
    found = set()
    for _, text, parent in nodes:
        if not text.startswith("FileScan"):
            continue
        while parent is not None:
            t = nodes[parent][1]
            if "HashAggregate" in t or t.startswith("BroadcastExchange"):
                break
            if t.startswith("Exchange "):
                found.add(parent)
            parent = nodes[parent][2]
    return len(found)


@pytest.fixture()
def no_auto_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "1")
    spark.conf.set(keys[1], "false")
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def test_rank_moves_rows_once(spark, no_auto_broadcast):
    """Above any broadcast estimate the permutation still has one exchange of
    rows; the cap has none before its cut (one of the kept rows after it)."""
    from pyspark.sql import functions as F

    from cloudsift.operators import ranks as RK
    from cloudsift.operators.export import render_cap
    ev = spark.read.parquet(f"{SF_TINY}/events.parquet")
    ranked = RK.shuffle_rank(ev, "event_id", n_rows=1000)
    assert _row_exchanges(_plan(ranked)) == 1, _plan(ranked)
    capped = _plan(render_cap(ev.select(F.col("event_id").alias("row_idx"), "value"), 100))
    assert _row_exchanges(capped) == 1
    assert "SortMergeJoin" not in capped and "Subquery" in capped


def test_shared_folder_follows_the_context(spark):
    from cloudsift.session import checkpoint_root, release, shared_dir
    root = spark.sparkContext.getCheckpointDir()
    assert checkpoint_root(spark) == root.rstrip("/")
    d = shared_dir(spark, "t")
    spark.range(3).write.parquet(f"{d}/x")
    assert spark.read.parquet(f"{d}/x").count() == 3
    release(spark, d)
    import os
    assert not os.path.exists(d.replace("file:", ""))
