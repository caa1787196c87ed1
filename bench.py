"""Benchmark: ingest + exploration queries at one scale factor.

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf", ...}. Each step is forced with the no-op sink (full execution, nothing
collected) or is a write. Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8), BENCH_EVENT_LOG (optional folder for Spark's event log).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cloudsift.operators import extent as E  # noqa: E402
from cloudsift.operators import filters as FL  # noqa: E402
from cloudsift.operators import frames as FR  # noqa: E402
from cloudsift.operators import legend as LG  # noqa: E402
from cloudsift.operators import palette as PL  # noqa: E402
from cloudsift.operators import pick as PK  # noqa: E402
from cloudsift.operators import profile as PF  # noqa: E402
from cloudsift.operators import project as PJ  # noqa: E402
from cloudsift.operators.export import export_points, render_table  # noqa: E402
from cloudsift.plans import bindings as B  # noqa: E402
from cloudsift.plans import catalog  # noqa: E402
from cloudsift.plans.ingest import run_ingest  # noqa: E402
from cloudsift.session import checkpoint_root, get_session, shared_dir  # noqa: E402
from cloudsift.sources import shards as SH  # noqa: E402
from cloudsift.sources import text_split as TS  # noqa: E402
from cloudsift.streaming import progressive as PG  # noqa: E402

IR = B.ITEM_ROLES
ITEM_FILTERS = [
    FL.FilterSpec(1, "returnflag", "categorical", ("A", "N")),
    FL.FilterSpec(2, "discount", "continuous", None, (0.02, 0.08)),
    FL.FilterSpec(3),
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = {}
    event_dir = os.environ.get("BENCH_EVENT_LOG")  # optional: stage/task times, no UI
    if event_dir:
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir}
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app_name="cloudsift-bench",
                        extra=extra)
    checkpoint_root(spark)  # the cluster's shared folder; a local one only when unset
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    # warm-up (JVM, code paths) on the smallest tables, not timed; never on
    # the measured tables (their shards would then be cached)
    warm = "/root/testdata/sf0.001"
    if os.path.realpath(warm) != os.path.realpath(sf_dir):
        run(catalog.first_view(spark, warm))

    item_path = shared_dir(spark, "bench-items")
    timed("ingest_items", lambda: SH.write_shards(B.item_points(spark, sf_dir).drop("n_rows"), item_path))
    timed("ingest_cells", lambda: B.shards_path(spark, sf_dir))
    ds = spark.read.parquet(item_path)
    n_items = ds.count()
    loaded1 = ds.where(F.col("shard") <= 1)
    full = ds

    def first_view(src):
        vis = FL.filter_all(src, ITEM_FILTERS)
        pal = PL.build_palette(PF.attribute_domain(src, IR, ("brand",)), "brand")
        return render_table(vis, IR, "brand", palette=pal)

    timed("first_view_10pct", lambda: run(first_view(loaded1)))
    timed("view_100pct_export", lambda: export_points(first_view(full), shared_dir(spark, "bench-export")))
    timed("profile_domain_range", lambda: (run(PF.attribute_domain(full, IR)), run(PF.attribute_range(full, IR))))
    timed("filter_funnel", lambda: run(FL.filter_funnel(full, ITEM_FILTERS)))
    timed("frames", lambda: (run(FR.frame_counts(FL.filter_all(full, ITEM_FILTERS), "year_rank")),
                             run(FR.frame_index(full, "year_rank"))))
    timed("legend", lambda: (run(LG.legend_categorical(PF.attribute_domain(full, IR, ("brand",)), "brand")),
                             run(LG.legend_continuous(PF.attribute_range(full, IR), "discount"))))
    timed("gradient_color", lambda: run(PL.color_encode(full.select("row_idx", "discount"), "discount", IR,
                                                        ranges=PF.attribute_range(full, IR))))
    timed("extent_stride", lambda: run(E.extent_stride(
        FL.filter_all(full, ITEM_FILTERS).select("row_idx", *(PJ.coord(full, a).alias(a) for a in "xyz")))))

    def pick():
        vis = FL.filter_all(full, ITEM_FILTERS)
        pts = vis.select("row_idx", *(PJ.coord(vis, a).alias(a) for a in "xyz"))
        cam = E.view_frame(E.bounding_box(pts)).first()
        tg = pts.groupBy((F.col("row_idx") % 16).alias("ray_id")).agg(
            *(((F.min(a) + F.max(a)) * 0.5).alias(f"t{a}") for a in "xyz"))
        rays = PK.normalise_rays(tg.select(F.col("ray_id").cast("string"), F.lit(cam.pos_x).alias("ox"),
                                           F.lit(cam.pos_y).alias("oy"), F.lit(cam.pos_z).alias("oz"),
                                           "tx", "ty", "tz"))
        run(PK.pick_points(pts, rays, threshold=5.0))
    timed("pick_points", pick)
    timed("progressive_domain", lambda: run(PG.progressive_domain(spark, item_path, IR)))

    lines = f"{catalog._written(spark, sf_dir, 'lines')}/*.gz"
    timed("split_with_header", lambda: TS.split_with_header(spark, lines, shared_dir(spark, "bench-split"), 10,
                                                            every_file_has_header=True))
    tsv = f"{catalog._written(spark, sf_dir, 'tsv')}/*.csv.gz"
    timed("ingest_raw_text", lambda: run_ingest(spark, tsv, shared_dir(spark, "bench-raw"), B.ROLES))

    # the registered catalog queries over the cells binding (sf tables)
    t0 = time.perf_counter()
    for name in ("filter_all", "attribute_domain", "legend_categorical", "render_cap", "frame_index"):
        run(catalog.QUERIES[name](spark, sf_dir))
    times["catalog_views"] = round(time.perf_counter() - t0, 3)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).replace("sf", ""), "rows_items": n_items,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
