import math

from pyspark.sql import functions as F

from cloudsift.operators import extent as E
from cloudsift.operators import frames as FR
from cloudsift.operators import legend as LG
from cloudsift.operators import pick as PK
from cloudsift.operators import profile as PF
from cloudsift.operators import project as PJ
from cloudsift.roles import BINDING_ROLES as R
from cloudsift.roles import REFERENCE_ROLES
from tests.jsref import category_color


def test_missing_coordinate_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, None)], "transformedX double, transformedZ double, transformedY double")
    out = PJ.map_axes(df, REFERENCE_ROLES, "transformedX", "Adj_transformedZ", "transformedY").first()
    assert (out.x, out.y, out.z) == (1.0, 0.0, 0.0)


def test_unknown_role_name_raises(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    try:
        PJ.map_axes(df, R, "nope", "x", "x")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_frames_null_rank_in_frame_zero(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (5,)], "time_rank short")
    counts = {r.time_rank: r.n for r in FR.frame_counts(df, "time_rank").collect()}
    assert counts == {0: 2, 1: 1, 5: 1}
    idx = FR.frame_index(df, "time_rank").orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.time_rank, r.next_idx) for r in idx] == [(0, 0, 1), (1, 1, 2), (2, 5, 0)]
    assert idx[2].label == "TimeRank: 5 (3/3)"
    assert FR.frame_at(FR.frame_index(df, "time_rank"), 7).count() == 0


def test_range_nan_and_flat_step(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "t double")
    r = PF.attribute_range(df, R).first()
    assert (r.min_value, r.max_value) == (1.0, 3.0) and math.isclose(r.step, 0.002)
    flat = PF.attribute_range(spark.createDataFrame([(1.0,), (1.0,)], "t double"), R).first()
    assert flat.step == 1e-4


def test_legend_150_values(spark):
    dom = spark.createDataFrame([("gene", f"g{i:03d}", 1) for i in range(150)], "attribute string, value string, n long")
    leg = LG.legend_categorical(dom, "gene", limit=100).orderBy("ord").collect()
    assert len(leg) == 101
    assert leg[-1].label == "... and 50 more"
    assert leg[0].value == "g000" and (leg[0].r, leg[0].g, leg[0].b) == category_color("g000")


def test_legend_string_order_and_empty_label(spark):
    dom = spark.createDataFrame([("c", "9", 1), ("c", "10", 1), ("c", "", 1), ("c", "B", 1), ("c", "a", 1)],
                                "attribute string, value string, n long")
    leg = LG.legend_categorical(dom, "c").orderBy("ord").collect()
    assert [r.value for r in leg] == ["", "10", "9", "B", "a"]
    assert leg[0].label == "(empty)"


def test_legend_continuous_stops(spark):
    rng = spark.createDataFrame([("t", 0.0, 10.0, 0.01)], "attribute string, min_value double, max_value double, step double")
    stops = LG.legend_continuous(rng, "t").orderBy("stop").collect()
    assert len(stops) == 101 and stops[0].value == 0.0 and stops[-1].value == 10.0
    assert (stops[0].min_label, stops[0].max_label) == ("0.0000", "10.0000")
    empty = rng.where(F.lit(False))
    assert LG.legend_continuous(empty, "t").count() == 0


def test_view_frame_fit(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (200.0, 100.0, 10.0)], "x double, y double, z double")
    box = E.bounding_box(df).first()
    assert (box.center_x, box.size_x, box.xy_extent) == (100.0, 200.0, 200.0)
    fr = E.view_frame(E.bounding_box(df)).first()
    expect = max(100 / math.tan(math.radians(75) / 2) * 1.1, 15.0, 100.0)
    assert math.isclose(fr.height, expect) and math.isclose(fr.pos_z, 5.0 + expect)


def test_pick_nearest_along_ray_ties_by_row(spark):
    pts = spark.createDataFrame(
        [(0, 0.0, 0.0, 10.0), (1, 0.0, 0.0, 5.0), (2, 0.5, 0.0, 5.0), (3, 50.0, 50.0, 50.0)],
        "row_idx long, x double, y double, z double")
    rays = spark.createDataFrame([("r1", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("miss", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)],
                                 "ray_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.ray_id: r.row_idx for r in PK.pick_points(pts, rays, threshold=1.0).collect()}
    assert got == {"r1": 1}
    tie = spark.createDataFrame([(7, 0.3, 0.0, 5.0), (4, -0.3, 0.0, 5.0)], "row_idx long, x double, y double, z double")
    assert PK.pick_points(tie, rays.where("ray_id = 'r1'"), threshold=1.0).first().row_idx == 4


def _pick_brute(pts, rays, thr):
    out = {}
    for ray, ox, oy, oz, dx, dy, dz in rays:
        for i, x, y, z in pts:
            t = (x - ox) * dx + (y - oy) * dy + (z - oz) * dz
            c = (ox, oy, oz) if t < 0 else (dx * t + ox, dy * t + oy, dz * t + oz)
            if sum((a - b) ** 2 for a, b in zip(c, (x, y, z))) < thr * thr:
                h = (math.sqrt(sum((a - b) ** 2 for a, b in zip((ox, oy, oz), c))), i)
                out[ray] = min(out.get(ray, h), h)
    return {k: v[1] for k, v in out.items()}


def test_pick_equals_brute_force(spark):
    """Random points and rays: origins inside and outside the box, points
    behind origins, axis-parallel and slanted rays, small and large radius."""
    import random
    rng = random.Random(9)
    pts = [(i, *(float(rng.randint(-200, 200)) / 4 for _ in range(3))) for i in range(400)]
    rays = []
    for k in range(200):
        d = rng.choice([(1, 0, 0), (0, -1, 0), (0, 0, 1), None, None, None])
        d = d or tuple(rng.uniform(-1, 1) for _ in range(3))
        n = math.sqrt(sum(x * x for x in d))
        rays.append((f"r{k}", *(rng.uniform(-90, 90) for _ in range(3)), *(x / n for x in d)))
    p = spark.createDataFrame(pts, "row_idx long, x double, y double, z double")
    r = spark.createDataFrame(rays, "ray_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    for thr in (0.5, 5.0, 40.0):
        out = PK.pick_points(p, r, threshold=thr)
        assert {x.ray_id: x.row_idx for x in out.collect()} == _pick_brute(pts, rays, thr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert PK.pick_points(p.where("row_idx < 0"), r).count() == 0


def test_dense_cells_are_split(spark):
    """Half of the points in one grid cell and many at one position: every
    leaf stays within its size, and each ray finds the point that the uniform
    grid finds."""
    import random
    rng = random.Random(4)
    pts = [(rng.uniform(-500, 500), rng.uniform(-500, 500), rng.uniform(-50, 50)) for _ in range(4000)]
    pts += [(rng.uniform(1, 9), rng.uniform(1, 9), rng.uniform(1, 9)) for _ in range(5000)] + [(100.0, 100.0, 0.0)] * 1500
    pts = [(i, *p) for i, p in enumerate(pts)]
    rays = []
    for k in range(60):
        goal, src = rng.choice(pts)[1:], [rng.uniform(-600, 600) for _ in range(3)]
        d = [g - o + rng.uniform(-1, 1) for g, o in zip(goal, src)]
        n = math.sqrt(sum(x * x for x in d))
        rays.append((f"r{k}", *src, *(x / n for x in d)))
    p = spark.createDataFrame(pts, "row_idx long, x double, y double, z double")
    r = spark.createDataFrame(rays, "ray_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    same = lambda d: sorted(map(tuple, d.collect()))
    for thr in (0.3, 5.0):
        assert same(PK.pick_points(p, r, thr, cell_rows=200, levels=3)) == same(PK.pick_points(p, r, thr))
    q = p.select("row_idx", *(F.col(c).cast("float").cast("double").alias(f"_p{c}") for c in "xyz"))
    dense = PK.dense_cells(q, 20.0, 200, 3)
    leaf = PK._leaves(q, dense, 20.0, 200, 3, "row_idx").groupBy("_level", "_c0", "_c1", "_c2", "_salt").count()
    assert leaf.agg(F.sum("count")).first()[0] == len(pts) and leaf.agg(F.max("count")).first()[0] <= 200


def test_fetch_rows(spark):
    df = spark.range(0, 30000, 2).select(F.col("id").alias("row_idx"), F.col("id").cast("double").alias("x"))
    ords = spark.createDataFrame([(0,), (5,), (5,), (14999,), (20000,)], "ordinal long")
    assert sorted(map(tuple, PK.fetch_rows(df, ords).select("ordinal", "row_idx", "x").collect())) == \
        [(0, 0, 0.0), (5, 10, 10.0), (14999, 29998, 29998.0)]


def test_defaults_keep_everything(spark):
    from cloudsift.operators.export import render_cap
    dom = spark.createDataFrame([("g", f"v{i:04d}", 1) for i in range(150)], "attribute string, value string, n long")
    leg = LG.legend_categorical(dom, "g").orderBy("ord").collect()
    assert [r.value for r in leg] == [f"v{i:04d}" for i in range(150)]
    assert LG.legend_categorical(dom, "g", limit=100).count() == 101
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    assert render_cap(df).count() == 1000
    far = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(20000)], "ordinal long, x double, y double, z double")
    assert E.extent_head(far).first().max_x == 19999.0 and E.extent_head(far, 10).first().max_x == 9.0
    assert E.extent_stride(far.withColumnRenamed("ordinal", "row_idx")).first().target_x == 19999 / 2
