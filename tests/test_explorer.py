from pyspark.sql import functions as F

from cloudsift.plans import bindings as B
from cloudsift.plans.explorer import Explorer
from tests.conftest import SF_TINY


def test_explorer_workflow(spark):
    ex = Explorer(spark, B.shards_path(spark, SF_TINY), B.ROLES)
    ex.set_sample_rate(30)
    assert ex.loaded_shards == 3
    ex.set_sample_rate(10)
    assert ex.loaded_shards == 3  # high-water mark
    fid = ex.add_filter("structure", ("click", "view", ""))
    ex.add_filter("t", value_range=(10.0, 400.0))
    ex.add_filter()  # empty: skipped
    n_vis = ex.visible().count()
    funnel = {r.step: r.n_after for r in ex.funnel().collect()}
    assert funnel[0] == n_vis
    ex.color_by = "structure"
    ex.overrides = {"click": "#ff0000"}
    ren = ex.render().collect()
    assert len(ren) == n_vis
    clicks = ex.render().join(ex.visible().select("row_idx", "structure"), "row_idx") \
        .where(F.col("structure") == "click").select("r", "g", "b").distinct().collect()
    assert [tuple(r) for r in clicks] == [(255, 0, 0)]
    assert ex.legend().count() >= 1
    assert ex.fit_view().count() == 1
    assert ex.frames().count() == ex.loaded().select(F.coalesce("time_rank", F.lit(0))).distinct().count()
    rays = spark.createDataFrame([("r", 0.0, 0.0, -100.0, 0.0, 0.0, 1.0)],
                                 "ray_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    assert ex.pick(rays, point_size=1000.0).count() == 1
    ex.remove_filter(fid)
    assert ex.visible().count() >= n_vis
    ex.color_by = "t"
    assert ex.legend().count() == 101


def test_explorer_colours_frames_and_filters(spark):
    ex = Explorer(spark, B.shards_path(spark, SF_TINY), B.ROLES, loaded_shards=10)
    ex.color_by = "structure"
    plain = {r.value: (r.r, r.g, r.b) for r in ex.legend().collect()}
    ex.randomise_colours("structure", seed=7)
    dealt = {r.value: (r.r, r.g, r.b) for r in ex.legend().collect()}
    assert dealt.keys() == plain.keys() and dealt != plain
    drawn = ex.render().join(ex.visible().select("row_idx", "structure"), "row_idx").where("structure is not null")
    assert {(r.structure, (r.r, r.g, r.b)) for r in drawn.select("structure", "r", "g", "b").distinct().collect()} == set(dealt.items())
    # the frame reaches picking and fitting
    rank = ex.frames().where("frame_idx = 3").first().time_rank
    n = ex.visible(rank).count()
    assert 0 < n < ex.visible().count() and ex.render(rank).count() == n
    rays = spark.createDataFrame([("r", 0.0, 0.0, -100.0, 0.0, 0.0, 1.0)],
                                 "ray_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    hit = ex.pick(rays, point_size=1000.0, frame_rank=rank).first()
    assert hit.row_idx in {r.row_idx for r in ex.visible(rank).select("row_idx").collect()} and hit.details
    box = ex.visible().agg(((F.min(F.coalesce("x", F.lit(0.0))) + F.max(F.coalesce("x", F.lit(0.0)))) / 2).alias("x")).first()
    assert abs(ex.fit_view().first().target_x - box.x) < 1e-9           # all points, not a sample
    # default filters, select and deselect all, pushed ranges
    f, g = ex.default_filter("structure"), ex.default_filter("t")
    lo, hi = next(s.range for s in ex.filters if s.id == g)
    # '' is one of the values, so rows without a structure stay (null is '')
    assert ex.visible().count() == ex.loaded().where("t is not null").count() < ex.loaded().count()
    ex.deselect_all(f)
    assert ex.visible().count() == ex.loaded().where("t is not null").count()
    ex.select_all(f).move_range(g, "min", hi + 5)
    assert next(s.range for s in ex.filters if s.id == g) == (hi + 5, hi + 5)
    assert ex.visible().count() == 0


def test_all_values_of_a_large_domain_are_not_listed(spark, monkeypatch):
    from cloudsift.plans import explorer
    for attribute in ("structure", "cell_type"):
        listed, whole = (Explorer(spark, B.shards_path(spark, SF_TINY), B.ROLES, loaded_shards=10) for _ in range(2))
        f = listed.default_filter(attribute)
        monkeypatch.setattr(explorer, "MAX_LISTED", 1)
        g = whole.default_filter(attribute)
        assert whole.filters[-1].values == () and whole.filters[-1].is_active()
        rows = lambda ex: sorted(r.row_idx for r in ex.visible().select("row_idx").collect())
        assert rows(listed) == rows(whole) and sorted(map(tuple, listed.funnel().collect())) == sorted(map(tuple, whole.funnel().collect()))
        whole.deselect_all(g)
        assert not whole.filters[-1].is_active()
        whole.select_all(g)
        assert rows(listed) == rows(whole)
        monkeypatch.undo()
        assert f == g
