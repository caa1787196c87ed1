
from cloudsift.operators import filters as FL
from cloudsift.operators import profile as PF
from cloudsift.roles import BINDING_ROLES as R


def _df(spark):
    rows = [(0, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (3, None, None), (4, "", 2.5)]
    return spark.createDataFrame(rows, "row_idx long, structure string, t double")


def test_empty_value_set_keeps_all(spark):
    df = _df(spark)
    spec = FL.FilterSpec(1, "structure", "categorical", ())
    assert FL.filter_all(df, [spec]).count() == 5


def test_all_values_filter_drops_null_without_empty_in_domain(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None)], "row_idx long, structure string")
    dom = [r.value for r in PF.attribute_domain(df, R, ("structure",)).collect()]
    spec = FL.default_spec(1, "structure", R, domain_values=dom)
    assert sorted(r.row_idx for r in FL.filter_all(df, [spec]).collect()) == [0, 1, 2]
    # with '' in the domain a null row matches it
    semi = FL.filter_semi(_df(spark), "structure", PF.attribute_domain(_df(spark), R, ("structure",)))
    assert semi.count() == 5


def test_range_ends_inclusive_null_dropped(spark):
    df = _df(spark)
    out = FL.filter_all(df, [FL.FilterSpec(1, "t", "continuous", None, (1.0, 3.0))])
    assert sorted(r.row_idx for r in out.collect()) == [0, 1, 2, 4]


def test_skip_rules(spark):
    df = _df(spark)
    specs = [FL.FilterSpec(1), FL.FilterSpec(2, "t", "continuous"), FL.FilterSpec(3, "structure", None, ("a",))]
    assert FL.filter_all(df, specs).count() == 5
    specs = FL.add_filter([])
    assert specs[0].attribute is None and not specs[0].is_active()
    assert FL.remove_filter([FL.FilterSpec(1), FL.FilterSpec(2)], 1) == [FL.FilterSpec(2)]


def test_null_and_empty_are_one_value(spark):
    df = _df(spark)
    out = FL.filter_all(df, [FL.FilterSpec(1, "structure", "categorical", ("",))])
    assert sorted(r.row_idx for r in out.collect()) == [3, 4]


def test_funnel_counts(spark):
    df = _df(spark)
    specs = [FL.FilterSpec(1, "structure", "categorical", ("a", "b", "")),
             FL.FilterSpec(2), FL.FilterSpec(3, "t", "continuous", None, (2.0, 9.0))]
    rows = {r.step: (r.n_before, r.n_after, r.applied) for r in FL.filter_funnel(df, specs).collect()}
    assert rows[0] == (5, 2, True)
    assert rows[1] == (5, 4, True)
    assert rows[2] == (4, 4, False)
    assert rows[3] == (4, 2, True)


def test_range_push(spark):
    s = FL.FilterSpec(1, "t", "continuous", None, (1.0, 3.0))
    assert FL.push_range(s, "min", 5.0).range == (5.0, 5.0)
    assert FL.push_range(s, "max", 0.5).range == (0.5, 0.5)
    assert FL.push_range(s, "min", 2.0).range == (2.0, 3.0)


def test_frame_filter_null_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, None)], "row_idx long, time_rank short")
    assert sorted(r.row_idx for r in FL.filter_frame(df, "time_rank", 0).collect()) == [0, 2]
