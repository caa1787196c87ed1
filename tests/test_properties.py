"""Property tests: many random cases per Spark job, checked row by row
against plain-Python brute force."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudsift.functions import color as C
from cloudsift.operators import filters as FL
from cloudsift.operators import ranks as RK
from tests.jsref import category_color, gradient_color, js_hash

SETTINGS = settings(max_examples=5, deadline=None)


@SETTINGS
@given(st.lists(st.text(max_size=60), min_size=1, max_size=200))
def test_hash_and_colour_equal_reference(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = C.with_hash_rgb(df.withColumn("h", C.category_hash(F.col("v"))), "v").orderBy("i").collect()
    assert [r.h for r in out] == [js_hash(v) for v in values]
    assert [(r.r, r.g, r.b) for r in out] == [category_color(v) for v in values]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=200),
       st.floats(-1e3, 1e3, allow_nan=False), st.floats(1e-3, 1e3, allow_nan=False))
def test_gradient_equal_reference(spark, values, lo, width):
    hi = lo + width
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = C.with_gradient_rgb(df, "v", F.lit(lo), F.lit(hi)).orderBy("i").collect()
    assert [(r.r, r.g, r.b) for r in out] == [gradient_color(v, lo, hi) for v in values]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 40)), min_size=1, max_size=30))
def test_shard_and_part_sizes(spark, cases):
    rows = [(c, r) for c, (n, _) in enumerate(cases) for r in range(n)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "case int, row_idx long")
    for c, (n, k) in enumerate(cases):
        if n == 0:
            continue
        one = df.where(F.col("case") == c)
        floor_sizes = [x["count"] for x in RK.assign_shards(one, k).groupBy("shard").count().orderBy("shard").collect()]
        per = n // k
        expect = [n] if per == 0 else [per] * (k - 1) + [n - per * (k - 1)]
        assert floor_sizes == [s for s in expect if s > 0]
        even = [x["count"] for x in RK.assign_even_parts(one, k).groupBy("part").count().orderBy("part").collect()]
        base, rem = divmod(n, k)
        assert even == [s for s in [base + 1] * rem + [base] * (k - rem) if s > 0]
        break  # one case per example keeps each example to a few jobs


CATS = ["a", "b", "", None]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(CATS), st.one_of(st.none(), st.floats(0, 10, allow_nan=False))),
                min_size=1, max_size=200),
       st.lists(st.sampled_from(["a", "b", ""]), max_size=3),
       st.one_of(st.none(), st.tuples(st.floats(0, 10), st.floats(0, 10))))
def test_filters_equal_brute_force(spark, rows, values, rng):
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)], "i int, c string, t double")
    specs = [FL.FilterSpec(1, "c", "categorical", tuple(values)), FL.FilterSpec(2),
             FL.FilterSpec(3, "t", "continuous", None, rng)]
    got = sorted(r.i for r in FL.filter_all(df, specs).collect())

    def keep(c, t):
        if values and (c or "") not in values:
            return False
        if rng is not None and (t is None or not (rng[0] <= t <= rng[1])):
            return False
        return True

    assert got == [i for i, (c, t) in enumerate(rows) if keep(c, t)]


@SETTINGS
@given(st.lists(st.decimals(-10 ** 6, 10 ** 6, places=3, allow_nan=False).map(float), min_size=1, max_size=300))
def test_fixed_rounds_the_shortest_text_half_up(spark, values):
    from decimal import ROUND_HALF_UP, Decimal

    from cloudsift.functions.text import fixed
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for f in (0, 2, 4):
        got = [r.t for r in df.select("i", fixed("v", f).alias("t")).orderBy("i").collect()]
        for v, t in zip(values, got):
            want = Decimal(repr(v)).quantize(Decimal(1).scaleb(-f), ROUND_HALF_UP)
            assert Decimal(t) == want, (v, f, t)
