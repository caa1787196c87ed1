from pyspark.sql import functions as F

from cloudsift.functions import color as C
from cloudsift.operators import palette as PL
from cloudsift.roles import BINDING_ROLES
from tests.jsref import category_color, gradient_color, js_hash

HASH_CASES = [("Structure", -2146480813), ("a", 97), ("", 0), ("Krt14", 72773296),
              ("Basal_keratinocyte_IFE", 3293788559), ("x" * 400, -5685725184)]


def test_hash_fixtures(spark):
    df = spark.createDataFrame([(s,) for s, _ in HASH_CASES], "v string")
    got = [r.h for r in df.select(C.category_hash(F.col("v")).alias("h")).collect()]
    assert got == [h for _, h in HASH_CASES]
    assert [js_hash(s) for s, _ in HASH_CASES] == [h for _, h in HASH_CASES]


def test_hash_non_ascii_matches_utf16_reference(spark):
    vals = ["é", "Gène", "細胞", "😀x", "ß" * 50]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.h for r in df.select(C.category_hash(F.col("v")).alias("h")).collect()]
    assert got == [js_hash(v) for v in vals]


def test_category_colors_match_reference(spark):
    vals = ["click", "view", "g1", "g150", "HF3", "S0", "", None, "Krt14", "x" * 40]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    out = C.with_hash_rgb(df, "v").collect()
    assert [(r.r, r.g, r.b) for r in out] == [category_color(v) for v in vals]


def test_gradient_and_flat_fallback(spark):
    rows = [(v, 0.5, 300.25) for v in (0.5, 1.0, 100.0, 300.25, None)] + [(1.0, 1.0, 1.0), (2.5, 2.5, 2.5)]
    df = spark.createDataFrame(rows, "v double, lo double, hi double")
    out = C.with_gradient_rgb(df, "v", F.col("lo"), F.col("hi")).collect()
    assert [(r.r, r.g, r.b) for r in out] == [gradient_color(v, lo, hi) for v, lo, hi in rows]
    # flat range: colour of the text "1" (no ".0")
    assert gradient_color(1.0, 1.0, 1.0) == category_color("1")


def test_null_color_and_hex_roundtrip(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "v string")
    out = C.with_hash_rgb(df, "v").select(C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("h"))
    hexes = [r.h for r in out.collect()]
    assert hexes[:2] == ["#888888", "#888888"]
    back = spark.createDataFrame([(h,) for h in hexes], "h string").select(C.hex_rgb8(F.col("h")).alias("c"))
    assert [tuple(r.c) for r in back.collect()] == [(136, 136, 136), (136, 136, 136), category_color("a")]


def test_palette_override_wins(spark):
    dom = spark.createDataFrame([("structure", "a", 1), ("structure", "b", 2)], "attribute string, value string, n long")
    pal = PL.build_palette(dom, "structure")
    out = PL.palette_override(pal, PL.overrides_table(spark, "structure", {"a": "#ff0000"}))
    got = {r.value: (r.r, r.g, r.b) for r in out.collect()}
    assert got["a"] == (255, 0, 0) and got["b"] == category_color("b")


def test_hue_assignment_is_a_permutation(spark):
    dom = spark.createDataFrame([("gene", f"g{i}", 1) for i in range(37)], "attribute string, value string, n long")
    out = PL.hue_assignment(dom, "gene", BINDING_ROLES).collect()
    assert sorted(r.perm for r in out) == list(range(37))
    try:
        PL.hue_assignment(dom, "t", BINDING_ROLES)
        raise AssertionError("continuous must be refused")
    except ValueError:
        pass
