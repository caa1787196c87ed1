"""Ray picking (J5) and ordinal lookups.

A point is a hit of a ray when its squared distance to the ray is strictly
below threshold²; a point behind the origin is measured to the origin. Hits
are ordered by the distance from the origin to the closest point on the ray,
ties by load order; the first hit per ray wins. Positions are the float32
render positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.operators.ranks import visible_ordinal
from cloudsift.session import small_or_whole

# Default point size and the picking radius per unit of size.
POINT_SIZE = 1.0
THRESHOLD_PER_SIZE = 5.0
MAX_SLABS = 256         # grid cells along the box's longest side
CELL_ROWS = 500_000     # points of a cell before it is split
LEVELS = 3              # times that a cell is split in eight


def normalise_rays(rays: DataFrame) -> DataFrame:
    """(ray_id, ox, oy, oz, tx, ty, tz) through a target → unit direction."""
    dx, dy, dz = (F.col("tx") - F.col("ox"), F.col("ty") - F.col("oy"), F.col("tz") - F.col("oz"))
    norm = F.sqrt(dx * dx + dy * dy + dz * dz)
    return rays.select("ray_id", "ox", "oy", "oz", (dx / norm).alias("dx"), (dy / norm).alias("dy"),
                       (dz / norm).alias("dz")).where(norm > 0)


def _f32(c: str) -> Column:
    return F.col(c).cast("float").cast("double")


def _ray_cells(rays: DataFrame, low: list[float], high: list[float], edge: float, reach: float) -> DataFrame:
    """The grid cells inside the box in which a hit of each ray can lie.

    Along the ray's longest direction the box is cut into slabs of one cell;
    within a slab (widened by ``reach``) the ray's other two coordinates span
    an interval, which is widened by ``reach`` too. A hit is less than
    ``reach`` away from its closest point on the ray, so it lies in there. The
    ray starts at its origin, so slabs behind it count up to ``reach``."""
    r = rays.withColumns({"_o": F.array("ox", "oy", "oz"), "_d": F.array("dx", "dy", "dz"),
                          "_lo": F.array(*map(F.lit, low)), "_hi": F.array(*map(F.lit, high))})
    ax, ay, az = (F.abs(F.col(c)) for c in ("dx", "dy", "dz"))
    r = r.withColumn("_a", F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2))
    r = r.withColumns({"_b": (F.col("_a") + 1) % 3, "_c": (F.col("_a") + 2) % 3})
    at = lambda arr, i: F.get(F.col(arr), F.col(i))
    cell = lambda x: F.floor(x / edge).cast("bigint")
    o, d, lo, hi = (at(arr, "_a") for arr in ("_o", "_d", "_lo", "_hi"))
    first = F.when(d > 0, F.greatest(lo, o - reach)).otherwise(lo)
    last = F.when(d > 0, hi).otherwise(F.least(hi, o + reach))
    r = r.withColumns({"_k0": cell(first), "_k1": cell(last)}).where(F.col("_k0") <= F.col("_k1"))
    r = r.withColumn("_k", F.explode(F.sequence("_k0", "_k1")))
    # the ray's parameter where it enters and leaves the widened slab, not before its origin
    t1 = ((F.col("_k") * edge - reach) - at("_o", "_a")) / at("_d", "_a")
    t2 = (((F.col("_k") + 1) * edge + reach) - at("_o", "_a")) / at("_d", "_a")
    r = r.withColumns({"_t0": F.greatest(F.least(t1, t2), F.lit(0.0)), "_t1": F.greatest(F.greatest(t1, t2), F.lit(0.0))})
    for axis, name in (("_b", "_kb"), ("_c", "_kc")):
        p = at("_o", axis) + at("_d", axis) * F.col("_t0")
        q = at("_o", axis) + at("_d", axis) * F.col("_t1")
        a = F.greatest(F.least(p, q) - reach, at("_lo", axis))
        b = F.least(F.greatest(p, q) + reach, at("_hi", axis))
        r = r.withColumns({"_ka": cell(a), "_kz": cell(b)}).where(F.col("_ka") <= F.col("_kz"))
        r = r.withColumn(name, F.explode(F.sequence("_ka", "_kz")))
    pick = lambda axis: F.when(F.col("_a") == axis, F.col("_k")).when(F.col("_b") == axis, F.col("_kb")).otherwise(F.col("_kc"))
    return r.select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz", *(pick(i).alias(f"_c{i}") for i in range(3)))


def _cell(c: str, edge: float) -> Column:
    return F.floor(F.col(c) / edge).cast("bigint")


def dense_cells(points: DataFrame, edge: float, limit: int, levels: int = LEVELS) -> DataFrame:
    """Cells of the octree (level, c0, c1, c2, n) with more than ``limit``
    points; level l has an edge of ``edge`` / 2^l. One count of the finest
    cells (a partial aggregation) gives the coarser ones. At most
    (levels + 1) * points / limit rows."""
    fine = points.groupBy(*(_cell(c, edge / 2 ** levels).alias(f"f{i}") for i, c in enumerate(("_px", "_py", "_pz")))).agg(F.count(F.lit(1)).alias("n"))
    up = fine.select("n", *(f"f{i}" for i in range(3)), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    coarse = [F.call_function("shiftright", F.col(f"f{i}"), F.lit(levels) - F.col("level")).alias(f"c{i}") for i in range(3)]
    return up.groupBy("level", *coarse).agg(F.sum("n").alias("n")).where(F.col("n") > limit)


def _leaves(points: DataFrame, dense: DataFrame, edge: float, limit: int, levels: int, idx: str) -> DataFrame:
    """Each point with its leaf: the first cell on the way down that is not
    dense; in a finest cell that still is (copies of a position), a number by
    row spreads the points."""
    out = points.withColumns({"_level": F.lit(0), "_salt": F.lit(0).cast("bigint")})
    for level in range(levels + 1):
        here = dense.where(F.col("level") == level).select(*(F.col(f"c{i}").alias(f"_d{i}") for i in range(3)), F.col("n").alias("_dn"))
        on = F.col("_level") == level
        for i, c in enumerate(("_px", "_py", "_pz")):
            on = on & (_cell(c, edge / 2 ** level) == F.col(f"_d{i}"))
        out = out.join(here, on, "left")
        if level < levels:
            out = out.withColumn("_level", F.when(F.col("_dn").isNotNull(), level + 1).otherwise(F.col("_level")))
        else:
            out = out.withColumn("_salt", F.coalesce(F.pmod(F.col(idx), F.ceil(F.col("_dn") / limit)), F.lit(0)).cast("bigint"))
        out = out.drop("_d0", "_d1", "_d2", "_dn")
    at = lambda c: F.floor(F.col(c) / (F.lit(edge) / F.pow(F.lit(2.0), F.col("_level")))).cast("bigint")
    return out.withColumns({f"_c{i}": at(c) for i, c in enumerate(("_px", "_py", "_pz"))})


def _ray_leaves(rays: DataFrame, dense: DataFrame, low: list[float], high: list[float], edge: float, reach: float, limit: int, levels: int) -> DataFrame:
    """The leaves that each ray passes: its cells of level 0, and of each finer
    level those whose parent is dense (then all further ancestors are)."""
    ray, found = rays, None
    names = ["ray_id", "ox", "oy", "oz", "dx", "dy", "dz", "_c0", "_c1", "_c2"]
    for level in range(levels + 1):
        cells = _ray_cells(ray, low, high, edge / 2 ** level, reach).select(*names)
        if level:
            parent = dense.where(F.col("level") == level - 1).select(*(F.col(f"c{i}").alias(f"_d{i}") for i in range(3)))
            on = [F.call_function("shiftright", F.col(f"_c{i}"), F.lit(1)) == F.col(f"_d{i}") for i in range(3)]
            cells = cells.join(parent, on[0] & on[1] & on[2], "left_semi")
        here = dense.where(F.col("level") == level).select(*(F.col(f"c{i}").alias(f"_c{i}") for i in range(3)), F.col("n").alias("_dn"))
        cells = cells.join(here, ["_c0", "_c1", "_c2"], "left").withColumn("_level", F.lit(level))
        if level < levels:
            cells = cells.where(F.col("_dn").isNull()).withColumn("_salt", F.lit(0).cast("bigint"))
        else:
            parts = F.coalesce(F.ceil(F.col("_dn") / limit), F.lit(1)).cast("bigint")
            cells = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        cells = cells.select(*names, "_level", "_salt")
        found = cells if found is None else found.unionAll(cells)
    return found


def pick_points(points: DataFrame, rays: DataFrame, threshold: float = POINT_SIZE * THRESHOLD_PER_SIZE,
                idx: str = "row_idx", cell_rows: int = CELL_ROWS, levels: int = LEVELS) -> DataFrame:
    """For each ray, the nearest point along it within the radius:
    (ray_id, <idx>, distance).

    Points get the cell of a grid over their box; each ray becomes the cells
    it passes inside the box; both meet in an equi-join on the cell, the exact
    predicate follows. A cell with more than ``cell_rows`` points is split in
    eight, up to ``levels`` times, and a finest cell that still holds more is
    dealt by row, so no cell holds more than ``cell_rows``. Neither side is
    broadcast (the few dense cells are, when they are measured to be small),
    there is no loop over rays, and the winner of a ray is a partially
    aggregated min."""
    p = points.select(idx, _f32("x").alias("_px"), _f32("y").alias("_py"), _f32("z").alias("_pz"))
    box = p.agg(*(f(c).alias(f"{n}{c}") for c in ("_px", "_py", "_pz") for n, f in (("lo", F.min), ("hi", F.max))), F.count(F.lit(1)).alias("rows")).first()
    low, high = ([box[f"{n}{c}"] for c in ("_px", "_py", "_pz")] for n in ("lo", "hi"))
    if None in low:
        return rays.select("ray_id", F.lit(0).cast("bigint").alias(idx), F.lit(0.0).alias("distance")).limit(0)
    edge = max(4 * threshold, max(h - l for l, h in zip(low, high)) / MAX_SLABS, 1e-9)
    # a little more than the radius, so that rounding cannot lose a cell
    reach = threshold * (1 + 1e-9) + 1e-9 * max(map(abs, [*low, *high, 1.0]))
    if box.rows <= cell_rows:                                # no cell can be dense
        cells = p.withColumns({f"_c{i}": _cell(c, edge) for i, c in enumerate(("_px", "_py", "_pz"))})
        both = cells.join(_ray_cells(rays, low, high, edge, reach).hint("shuffle_merge"), ["_c0", "_c1", "_c2"])
    else:
        dense = small_or_whole(dense_cells(p, edge, cell_rows, levels))
        cells = _leaves(p, dense, edge, cell_rows, levels, idx)
        passed = _ray_leaves(rays, dense, low, high, edge, reach, cell_rows, levels)
        both = cells.join(passed.hint("shuffle_merge"), ["_level", "_c0", "_c1", "_c2", "_salt"])
    t = ((F.col("_px") - F.col("ox")) * F.col("dx") + (F.col("_py") - F.col("oy")) * F.col("dy")
         + (F.col("_pz") - F.col("oz")) * F.col("dz"))
    behind = t < 0
    cx = F.when(behind, F.col("ox")).otherwise(F.col("dx") * t + F.col("ox"))
    cy = F.when(behind, F.col("oy")).otherwise(F.col("dy") * t + F.col("oy"))
    cz = F.when(behind, F.col("oz")).otherwise(F.col("dz") * t + F.col("oz"))
    ex, ey, ez = cx - F.col("_px"), cy - F.col("_py"), cz - F.col("_pz")
    fx, fy, fz = F.col("ox") - cx, F.col("oy") - cy, F.col("oz") - cz
    hits = both.where(ex * ex + ey * ey + ez * ez < F.lit(threshold * threshold))
    along = F.sqrt(fx * fx + fy * fy + fz * fz)
    best = hits.groupBy("ray_id").agg(F.min(F.struct(along.alias("distance"), F.col(idx).alias(idx))).alias("h"))
    return best.select("ray_id", F.col(f"h.{idx}").alias(idx), F.col("h.distance").alias("distance"))


def fetch_rows(visible: DataFrame, ordinals: DataFrame, idx: str = "row_idx") -> DataFrame:
    """From ordinals in the rendered (visible, load-ordered) set back to
    source rows, exactly. Only ``idx`` is ranked; the wanted ordinals meet the
    ranks in an equi-join, and the found positions their rows. One plan at all
    sizes."""
    wanted = ordinals.select(F.col("ordinal").cast("bigint")).distinct()
    found = visible_ordinal(visible.select(idx), idx=idx).join(wanted, "ordinal")
    return visible.join(found, idx)
