"""The viewer's workflow in one object: a sharded dataset, a sample rate
(high-water mark of loaded shards), an ordered filter list, a colour-by
attribute, frames, legends, picking and export. Methods return DataFrames
built from the operators. Small tables (domains, ranges, palettes, value sets)
are staged in the shared folder on first use, so ``render``, ``legend`` and
``pick`` run small jobs of their own; nothing is collected but bounded values
(two numbers per range, six of a box)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators import extent as E
from cloudsift.operators import filters as FL
from cloudsift.operators import frames as FR
from cloudsift.operators import legend as LG
from cloudsift.operators import palette as PL
from cloudsift.operators import pick as PK
from cloudsift.operators import profile as PF
from cloudsift.operators import project as PJ
from cloudsift.operators.export import export_points, render_table
from cloudsift.roles import Roles
from cloudsift.session import small_or_whole, staged
from cloudsift.sources import shards as SH

MAX_LISTED = 10_000      # values of a domain that a filter lists


@dataclass
class Explorer:
    spark: SparkSession
    path: str
    roles: Roles
    n_shards: int = 10
    loaded_shards: int = 1
    filters: list[FL.FilterSpec] = field(default_factory=list)
    color_by: str | None = None
    axes: tuple[str | None, str | None, str | None] = (None, None, None)
    overrides: dict[str, str] = field(default_factory=dict)
    cap: int | None = None          # render all visible rows, or the first ``cap``
    random_colours: dict[str, int] = field(default_factory=dict)        # attribute -> seed (W7)
    _profiles: dict = field(default_factory=dict, repr=False)

    # ---- loading
    def set_sample_rate(self, pct: float) -> Explorer:
        """Shards for a percent; a lower rate keeps what is loaded."""
        self.loaded_shards = max(self.loaded_shards, SH.shards_for_rate(pct, self.n_shards))
        return self

    def loaded(self) -> DataFrame:
        return SH.read_shards(self.spark, self.path, self.loaded_shards)

    # ---- filters (F1–F8)
    def add_filter(self, attribute: str | None = None, values=None, value_range=None) -> int:
        self.filters = FL.add_filter(self.filters)
        spec = self.filters[-1]
        if attribute:
            kind = "continuous" if attribute in self.roles.continuous else "categorical"
            spec = FL.FilterSpec(spec.id, attribute, kind, tuple(values) if values is not None else None,
                                 tuple(value_range) if value_range is not None else None)
            self.filters[-1] = spec
        return spec.id

    def default_filter(self, attribute: str) -> int:
        """a filter on an attribute with all its values, or its full range
        ([0, 1] without data). Up to ``MAX_LISTED`` values are listed, so that
        one can take some away; of a larger domain (an id) none is collected,
        and the filter stands for all of them."""
        self.filters = FL.add_filter(self.filters)
        values = span = whole = None
        if attribute in self.roles.continuous:
            r = self.ranges().where(F.col("attribute") == attribute).first()
            span = (r.min_value, r.max_value) if r else None
        else:
            values, whole = self._values(attribute)
        self.filters[-1] = replace(FL.default_spec(self.filters[-1].id, attribute, self.roles, values, span), whole=whole)
        return self.filters[-1].id

    def _values(self, attribute: str) -> tuple[tuple[str, ...], str | None]:
        """(the values, None), or for more than MAX_LISTED ((), what stands for
        all of them)."""
        values = self.domain().where(F.col("attribute") == attribute).select("value")
        if values.count() <= MAX_LISTED:
            return tuple(r.value for r in values.orderBy("value").collect()), None
        return (), "values" if values.where("value = ''").isEmpty() else "empty"

    def _change(self, filter_id: int, change) -> Explorer:
        self.filters = [change(s) if s.id == filter_id else s for s in self.filters]
        return self

    def select_all(self, filter_id: int) -> Explorer:
        """All values of the filter's attribute."""
        def change(s):
            values, whole = self._values(s.attribute)
            return replace(s, values=values, whole=whole)
        return self._change(filter_id, change)

    def deselect_all(self, filter_id: int) -> Explorer:
        """No value: the filter is skipped."""
        return self._change(filter_id, lambda s: replace(s, values=(), whole=None))

    def move_range(self, filter_id: int, end: str, value: float) -> Explorer:
        """set one end ('min' or 'max'); it drags the other end along."""
        return self._change(filter_id, lambda s: FL.push_range(s, end, value))

    def remove_filter(self, filter_id: int) -> Explorer:
        self.filters = FL.remove_filter(self.filters, filter_id)
        return self

    def visible(self, frame_rank: int | None = None) -> DataFrame:
        """Rows that pass the filters, of one frame if a rank is given."""
        vis = FL.filter_all(self.loaded(), self.filters)
        if frame_rank is not None and self.roles.frame_key:
            vis = FL.filter_frame(vis, self.roles.frame_key, frame_rank)
        return vis

    def funnel(self) -> DataFrame:
        return FL.filter_funnel(self.loaded(), self.filters)

    # ---- profiles (A3, A4): computed once per loaded set, kept as small
    # checkpointed tables in the shared folder (reused by palette, legend,
    # default filters and colours)
    def _profile(self, kind: str) -> DataFrame:
        key = (kind, self.loaded_shards)
        if key not in self._profiles:
            fn = PF.attribute_domain if kind == "domain" else PF.attribute_range
            self._profiles[key] = staged(fn(self.loaded(), self.roles), f"explorer-{kind}")
        return self._profiles[key]

    def domain(self) -> DataFrame:
        return self._profile("domain")

    def ranges(self) -> DataFrame:
        return self._profile("ranges")

    # ---- colour
    def palette(self) -> DataFrame | None:
        if not self.color_by or self.color_by not in self.roles.categorical:
            return None
        pal = PL.build_palette(self.domain(), self.color_by)
        if self.color_by in self.random_colours:
            pal = PL.palette_override(pal, PL.hue_assignment(self.domain(), self.color_by, self.roles, self.random_colours[self.color_by]))
        if self.overrides:
            pal = PL.palette_override(pal, PL.overrides_table(self.spark, self.color_by, self.overrides))
        return pal

    def randomise_colours(self, attribute: str, seed: int = 42) -> Explorer:
        """Deal evenly spaced hues to the attribute's values; palette,
        render and legend use them (colours set by hand still win)."""
        if attribute in self.roles.continuous:
            raise ValueError("hue assignment is for categorical attributes only")
        self.random_colours[attribute] = seed
        return self

    def legend(self, limit: int | None = None) -> DataFrame:
        if self.color_by in self.roles.continuous:
            return LG.legend_continuous(self.ranges(), self.color_by)
        return LG.legend_categorical(self.domain(), self.color_by, self.palette(), limit)

    # ---- render (P1, O3, S8) and frames
    def render(self, frame_rank: int | None = None) -> DataFrame:
        vis = self.visible(frame_rank)
        color = self.color_by or self.roles.categorical[0]
        return render_table(vis, self.roles, color, ranges=self.ranges(), palette=self.palette(),
                            axes=self.axes, cap=self.cap)

    def frames(self) -> DataFrame:
        return FR.frame_index(self.loaded(), self.roles.frame_key)

    def frame_counts(self) -> DataFrame:
        return FR.frame_counts(self.visible(), self.roles.frame_key)

    def export(self, out: str) -> str:
        return export_points(self.render(), out)

    # ---- camera and picking
    def _mapped(self, df: DataFrame) -> DataFrame:
        ax = [a or d for a, d in zip(self.axes, self.roles.default_axes)]
        return df.select("row_idx", *(PJ.coord(df, a).alias(n) for a, n in zip(ax, "xyz")))

    def fit_view(self, frame_rank: int | None = None, target: int | None = None) -> DataFrame:
        """Camera fit over all drawn points; over a stride sample only when a
        target is given."""
        return E.extent_stride(self._mapped(self.visible(frame_rank)), target)

    def pick(self, rays: DataFrame, point_size: float = PK.POINT_SIZE, frame_rank: int | None = None) -> DataFrame:
        """J5 over the drawn points (of one frame), with their details (P5)."""
        vis = self.visible(frame_rank)
        hits = PK.pick_points(self._mapped(vis), rays, threshold=point_size * PK.THRESHOLD_PER_SIZE)
        hits = small_or_whole(hits)                     # one row per ray
        picked = vis.join(hits.select("row_idx").distinct(), "row_idx", "left_semi")
        details = PJ.with_point_details(picked, self.roles, *self.axes).select("row_idx", "details")
        return hits.join(details, "row_idx", "left")
