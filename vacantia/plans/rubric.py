"""A rubric: weighted dimensions, preferences, hard filters and score bands, compiled to Columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facets import COMPUTERS


@dataclass(frozen=True)
class Dimension:
    id: str
    weight: float
    compute: str | None = None


@dataclass(frozen=True)
class HardFilter:
    """Excludes a row when its facet is in a list, above or below a bound; null never excludes."""

    facet: str
    within: tuple = ()
    above: float | None = None
    below: float | None = None
    is_array: bool = False

    def hit(self, value: Column) -> Column:
        tests = []
        if self.within:
            words = [str(w).lower() for w in self.within]
            tests.append(
                F.exists(value, lambda x: F.lower(x.cast("string")).isin(*words))
                if self.is_array
                else F.lower(value.cast("string")).isin(*words)
            )
        if self.above is not None:
            tests.append(value.try_cast("double") > self.above)
        if self.below is not None:
            tests.append(value.try_cast("double") < self.below)
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))

    def reason(self) -> str:
        if self.within:
            return f"{self.facet} ∈ {','.join(map(str, self.within))}"
        return f"{self.facet} > {self.above:g}" if self.above is not None else f"{self.facet} < {self.below:g}"


@dataclass(frozen=True)
class Rubric:
    dimensions: tuple[Dimension, ...]
    preferences: dict = field(default_factory=dict)
    hard_filters: tuple[HardFilter, ...] = ()
    bands: tuple[tuple[float, str], ...] = ()
    max_open_per_company: int = 3
    apply_floor: float = 3.5

    def __post_init__(self):
        names = [d.id for d in self.dimensions]
        if len(set(names)) != len(names):
            raise ValueError("dimension ids must be distinct")
        total = sum(d.weight for d in self.dimensions)
        if self.dimensions and abs(total - 100) > 1e-9:
            warnings.warn(f"dimension weights add up to {total:g}, not 100", stacklevel=3)

    @staticmethod
    def from_config(config: dict, array_facets: tuple[str, ...] = ()) -> "Rubric":
        """Build from a parsed configuration file."""
        prefs = dict(config.get("preferences") or {})
        if "yoe_ceiling" in prefs:
            warnings.warn("preferences.yoe_ceiling is not used", stacklevel=2)
        flow = config.get("workflow") or {}
        return Rubric(
            dimensions=tuple(
                Dimension(d.get("id") or d["name"], float(d.get("weight") or 0), d.get("compute"))
                for d in config.get("dimensions") or ()
            ),
            preferences=prefs,
            hard_filters=tuple(
                HardFilter(f["facet"], tuple(f.get("in") or ()), f.get("gt"), f.get("lt"), f["facet"] in array_facets)
                for f in config.get("hard_filters") or ()
            ),
            bands=tuple((float(b["min"]), b["label"]) for b in config.get("score_interpretation") or ()),
            max_open_per_company=int(flow.get("max_open_per_company") or 3),
            apply_floor=float(flow.get("apply_floor") or 3.5),
        )

    @property
    def weights(self) -> dict[str, float]:
        return {d.id: d.weight for d in self.dimensions}


def weighted_average(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Σ w·s / Σ w over the dimensions that are not null; null when all are."""
    known = [(float(weights.get(k, 0)), s) for k, s in scores.items()]
    if not known:
        return F.lit(None).cast("double")
    top = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w * s).otherwise(0.0) for w, s in known])
    low = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w).otherwise(0.0) for w, s in known])
    return F.when(low != 0, top / low)


def dimension_scores(
    rubric: Rubric, facet: Callable[[str], Column], judged: Column | None = None, judged_all: Column | None = None
) -> dict[str, Column]:
    """Score Column per dimension: a computer where one is bound, else the judged score.

    ``judged`` is a map dimension → score; where it is null, ``judged_all`` is one number that
    stands for every judged dimension.
    """
    nothing = F.lit(None).cast("double")
    out = {}
    for d in rubric.dimensions:
        if d.compute in COMPUTERS:
            out[d.id] = COMPUTERS[d.compute](facet, rubric.preferences)
            continue
        single = nothing if judged_all is None else judged_all.cast("double")
        if judged is None:
            out[d.id] = single
        else:
            out[d.id] = F.when(judged.isNotNull(), F.try_element_at(judged, F.lit(d.id))).otherwise(single)
    return out


def hard_filter_result(filters: tuple[HardFilter, ...], facet: Callable[[str], Column]) -> Column:
    """struct(excluded, reason) of the first hard filter that hits."""
    reasons = [F.when(f.hit(facet(f.facet)), f.reason()) for f in filters]
    first = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return F.struct(first.isNotNull().alias("excluded"), F.coalesce(first, F.lit("")).alias("reason"))


def score_rows(
    df: DataFrame, rubric: Rubric, facet: Callable[[str], Column],
    judged: Column | None = None, judged_all: Column | None = None,
) -> DataFrame:
    """Add dim_scores (map), computed_score, hard_excluded and hard_reason in one projection.

    Scores are stored unrounded; round them where they are shown.
    """
    dims = dimension_scores(rubric, facet, judged, judged_all)
    staged = df.withColumns({f"__dim_{k}": v for k, v in dims.items()})
    cols = {k: F.col(f"`__dim_{k}`") for k in dims}
    pairs = [x for k, c in cols.items() for x in (F.lit(k), c)]
    return (
        staged.withColumns({
            "dim_scores": F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>"),
            "computed_score": weighted_average(cols, rubric.weights),
            "__hard": hard_filter_result(rubric.hard_filters, facet),
        })
        .withColumns({"hard_excluded": F.col("__hard.excluded"), "hard_reason": F.col("__hard.reason")})
        .drop("__hard", *[f"__dim_{k}" for k in dims])
    )


def live_score(
    rubric: Rubric, dim_scores: Column, manual: Column, rank: Column,
    weights: dict[str, float] | None = None, level: Column | None = None,
) -> Column:
    """Score under other weights, from the stored dimension scores alone.

    ``level`` replaces the stored ``level`` dimension where a row has one (another desired level).
    """
    weights = weights or rubric.weights
    scores = {k: F.try_element_at(dim_scores, F.lit(k)) for k in weights}
    if level is not None and "level" in scores:
        scores["level"] = F.when(F.map_contains_key(dim_scores, F.lit("level")), level)
    return F.coalesce(manual.cast("double"), weighted_average(scores, weights), rank.cast("double"))


def band(score: Column, bands: tuple[tuple[float, str], ...]) -> Column:
    """Label of the highest band whose minimum the score reaches."""
    rules = F
    for floor, label in sorted(bands, reverse=True):
        rules = rules.when(score >= floor, label)
    return rules.otherwise(F.lit(None).cast("string"))
