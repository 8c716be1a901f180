"""Analytic base tables of the six reference variants (T4, T5).

A slice is described by a :class:`Spec` and built over any :class:`Activity` source (one
row per entity and observed period, with its step, measures and attributes). Each slice is one lazy plan: densify -> (trailing mean) -> guarded next/previous
flags -> rule segment -> warm-up cut -> out-of-time split. All window steps
partition on the entity key, so the plan shuffles the observations once.

Variant parameters (survey section 0.3):

==========  =========  ========  ==========  =========  ===============
slice       attrs      window    label       prev flag  warm-up
==========  =========  ========  ==========  =========  ===============
1p          kept       1         inner       no         none
2p          dropped    2         filled      no         entity first
3p          dropped    3         filled      yes        entity first+1
1p_attrs    join keys  1         filled      no         none
2p_global   dropped    2         filled      no         global first 1
3p_global   dropped    3         filled      yes        global first 2
==========  =========  ========  ==========  =========  ===============
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import SEGMENT, SEGMENT_FILL, VEHICLE_MODEL_FILL
from ..operators import panel as P
from ..sources.fixtures import (DAILY_ATTRS, DAILY_MEASURES, WEEKLY_MEASURES, activity_daily, activity_weekly,
                                daily_periods)

LABEL = "not_churn_1w"
PREV = "not_churn_pre_1w"
FLAG = "not_churn"


@dataclass(frozen=True)
class Activity:
    """Observations with the reference's shape: unique (entity, period), measures, a 0/1 activity
    flag and, for the variants that keep them, attributes and the source's segment."""

    rows: DataFrame
    measures: tuple
    attrs: tuple = ()
    step: int = 1
    entity: str = "entity_id"
    period: str = "period"
    periods: DataFrame | None = None    # distinct periods, where a cheaper plan gives them
    fills: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Spec:
    """Parameters of a variant: attributes kept ('latest' per entity), joined on ('key') or dropped; trailing window; label
    join; previous-period flag; warm-up cut ('entity' or 'global', periods); segment re-derived from sum_sh."""

    attrs: str | None = None
    window: int = 1
    label: str = "filled"
    prev: bool = False
    warmup: tuple | None = None


SPECS = {
    "slice_1p": Spec(attrs="latest", label="inner"),
    "slice_2p": Spec(window=2, warmup=("entity", 0)),
    "slice_3p": Spec(window=3, prev=True, warmup=("entity", 1)),
    "slice_1p_attrs": Spec(attrs="key"),
    "slice_2p_global": Spec(window=2, warmup=("global", 1)),
    "slice_3p_global": Spec(window=3, prev=True, warmup=("global", 2)),
}


def panel_of(a: Activity, spec: Spec) -> DataFrame:
    """The gap-free panel of the spec: NULL and gap measures and flags are 0, gap and NULL segments 'Parttime'. Its rows carry
    what trailing means and neighbouring flags need, so that the panel itself is never sorted."""
    fills = {**{m: 0.0 for m in a.measures}, FLAG: 0}
    near = {"trail": (a.measures, spec.window) if spec.window > 1 else None, "flags": [FLAG]}
    if spec.attrs is None:
        rows = a.rows.select(a.entity, a.period, *a.measures, FLAG).na.fill(0, subset=list(a.measures))
        return P.densify(rows, fills, a.entity, a.period, a.periods, a.step, **near)
    rows = a.rows.na.fill({k: v for k, v in a.fills.items() if k != "segment"})
    fills |= {"segment": a.fills["segment"]} if "segment" in a.fills else {}
    if spec.attrs == "key":
        return P.densify_by_tuple(rows, fills, a.attrs, a.entity, a.period, a.periods, a.step)
    return P.densify(rows, fills, a.entity, a.period, a.periods, a.step, latest=a.attrs, **near)


def slice_of(a: Activity, spec: Spec) -> DataFrame:
    """The analytic base table of ``spec`` over any activity source."""
    at = {"entity": a.entity, "period": a.period, "step": a.step}
    df = panel_of(a, spec)
    df = P.trailing_mean(df, a.measures, spec.window, **at)
    df = P.offset_flag(df, FLAG, LABEL, +1, how=spec.label, **at)
    if spec.label == "filled":
        df = P.drop_newest(df)
    if spec.prev:
        df = P.drop_oldest(P.offset_flag(df, FLAG, PREV, -1, how="filled", **at))
    if spec.attrs is None:
        df = df.withColumn("segment", SEGMENT.expr("sum_sh"))
    if spec.warmup:
        kind, k = spec.warmup
        df = (P.warmup_entity(df, k, a.step, a.period) if kind == "entity"
              else P.warmup_global_indexed(df, k, already_dropped=int(spec.prev)))
    return P.drop_helpers(P.split_oot_indexed(df, "paired" if spec.label == "inner" else "labelled"))


# ---------------------------------------------------------------- sources
def daily(spark: SparkSession, sf_dir: str) -> Activity:
    return Activity(activity_daily(spark, sf_dir), tuple(DAILY_MEASURES), tuple(DAILY_ATTRS), 1,
                    periods=daily_periods(spark, sf_dir),
                    fills={"vehicle_model": VEHICLE_MODEL_FILL, "segment": SEGMENT_FILL})


def weekly(spark: SparkSession, sf_dir: str) -> Activity:
    """All 23 measures of the reference's schema at a step of seven days."""
    return Activity(activity_weekly(spark, sf_dir), tuple(WEEKLY_MEASURES), tuple(DAILY_ATTRS), 7,
                    fills={"vehicle_model": VEHICLE_MODEL_FILL, "segment": SEGMENT_FILL})


def csv_activity(rows: DataFrame) -> Activity:
    """The reference's own input file (see ``sources.tables.read_activity_csv``)."""
    from ..sources.tables import MEASURES
    rows = rows.withColumn("week", F.col("week").cast("date")).drop("activated_date", "ftt_time")
    return Activity(rows, tuple(MEASURES), tuple(DAILY_ATTRS), 7, entity="driver_id", period="week",
                    fills={"vehicle_model": VEHICLE_MODEL_FILL, "segment": SEGMENT_FILL})


def source_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations without attributes, NULL measures zero-filled."""
    src = activity_daily(spark, sf_dir, with_segment=False)
    return src.select("entity_id", "period", *DAILY_MEASURES, FLAG).na.fill(0, subset=DAILY_MEASURES)


def panel_1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily panel with attributes."""
    return panel_of(daily(spark, sf_dir), SPECS["slice_1p"])


def panel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of(daily(spark, sf_dir), SPECS["slice_2p"])


def panel_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of(daily(spark, sf_dir), SPECS["slice_1p_attrs"])


def _slice(name: str, source=daily):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return slice_of(source(spark, sf_dir), SPECS[name])
    build.__name__ = name
    return build


SLICES = {name: _slice(name) for name in SPECS}
WEEKLY_SLICES = {f"weekly_{name}": _slice(name, weekly) for name in ("slice_1p", "slice_2p", "slice_3p")}
slice_1p, slice_2p, slice_3p = SLICES["slice_1p"], SLICES["slice_2p"], SLICES["slice_3p"]


def labelled_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily panel with the filled next-day label, newest day dropped
    (the 'labelled rows' of FIXTURES.md)."""
    pn = panel_1p(spark, sf_dir)
    return P.drop_newest(P.offset_flag(pn, FLAG, LABEL, +1, how="filled"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic score over the labelled panel for exact evaluation checks.

    ``score`` takes at most 21 values (heavy ties, as a dummy-feature model);
    ``is_test`` marks the newest labelled day.
    """
    lab = labelled_daily(spark, sf_dir)
    raw = (F.col("total_dispatched_request") * 3 + F.col("accepted") * 2 - F.col("cancelled")
           + F.col("sum_sh") / 10)
    score = F.greatest(F.lit(0.0), F.least(F.lit(20.0), raw)) / F.lit(20.0)
    out = lab.select("entity_id", "period", FLAG, LABEL, score.alias("score"),
                     (F.col(P.PERIOD_IDX) == F.col(P.N_PERIODS) - 1).alias("is_test"))
    return out
