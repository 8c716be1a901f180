"""Entity x period panel operators.

Physical design (see README):

* Periods are a calendar dimension, not data: their distinct set is small
  (days/weeks/quarters of the observed span) and is enumerated once into a
  ``(period, period_idx, n_periods)`` table. It is persisted and counted; a
  table counted small is broadcast, any other is joined by shuffle.
* The dense panel is built **without a cross join and without a join back to
  the observations**: each observed row knows the index of the entity's next
  observation (``lead`` over a window partitioned by entity) and emits itself
  plus the gap rows up to it (``explode(sequence(...))``). One hash shuffle on
  the entity key; the trailing windows and the guarded lead/lag that follow
  partition on the same key and reuse it.
* ``(entity, period)`` must be unique in the observations (aggregate first; a
  repeated one fails the job); then a window partition holds at most ``n_periods`` rows per entity, so a hot
  entity cannot make a task unbounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import period_ordinal
from ..session import keep_fanout, small_side
from ..sources.fixtures import ENTITY, PERIOD

PERIOD_IDX = "period_idx"
N_PERIODS = "n_periods"
FIRST_PERIOD = "first_period"
# index of the newest period whose calendar successor (one step later) exists
LAST_PAIRED = "last_paired_idx"
# what the preceding observations and the calendar tell about a panel row (see ``densify``)
RUN, CALENDAR = "_run", "_calendar"
HELPER_COLUMNS = (PERIOD_IDX, N_PERIODS, FIRST_PERIOD, LAST_PAIRED, RUN, CALENDAR)

# Decimals kept on trailing means (order-independent results across engines).
MEAN_DIGITS = 9


def _ord(df: DataFrame, period: str) -> Column:
    return period_ordinal(df.schema[period].dataType, F.col(period))


def period_index(obs: DataFrame, period: str = PERIOD, step: int = 1) -> DataFrame:
    """Distinct periods numbered 1..n in calendar order, with n on every row.

    Also ``last_paired_idx``: the newest period whose successor one ``step``
    later is also observed (the newest period a next-period label exists for).
    The windows run over the distinct periods only (bounded by the calendar),
    never over data rows.
    """
    d = obs.select(period).where(F.col(period).isNotNull()).distinct()
    whole = Window.partitionBy(F.lit(0))
    ordered = whole.orderBy(period)
    o = _ord(d, period)
    idx = d.select(
        period,
        F.row_number().over(ordered).alias(PERIOD_IDX),
        F.count(F.lit(1)).over(whole).alias(N_PERIODS),
        (F.lead(o).over(ordered) == o + step).alias("_paired"),
    )
    idx = idx.withColumn(LAST_PAIRED, F.max(F.when(F.col("_paired"), F.col(PERIOD_IDX))).over(whole)).drop("_paired")
    # one row per period, read by two joins: persisted once
    return keep_fanout(idx.withColumns({N_PERIODS: F.col(N_PERIODS).cast("int"), LAST_PAIRED: F.col(LAST_PAIRED).cast("int")}))


def first_seen(obs: DataFrame, entity: str = ENTITY, period: str = PERIOD) -> DataFrame:
    """A2: first observed period per entity (partial aggregation, skew-safe)."""
    return obs.groupBy(entity).agg(F.min(period).alias(FIRST_PERIOD))


def _next_index(w, entity: str) -> Column:
    """Index of the following observation (one past the last period at the end). Two rows with
    the same index fail the job: they would corrupt leads, lags and means silently."""
    nxt = F.lead(PERIOD_IDX).over(w)
    message = F.concat(F.lit(f"repeated observation of one period: {entity} "), F.coalesce(F.col(entity).cast("string"), F.lit("NULL")))
    return (F.when(nxt == F.col(PERIOD_IDX), F.raise_error(message).cast("int"))
            .otherwise(F.coalesce(nxt, F.col(N_PERIODS) + 1)))


def densify(obs: DataFrame, fills: Mapping[str, object], entity: str = ENTITY,
            period: str = PERIOD, periods: DataFrame | None = None, step: int = 1,
            latest: Iterable[str] = (), trail: tuple[Iterable[str], int] | None = None,
            flags: Iterable[str] = ()) -> DataFrame:
    """J1 + J2 + J4 + P10 in one pass: gap-free panel from each entity's first period.

    ``fills`` maps each measure/flag column to the value of a gap row; observed
    NULLs in those columns get the same value (the reference's blanket fill).
    The ``latest`` columns (attributes) take the value of the entity's newest
    observation on every row, so an entity keeps one row per period when they change; any other column
    is carried from the entity's preceding observation. Adds ``period_idx``, ``n_periods``, ``first_period``,
    ``last_paired_idx``.

    ``periods`` may give the distinct periods from a cheaper plan (e.g. one
    pruned column of the raw table); by default they come from ``obs``.

    A panel has many times the rows of its observations. With ``trail`` (measures, periods) and ``flags`` the rows also carry the sums
    of the observations before them and the neighbouring flags, taken on the observations; from these
    :func:`trailing_mean` and :func:`offset_flag` find the same values row by row, without sorting the panel. Both then
    speak of the columns as ``densify`` left them.
    """
    idx = period_index(obs if periods is None else periods, period, step=step)
    near = trail is not None or bool(list(flags))
    pidx = small_side(with_calendar(idx, period, step, trail[1] if trail else 1) if near else idx)
    o = obs.join(pidx, period)
    w = Window.partitionBy(entity).orderBy(PERIOD_IDX)
    if near:
        o = o.withColumn(RUN, _run(o, w, fills, trail, list(flags), step))
    o = o.withColumns({
        "_next": _next_index(w, entity),
        FIRST_PERIOD: F.min(period).over(w),
        **{c: F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in latest},
    })
    q = F.explode(F.sequence(F.col(PERIOD_IDX), F.greatest(F.col(PERIOD_IDX), F.col("_next") - 1)))
    g = o.withColumn("_q", q)
    is_obs = F.col("_q") == F.col(PERIOD_IDX)
    filled = {c: F.when(is_obs, F.coalesce(F.col(c), F.lit(v))).otherwise(F.lit(v)).cast(obs.schema[c].dataType)
              for c, v in fills.items()}
    g = g.withColumns(filled).drop(period, PERIOD_IDX, N_PERIODS, LAST_PAIRED, "_next", CALENDAR)
    # the same period table maps the generated index back to its period
    out = g.join(pidx.alias("_pi"), F.col("_q") == F.col(f"_pi.{PERIOD_IDX}")).drop("_q")
    return out.select(entity, period, *[c for c in obs.columns if c not in (entity, period)],
                      PERIOD_IDX, N_PERIODS, FIRST_PERIOD, LAST_PAIRED, *[RUN, CALENDAR] * near)


def with_calendar(idx: DataFrame, period: str, step: int, n_periods: int) -> DataFrame:
    """Adds ``_calendar`` to the period table: the period's ordinal, whether the periods one step before and after it are there, and how
    many periods its trailing range of ``n_periods`` steps holds."""
    o = _ord(idx, period)
    whole = Window.partitionBy(F.lit(0)).orderBy(o)
    return idx.withColumn(CALENDAR, F.struct(
        o.cast("long").alias("at"),
        F.coalesce(F.lag(o).over(whole) == o - step, F.lit(False)).alias("has_last"),
        F.coalesce(F.lead(o).over(whole) == o + step, F.lit(False)).alias("has_next"),
        F.count(F.lit(1)).over(whole.rangeBetween(-(n_periods - 1) * step, 0)).alias(f"wide_{n_periods}_{step}")))


def _run(o: DataFrame, w, fills: Mapping[str, object], trail, flags: list[str], step: int) -> Column:
    """What an observation hands on to its panel rows: its index, the next one's and the entity's first one, the ordinals and sums
    of the last 0, 1, ... observations up to it (oldest first, as a window adds them), and its neighbours' flags."""
    at, idx = F.col(f"{CALENDAR}.at"), F.col(PERIOD_IDX)
    of = lambda c: F.coalesce(F.col(c), F.lit(fills[c]).cast(o.schema[c].dataType))
    parts = [idx.alias("own"), F.lag(idx).over(w).alias("last"), F.lead(idx).over(w).alias("next"), F.min(idx).over(w).alias("first")]
    if trail:
        measures, n = list(trail[0]), trail[1]
        if any(fills[m] != 0 or o.schema[m].dataType.simpleString() != "double" for m in measures):
            raise ValueError("trailing sums are carried for double measures that gap rows fill with 0")
        before = [[F.lag(of(m), k).over(w) if k else of(m) for k in range(n)] for m in measures]
        sums = [F.array(*[sum(reversed(v[:k]), F.lit(0.0)) for v in before]) for k in range(n + 1)]
        parts += [F.array(*[F.lag(at, k).over(w) if k else at for k in range(n)]).alias("ats"), F.array(*sums).alias(_sums(measures, n, step))]
    for c in flags:
        parts.append(F.struct(F.lag(of(c)).over(w).alias("last"), of(c).alias("own"), F.lead(of(c)).over(w).alias("next"),
                              F.lit(fills[c]).cast(o.schema[c].dataType).alias("gap")).alias(f"flag_{step}_{c}"))
    return F.struct(*parts)


def _sums(measures: Iterable[str], n_periods: int, step: int) -> str:
    return "_".join(["sums", str(n_periods), str(step), *measures])


def _carries(panel: DataFrame, part: str) -> bool:
    return RUN in panel.columns and part in panel.schema[RUN].dataType.names


def densify_by_tuple(obs: DataFrame, fills: Mapping[str, object], attrs: Iterable[str],
                     entity: str = ENTITY, period: str = PERIOD, periods: DataFrame | None = None,
                     step: int = 1) -> DataFrame:
    """J2b without a grid or a join: one panel per (entity, attribute tuple).

    Same rows as ``densify_on_grid(..., join_on_attrs=True)``: every tuple of
    an entity gets all periods from the *entity's* first period; measures only
    where that tuple was observed (NULL attributes match NULL). Both windows
    run on one hash exchange on the entity: partitioning by the entity also
    clusters every (entity, tuple) group.
    """
    attrs = list(attrs)
    pidx = small_side(period_index(obs if periods is None else periods, period, step=step))
    o = obs.join(pidx, period)
    we = Window.partitionBy(entity)
    wt = Window.partitionBy(entity, *attrs).orderBy(PERIOD_IDX)
    o = o.withColumns({
        "_efirst": F.min(PERIOD_IDX).over(we),
        FIRST_PERIOD: F.min(period).over(we),
        "_next": _next_index(wt, entity),
        "_tfirst": F.row_number().over(wt) == 1,
    })
    start = F.when(F.col("_tfirst"), F.col("_efirst")).otherwise(F.col(PERIOD_IDX))
    g = o.withColumn("_q", F.explode(F.sequence(start, F.greatest(F.col(PERIOD_IDX), F.col("_next") - 1))))
    is_obs = F.col("_q") == F.col(PERIOD_IDX)
    filled = {c: F.when(is_obs, F.coalesce(F.col(c), F.lit(v))).otherwise(F.lit(v)).cast(obs.schema[c].dataType)
              for c, v in fills.items()}
    g = g.withColumns(filled).drop(period, PERIOD_IDX, N_PERIODS, LAST_PAIRED, "_next", "_efirst", "_tfirst")
    out = g.join(pidx.alias("_pi"), F.col("_q") == F.col(f"_pi.{PERIOD_IDX}")).drop("_q")
    measures = [c for c in obs.columns if c not in (entity, period, *attrs)]
    return out.select(entity, period, *attrs, *measures, PERIOD_IDX, N_PERIODS, FIRST_PERIOD, LAST_PAIRED)


def grid(obs: DataFrame, keys: Iterable[str] = (), entity: str = ENTITY,
         period: str = PERIOD) -> DataFrame:
    """J1 + A1 + J4: every (entity[, keys], period) with period >= the entity's first.

    Distinct key tuples x the periods from the entity's first one, generated
    by ``sequence`` over period indexes instead of a Cartesian product.
    """
    keys = list(keys)
    pidx = small_side(period_index(obs, period))
    o = obs.join(pidx, period)
    firsts = o.groupBy(entity).agg(F.min(PERIOD_IDX).alias("_first"), F.max(N_PERIODS).alias("_n"),
                                   F.min(period).alias(FIRST_PERIOD))
    tuples = obs.select(entity, *keys).distinct()
    g = tuples.join(firsts, entity).withColumn("_q", F.explode(F.sequence("_first", "_n")))
    out = g.join(pidx.alias("_pi"), F.col("_q") == F.col(f"_pi.{PERIOD_IDX}")).drop("_q")
    return out.select(entity, period, *keys, PERIOD_IDX, N_PERIODS, FIRST_PERIOD, LAST_PAIRED)


def densify_on_grid(obs: DataFrame, fills: Mapping[str, object], attrs: Iterable[str] = (),
                    entity: str = ENTITY, period: str = PERIOD, join_on_attrs: bool = False) -> DataFrame:
    """Grid LEFT JOIN observations, then the fill.

    ``join_on_attrs=False`` keys the join on (entity, period) only: an entity
    whose attributes changed fans out into one row per attribute tuple (the
    reference's SQL panel). ``join_on_attrs=True`` also keys on the attributes
    (null-safe): an observed period whose attributes differ from the tuple
    becomes a zero gap row for that tuple.
    """
    attrs = list(attrs)
    g = grid(obs, attrs, entity, period)
    measures = [c for c in obs.columns if c not in (entity, period, *attrs)]
    if join_on_attrs:
        keys = [entity, period, *attrs]
        o = obs.select(*[F.col(c).alias(f"_o_{c}") for c in keys], *measures)
        cond = [F.col(entity) == F.col(f"_o_{entity}"), F.col(period) == F.col(f"_o_{period}")]
        cond += [F.col(a).eqNullSafe(F.col(f"_o_{a}")) for a in attrs]
        j = g.join(o, cond, "left").drop(*[f"_o_{c}" for c in keys])
    else:
        o = obs.select(entity, period, *measures)
        j = g.join(o, [entity, period], "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)).cast(obs.schema[c].dataType) for c, v in fills.items()}
    j = j.withColumns(filled)
    return j.select(entity, period, *attrs, *measures, PERIOD_IDX, N_PERIODS, FIRST_PERIOD, LAST_PAIRED)


def trailing_mean(panel: DataFrame, measures: Iterable[str], n_periods: int, step: int = 1,
                  entity: str = ENTITY, period: str = PERIOD, digits: int | None = MEAN_DIGITS) -> DataFrame:
    """W1 (+P7): mean of each measure over the calendar range [t - (n-1)*step, t].

    One RANGE window per entity replaces the reference's loop of per-period
    merges; with n = 1 it is the identity on the measures. Means are rounded
    to ``digits`` decimals so the value does not depend on the order in which
    an engine adds the frame's rows (``None`` keeps the raw double). A panel
    that carries the sums of its observations (see :func:`densify`) is not sorted for it.
    """
    measures = list(measures)
    if n_periods > 1 and _carries(panel, _sums(measures, n_periods, step)):
        return _carried_mean(panel, measures, n_periods, step, digits)
    w = (Window.partitionBy(entity).orderBy(_ord(panel, period))
         .rangeBetween(-(n_periods - 1) * step, 0))
    if n_periods == 1:
        return panel
    def mean(m):
        a = F.avg(F.col(m)).over(w)
        return a if digits is None else F.round(a, digits)
    return panel.withColumns({m: mean(m) for m in measures})


def _carried_mean(panel: DataFrame, measures: list[str], n: int, step: int, digits: int | None) -> DataFrame:
    """The range holds the last few observations and gap rows of 0, back to the entity's first period at most."""
    cal, run, at = F.col(CALENDAR), F.col(RUN), F.col(f"{CALENDAR}.at")
    held = sum((F.coalesce((run["ats"][k] >= at - (n - 1) * step).cast("int"), F.lit(0)) for k in range(n)), F.lit(0))
    count = F.least(cal[f"wide_{n}_{step}"], F.col(PERIOD_IDX) - run["first"] + 1).cast("double")
    x = panel.withColumns({"_held": held, "_count": count})

    def mean(total):
        a = total / F.col("_count")
        return a if digits is None else F.round(a, digits)
    # one array, so that the generated code does not grow with the measures
    means = F.transform(run[_sums(measures, n, step)][F.col("_held")], mean)
    x = x.withColumn("_means", F.when(F.col("_held") > 0, means).otherwise(F.array(*[F.lit(0.0)] * len(measures))))
    return x.withColumns({m: F.col("_means")[i] for i, m in enumerate(measures)}).drop("_held", "_count", "_means")


def offset_flag(panel: DataFrame, col: str, out: str, offset: int = 1, step: int = 1,
                how: str = "filled", fill=0, entity: str = ENTITY, period: str = PERIOD) -> DataFrame:
    """Value of ``col`` at period + offset*step of the same entity.

    A guarded lead/lag replaces the self join: the neighbouring row counts
    only if it is exactly one step away in calendar terms. ``how='inner'``
    drops rows without such a neighbour (the reference's SQL label);
    ``how='filled'`` keeps them with ``fill``.
    """
    if offset not in (1, -1):
        raise ValueError("offset must be +1 (next period) or -1 (previous period)")
    if _carries(panel, f"flag_{step}_{col}"):
        run, flag, at = F.col(RUN), F.col(RUN)[f"flag_{step}_{col}"], F.col(PERIOD_IDX)
        if offset > 0:
            matched = F.col(f"{CALENDAR}.has_next")
            val = F.when(run["next"] == at + 1, flag["next"]).otherwise(flag["gap"])
        else:
            matched = F.col(f"{CALENDAR}.has_last") & (at > run["first"])
            val = (F.when(run["own"] == at - 1, flag["own"]).when((run["own"] == at) & (run["last"] == at - 1), flag["last"])
                   .otherwise(flag["gap"]))
    else:
        o = _ord(panel, period)
        w = Window.partitionBy(entity).orderBy(o)
        nb = F.lead if offset > 0 else F.lag
        matched = nb(o, 1).over(w) == o + offset * step
        val = nb(F.col(col), 1).over(w)
    if how == "inner":
        return (panel.withColumns({"_m": matched, out: val}).where(F.col("_m")).drop("_m"))
    if how == "filled":
        return panel.withColumn(out, F.when(matched, val).otherwise(F.lit(fill)).cast(panel.schema[col].dataType))
    raise ValueError(how)


def drop_newest(df: DataFrame) -> DataFrame:
    """Drop the newest panel period (it has no next-period label)."""
    return df.where(F.col(PERIOD_IDX) < F.col(N_PERIODS))


def drop_oldest(df: DataFrame) -> DataFrame:
    """Drop the oldest panel period (it has no previous-period flag)."""
    return df.where(F.col(PERIOD_IDX) > 1)


def with_period_max(df: DataFrame, period: str = PERIOD, out: str = "_max_period") -> DataFrame:
    """A3: attach the global newest period as a column (scalar subquery)."""
    return df.withColumn(out, df.agg(F.max(period)).scalar())


def split_oot(df: DataFrame, period: str = PERIOD) -> DataFrame:
    """T1 (generic): ``is_test`` = row belongs to the newest period of ``df``.

    Needs a global max, i.e. a second pass over ``df``; panel-derived frames
    use :func:`split_oot_indexed` instead.
    """
    return (with_period_max(df, period)
            .withColumn("is_test", F.col(period) == F.col("_max_period")).drop("_max_period"))


def split_oot_indexed(df: DataFrame, newest: str = "labelled") -> DataFrame:
    """T1 on a panel-derived frame, row-local (no second pass).

    ``newest='labelled'``: the newest period after dropping the panel's newest
    (filled next-period label) is index n-1. ``newest='paired'``: after an
    inner next-period label it is the newest period whose successor exists.
    Every entity has rows at all periods from its first one, so these periods
    are present in the frame.
    """
    idx = F.col(N_PERIODS) - 1 if newest == "labelled" else F.col(LAST_PAIRED)
    return df.withColumn("is_test", F.col(PERIOD_IDX) == idx)


def warmup_entity(df: DataFrame, k: int = 0, step: int = 1, period: str = PERIOD) -> DataFrame:
    """Keep rows later than the entity's first period + k steps."""
    first = period_ordinal(df.schema[FIRST_PERIOD].dataType, F.col(FIRST_PERIOD))
    return df.where(_ord(df, period) > first + k * step)


def warmup_global(df: DataFrame, k: int, period: str = PERIOD) -> DataFrame:
    """T3 / O4 (generic): drop the first k distinct periods of the frame.

    The k periods come from a top-k over the distinct periods (``limit`` is the
    feature here) and are removed with a broadcast anti join of k rows.
    """
    first_k = df.select(period).distinct().orderBy(period).limit(k)
    return df.join(F.broadcast(first_k), period, "left_anti")


def warmup_global_indexed(df: DataFrame, k: int, already_dropped: int = 0) -> DataFrame:
    """T3 on a panel-derived frame: the first k periods still present are the
    panel's indexes ``already_dropped + 1 .. already_dropped + k``."""
    return df.where(F.col(PERIOD_IDX) > already_dropped + k)


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in HELPER_COLUMNS if c in df.columns])
