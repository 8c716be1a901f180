"""Registered Spark queries, one per operator of the survey's inventory.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame built
from the driver tables; computed columns carry the same names as in
``oracle_sql``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..session import ensure_checkpoint_dir
from ..sources import tables as TB
from ..sources.fixtures import (DAILY_MEASURES, QUARTERLY_ATTRS, QUARTERLY_MEASURES, PERIOD_NO,
                                activity_daily, activity_quarterly)
from . import slices as S

Query = Callable[[SparkSession, str], DataFrame]

PM_COLS = ["entity_id", "period", *DAILY_MEASURES, "not_churn"]
P1_COLS = ["entity_id", "period", "ops_city_id", "device_type", "vehicle_brand", "vehicle_model",
           *DAILY_MEASURES, "not_churn", "segment"]


def q_src_activity(spark, sf):
    return activity_daily(spark, sf)


def q_first_seen(spark, sf):
    return P.first_seen(activity_daily(spark, sf))


def q_panel_grid(spark, sf):
    return P.grid(S.source_measures(spark, sf)).select("entity_id", "period", P.PERIOD_IDX)


def q_panel_densify(spark, sf):
    return S.panel_measures(spark, sf).select(*PM_COLS, P.PERIOD_IDX, P.N_PERIODS, P.FIRST_PERIOD)


def q_panel_fill(spark, sf):
    return S.panel_1p(spark, sf).select(*P1_COLS, P.PERIOD_IDX, P.N_PERIODS, P.FIRST_PERIOD)


def q_panel_densify_attrs(spark, sf):
    return S.panel_attrs(spark, sf).select(*P1_COLS, P.PERIOD_IDX)


def _quarterly_panel(spark, sf):
    fills = {m: 0.0 for m in QUARTERLY_MEASURES}
    fills["not_churn"] = 0
    return P.densify(activity_quarterly(spark, sf), fills, period=PERIOD_NO)


def q_panel_quarterly(spark, sf):
    return P.drop_helpers(_quarterly_panel(spark, sf)).select(
        "entity_id", PERIOD_NO, *QUARTERLY_ATTRS, *QUARTERLY_MEASURES, "not_churn")


def q_label_quarterly(spark, sf):
    pn = _quarterly_panel(spark, sf)
    lab = P.drop_newest(P.offset_flag(pn, "not_churn", "not_churn_next", +1, period=PERIOD_NO))
    return lab.select("entity_id", PERIOD_NO, "not_churn", "not_churn_next")


def q_label_next_inner(spark, sf):
    lab = P.offset_flag(S.panel_1p(spark, sf), "not_churn", S.LABEL, +1, how="inner")
    return lab.select("entity_id", "period", "not_churn", S.LABEL)


def q_label_next_filled(spark, sf):
    return S.labelled_daily(spark, sf).select("entity_id", "period", "not_churn", S.LABEL)


def q_flag_prev_filled(spark, sf):
    pre = P.drop_oldest(P.offset_flag(S.panel_measures(spark, sf), "not_churn", S.PREV, -1))
    return pre.select("entity_id", "period", "not_churn", S.PREV)


def _trailing(n):
    def q(spark, sf):
        return P.trailing_mean(S.panel_measures(spark, sf), DAILY_MEASURES, n).select(*PM_COLS)
    return q


def _labelled_measures(spark, sf):
    return P.drop_newest(P.offset_flag(S.panel_measures(spark, sf), "not_churn", S.LABEL, +1))


def q_warmup_entity_1(spark, sf):
    return P.warmup_entity(_labelled_measures(spark, sf), k=0).select("entity_id", "period", S.LABEL)


def q_warmup_entity_2(spark, sf):
    return P.warmup_entity(_labelled_measures(spark, sf), k=1).select("entity_id", "period", S.LABEL)


def q_warmup_global_k(spark, sf):
    return P.warmup_global(_labelled_measures(spark, sf), 3).select("entity_id", "period", S.LABEL)


def q_split_oot(spark, sf):
    return P.split_oot(S.labelled_daily(spark, sf)).select("entity_id", "period", S.LABEL, "is_test")


def q_churn_rate_ttc(spark, sf):
    """1 - mean(next-period label) over currently active rows."""
    lab = P.offset_flag(S.panel_1p(spark, sf), "not_churn", S.LABEL, +1, how="inner")
    return lab.where(F.col("not_churn") == 1).agg(
        (F.lit(1.0) - F.avg(F.col(S.LABEL).cast("double"))).alias("churn_rate"),
        F.count(F.lit(1)).alias("n_active"))


def q_audit_null_count(spark, sf):
    """Total NULL count over all columns, one pass."""
    from ..operators.stats import null_audit
    return null_audit(activity_daily(spark, sf))


# The panel with next-period label and the weekly rates as SQL text over named relations.
PANEL_LABEL_SQL = """
WITH spans AS (
  SELECT entity_id, MIN(period) AS first_period, (SELECT ARRAY_SORT(COLLECT_SET(period)) FROM activity) AS periods
  FROM activity GROUP BY entity_id
), grid AS (
  SELECT entity_id, EXPLODE(FILTER(periods, p -> p >= first_period)) AS period FROM spans
), panel AS (
  SELECT g.entity_id, g.period, COALESCE(a.not_churn, 0) AS not_churn
  FROM grid g LEFT JOIN activity a ON a.entity_id = g.entity_id AND a.period = g.period
)
SELECT n.entity_id, n.period, n.not_churn, f.not_churn AS not_churn_1w
FROM panel n JOIN panel f ON f.entity_id = n.entity_id AND f.period = DATE_ADD(n.period, :step)
"""
RATES_SQL = """
WITH counts AS (
  SELECT period, COUNT_IF(not_churn_1w = 1) AS stayed, COUNT_IF(not_churn_1w = 0) AS left_,
         COUNT_IF(predict = 1) AS stays, COUNT_IF(predict = 0) AS leaves
  FROM result GROUP BY period
)
SELECT period, CASE WHEN left_ > 0 THEN left_ * 100.0D / (stayed + left_) END AS churn_actual,
       CASE WHEN stays > 0 AND leaves > 0 THEN leaves * 100.0D / (stays + leaves) END AS churn_predict
FROM counts WHERE stayed > 0
"""


def q_sql_panel_label(spark, sf):
    """Panel and label from SQL text."""
    rows = activity_daily(spark, sf, with_segment=False).select("entity_id", "period", "not_churn")
    return TB.sql_over(spark, PANEL_LABEL_SQL, {"activity": rows}, {"step": 1})


def q_sql_rates(spark, sf):
    """Weekly rates from SQL text over the scored result."""
    return TB.sql_over(spark, RATES_SQL, {"result": _result(spark, sf)})


def _weekly_csv(spark, sf):
    """The weekly activity as the reference's CSV file, some cells of which cannot be read: no number, no whole number, no date."""
    rows, driver = S.weekly(spark, sf).rows, F.col("driver_id")
    rows = rows.withColumnsRenamed({"entity_id": "driver_id", "period": "week"})
    text = {c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string") for c in TB.ACTIVITY_COLUMNS}
    text["sum_sh"] = F.when(driver % 50 == 7, F.lit("n/a")).otherwise(text["sum_sh"])
    text["ops_city_id"] = F.when(driver % 61 == 3, F.lit("2.5")).otherwise(text["ops_city_id"])
    text["week"] = F.when(driver % 97 == 11, F.lit("someday")).otherwise(text["week"])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/retentio-csv-{uuid.uuid4().hex}"
    rows.select(*[c.alias(n) for n, c in text.items()]).write.option("header", True).csv(path)
    return path


def q_src_csv_accepted(spark, sf):
    """S1 + S2 + S3: rows of a written CSV file that can be read."""
    rows = TB.read_audited_csv(spark, _weekly_csv(spark, sf)).rows
    return rows.select("driver_id", F.col("week").cast("date").alias("week"), "ops_city_id", "vehicle_brand", "sum_sh", "completed_trip", "total_fare", "not_churn", "segment")


def q_src_csv_audit(spark, sf):
    """Bad cells by column and the number of rows, counted in the scan that types them, beside the rejected rows read back."""
    seen = TB.read_audited_csv(spark, _weekly_csv(spark, sf))
    rejected = seen.rejects.select(F.explode("bad_columns").alias("column")).groupBy("column").agg(F.count("*").alias("n_rejected"))
    counts = spark.createDataFrame([(c, n, seen.n_rows) for c, n in seen.bad.items()], "column string, n_bad long, n_rows long")
    return counts.join(rejected, "column")


def q_rates_file(spark, sf):
    """O1 + S3: the rates written in order to several files and read back with their place."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/retentio-csv-{uuid.uuid4().hex}"
    TB.write_ordered(D.rates_by_period(_result(spark, sf)), path, ["period"], files=3, rank="rank_no")
    back = spark.read.option("header", True).schema("period date, churn_actual double, churn_predict double, rank_no long").csv(path)
    # The place in the files, by file name and line, against the written place.
    lines = back.withColumn("_line", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")))
    at = F.row_number().over(Window.orderBy("_line"))
    return lines.withColumn("line_no", at).select("period", "churn_actual", "churn_predict", "rank_no", (F.col("line_no") == F.col("rank_no")).alias("in_order"))


def _stored(spark, sf):
    a = S.daily(spark, sf)
    return replace(a, rows=TB.store_by_entity(a.rows))


def q_slice_2p_stored(spark, sf):
    """J2 + W1 over observations stored by entity: no exchange per entity."""
    return S.slice_of(_stored(spark, sf), S.SPECS["slice_2p"])


def q_lookup_entity_stored(spark, sf):
    """P13 over observations stored by entity: one bucket is read."""
    return q_slice_2p_stored(spark, sf).where(F.col("entity_id") == 42)


def q_lookup_entity(spark, sf):
    """All rows of one entity (pushed to a filter after the per-entity windows)."""
    return S.slice_2p(spark, sf).where(F.col("entity_id") == 42)


CHANGING_ATTRS = ["vehicle_brand", "vehicle_model"]


def _changing(spark, sf):
    """Daily activity whose attributes change over time (the brand with the month's third, the model with
    whether any view happened), without one calendar day, so that gaps and fan-out show."""
    src = activity_daily(spark, sf).where(F.dayofmonth("period") != 11)
    brand = F.concat(F.lit("brand_"), F.floor(F.dayofmonth("period") / 11).cast("string"))
    model = F.when(F.col("completed_trip") > 0, F.col("vehicle_model"))
    return src.select("entity_id", "period", brand.alias("vehicle_brand"), model.alias("vehicle_model"), "sum_sh", "completed_trip", "not_churn")


CHANGING_FILLS = {"sum_sh": 0.0, "completed_trip": 0.0, "not_churn": 0}
CHANGING_COLS = ["entity_id", "period", *CHANGING_ATTRS, "sum_sh", "completed_trip", "not_churn"]


def q_panel_fanout(spark, sf):
    """J1 + J2 on changing attributes: one row per distinct attribute tuple and period, as the SQL panel fans out."""
    return P.densify_on_grid(_changing(spark, sf), CHANGING_FILLS, CHANGING_ATTRS).select(*CHANGING_COLS)


def q_panel_latest_attrs(spark, sf):
    """J2 on changing attributes, the default: one row per period with the entity's newest attributes."""
    return P.densify(_changing(spark, sf), CHANGING_FILLS, latest=CHANGING_ATTRS).select(*CHANGING_COLS)


def q_panel_attrs_changing(spark, sf):
    """J2b on changing attributes: an observation counts for its own tuple only."""
    return P.densify_by_tuple(_changing(spark, sf), CHANGING_FILLS, CHANGING_ATTRS).select(*CHANGING_COLS)


def _label_gap(how):
    """J3 / J3b where a calendar day is missing: the label of the day before it is dropped or 0."""
    def q(spark, sf):
        rows = _changing(spark, sf).select("entity_id", "period", "sum_sh", "completed_trip", "not_churn")
        lab = P.offset_flag(P.densify(rows, CHANGING_FILLS), "not_churn", S.LABEL, +1, how=how)
        lab = lab if how == "inner" else P.drop_newest(lab)
        return lab.select("entity_id", "period", "not_churn", S.LABEL)
    return q


def panel_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "src_activity": q_src_activity,
        "first_seen": q_first_seen,
        "panel_grid": q_panel_grid,
        "panel_densify": q_panel_densify,
        "panel_fill": q_panel_fill,
        "panel_densify_attrs": q_panel_densify_attrs,
        "panel_quarterly": q_panel_quarterly,
        "label_quarterly": q_label_quarterly,
        "label_next_inner": q_label_next_inner,
        "label_next_filled": q_label_next_filled,
        "flag_prev_filled": q_flag_prev_filled,
        "trailing_mean_1": _trailing(2),
        "trailing_mean_2": _trailing(3),
        "warmup_entity_1": q_warmup_entity_1,
        "warmup_entity_2": q_warmup_entity_2,
        "warmup_global_k": q_warmup_global_k,
        "split_oot": q_split_oot,
        "churn_rate_ttc": q_churn_rate_ttc,
        "audit_null_count": q_audit_null_count,
        "lookup_entity": q_lookup_entity,
    }
    q.update(S.SLICES)
    q.update(S.WEEKLY_SLICES)
    q["panel_fanout"] = q_panel_fanout
    q["panel_latest_attrs"] = q_panel_latest_attrs
    q["panel_densify_attrs_changing"] = q_panel_attrs_changing
    q["sql_panel_label"] = q_sql_panel_label
    q["sql_rates"] = q_sql_rates
    q["src_csv_accepted"] = q_src_csv_accepted
    q["src_csv_audit"] = q_src_csv_audit
    q["rates_file"] = q_rates_file
    q["slice_2p_stored"] = q_slice_2p_stored
    q["lookup_entity_stored"] = q_lookup_entity_stored
    q["label_gap_inner"] = _label_gap("inner")
    q["label_gap_filled"] = _label_gap("filled")
    return q


# ---------------------------------------------------------------------------
# Binning and WoE / IV (on the 1-period slice, development split)
# ---------------------------------------------------------------------------
from ..operators import binning as B  # noqa: E402
from ..operators import evaluate as D  # noqa: E402
from ..operators import woe as V  # noqa: E402

DISCRETE_CANDIDATES = ["ops_city_id", "device_type", "vehicle_model", "vehicle_brand", "segment"]


def train_1p(spark, sf):
    """Development rows of the 1-period slice."""
    return S.slice_1p(spark, sf).where(~F.col("is_test"))


def _bin_rule(name, source):
    def q(spark, sf):
        base = S.panel_measures(spark, sf) if name == "segment" else S.panel_1p(spark, sf)
        return B.apply_rule(base, name).select("entity_id", "period", source, name)
    return q


def q_bin_equal_width(spark, sf):
    b = B.equal_width(S.panel_1p(spark, sf), "total_fare", k=50)
    return b.select("entity_id", "period", "total_fare", "total_fare_fine_classing",
                    "total_fare_fine_classing_lo", "total_fare_fine_classing_hi")


def q_woe_discrete(spark, sf):
    """V1, shown in WoE order as the reference sorts it."""
    return V.woe_discrete(train_1p(spark, sf), "segment").orderBy("WoE", "segment")


def q_woe_iv_adjusted(spark, sf):
    return V.woe_discrete(train_1p(spark, sf), "completed_trip")


def q_woe_continuous(spark, sf):
    """V4, in bin order."""
    return V.woe_continuous(train_1p(spark, sf), "total_fare", k=50).orderBy("total_fare_fine_classing")


def q_woe_best_class_count(spark, sf):
    return V.best_class_count(train_1p(spark, sf), ["completed_trip"])


def q_iv_by_class_count(spark, sf):
    return V.iv_by_class_count(train_1p(spark, sf), DAILY_MEASURES)


def q_iv_rank_discrete(spark, sf):
    """V6 + O2: ranked IV_ADJUSTED desc, IV asc, DISTINCT asc (name breaks ties)."""
    return V.rank_order(V.iv_rank_discrete(train_1p(spark, sf), DISCRETE_CANDIDATES), "DISCRETE_COL", "DISTINCT")


def q_iv_rank_continuous(spark, sf):
    """V7 + O2: ranked IV_ADJUSTED desc, IV asc, BEST_CUT asc (name breaks ties)."""
    return V.rank_order(V.iv_rank_continuous(train_1p(spark, sf), DAILY_MEASURES), "CONTINUOUS_COL", "BEST_CUT")


# Discrete candidates of the sliced variants (2-period, 3-period).
DISCRETE_2P = ["segment", "not_churn"]
DISCRETE_3P = ["segment", "not_churn", "not_churn_pre_1w"]


def _train_slice(name):
    return lambda spark, sf: S.SLICES[name](spark, sf).where(~F.col("is_test"))


def _rank(name, kind, cols):
    train = _train_slice(name)

    def q(spark, sf):
        if kind == "discrete":
            return V.rank_order(V.iv_rank_discrete(train(spark, sf), cols), "DISCRETE_COL", "DISTINCT")
        return V.rank_order(V.iv_rank_continuous(train(spark, sf), cols), "CONTINUOUS_COL", "BEST_CUT")
    return q


def _with_nulls(spark, sf):
    """Observed rows with their NULL measures and levels; the label is the day's own flag."""
    return activity_daily(spark, sf).withColumn(S.LABEL, F.col("not_churn"))


def q_woe_continuous_nulls(spark, sf):
    """V4 where some values are NULL: they have no bin and do not count."""
    return V.woe_continuous(_with_nulls(spark, sf), "total_ETA", k=20)


def q_iv_rank_discrete_nulls(spark, sf):
    """V6 where some levels are NULL: they are no level and do not count."""
    return V.rank_order(V.iv_rank_discrete(_with_nulls(spark, sf), ["vehicle_model", "vehicle_brand", "segment"]), "DISCRETE_COL", "DISTINCT")


def woe_queries() -> dict[str, Query]:
    return {
        "woe_continuous_nulls": q_woe_continuous_nulls,
        "iv_rank_discrete_nulls": q_iv_rank_discrete_nulls,
        "iv_rank_discrete_2p": _rank("slice_2p", "discrete", DISCRETE_2P),
        "iv_rank_continuous_2p": _rank("slice_2p", "continuous", DAILY_MEASURES),
        "iv_rank_discrete_3p": _rank("slice_3p", "discrete", DISCRETE_3P),
        "iv_rank_continuous_3p": _rank("slice_3p", "continuous", DAILY_MEASURES),
        "bin_completed_trip": _bin_rule("completed_trip_discrete", "completed_trip"),
        "bin_total_fare": _bin_rule("total_fare_discrete", "total_fare"),
        "bin_total_eta": _bin_rule("total_ETA_discrete", "total_ETA"),
        "bin_distance": _bin_rule("distance_travelled_discrete", "distance_travelled"),
        "bin_segment": _bin_rule("segment", "sum_sh"),
        "bin_equal_width": q_bin_equal_width,
        "woe_discrete": q_woe_discrete,
        "woe_iv_adjusted": q_woe_iv_adjusted,
        "woe_continuous": q_woe_continuous,
        "woe_best_class_count": q_woe_best_class_count,
        "iv_by_class_count": q_iv_by_class_count,
        "iv_rank_discrete": q_iv_rank_discrete,
        "iv_rank_continuous": q_iv_rank_continuous,
    }


# ---------------------------------------------------------------------------
# Evaluation on the deterministic score (dev threshold .6, out-of-time .5)
# ---------------------------------------------------------------------------
KEYS = ["is_test"]
DEV_T, OOT_T = 0.6, 0.5


def split_threshold():
    return F.when(F.col("is_test"), F.lit(OOT_T)).otherwise(F.lit(DEV_T))


def _hist(spark, sf):
    return D.score_histogram(S.scored(spark, sf), KEYS)


def _counts(spark, sf):
    return D.threshold_counts(_hist(spark, sf), KEYS, split_threshold())


def q_score_threshold(spark, sf):
    s = D.predict(S.scored(spark, sf), split_threshold())
    return s.select("entity_id", "period", "is_test", "score", S.LABEL, "predict")


def q_value_counts_pred(spark, sf):
    from ..operators.stats import value_counts
    return value_counts(D.predict(S.scored(spark, sf), split_threshold()), [*KEYS, "predict"])


def q_confusion_matrix(spark, sf):
    return D.confusion(_counts(spark, sf), KEYS)


def q_classification_report(spark, sf):
    return D.classification_report(_counts(spark, sf), KEYS)


def q_roc_curve(spark, sf):
    return D.roc_points(_hist(spark, sf), KEYS)


def q_auroc(spark, sf):
    return D.auroc(_hist(spark, sf), KEYS).select(*KEYS, "auroc")


def q_gini(spark, sf):
    return D.auroc(_hist(spark, sf), KEYS).select(*KEYS, "gini")


def q_gains_curve(spark, sf):
    return D.gains(_hist(spark, sf), KEYS)


def q_gains_predicted_bad(spark, sf):
    return D.gains_predicted_bad(_hist(spark, sf), KEYS, split_threshold())


def q_ks_stat(spark, sf):
    return D.ks(_hist(spark, sf), KEYS)


def q_threshold_sweep(spark, sf):
    return D.threshold_sweep(_hist(spark, sf), KEYS)


def q_psi_label(spark, sf):
    return D.psi_label(S.scored(spark, sf))


def _result(spark, sf):
    s = D.predict(S.scored(spark, sf), split_threshold())
    return s.where(F.col("not_churn") == 1).select("entity_id", "period", S.LABEL, "predict", "is_test")


def q_result_scored_active(spark, sf):
    return _result(spark, sf).where(~F.col("is_test")).drop("is_test")


def q_result_union(spark, sf):
    r = _result(spark, sf)
    return r.where(~F.col("is_test")).unionByName(r.where(F.col("is_test")))


def q_rate_actual_vs_predicted(spark, sf):
    return D.rates_by_period(_result(spark, sf)).orderBy("period")


def q_psi_limits(spark, sf):
    """D10 where the out-of-time split has no churn at all: infinite terms, no error."""
    s = S.scored(spark, sf)
    return D.psi_label(s.where(~F.col("is_test") | (F.col(S.LABEL) == 1)))


def eval_queries() -> dict[str, Query]:
    return {
        "psi_limits": q_psi_limits,
        "score_threshold": q_score_threshold,
        "value_counts_pred": q_value_counts_pred,
        "confusion_matrix": q_confusion_matrix,
        "classification_report": q_classification_report,
        "roc_curve": q_roc_curve,
        "auroc": q_auroc,
        "gini": q_gini,
        "gains_curve": q_gains_curve,
        "gains_predicted_bad": q_gains_predicted_bad,
        "ks_stat": q_ks_stat,
        "threshold_sweep": q_threshold_sweep,
        "psi_label": q_psi_label,
        "result_scored_active": q_result_scored_active,
        "result_union": q_result_union,
        "rate_actual_vs_predicted": q_rate_actual_vs_predicted,
    }


# ---------------------------------------------------------------------------
# Encoding (exact oracles) and models (rows-only checks + unit tests)
# ---------------------------------------------------------------------------
from ..operators import encode as E  # noqa: E402
from ..operators import models as M  # noqa: E402
from . import variants as VR  # noqa: E402

V1P = VR.VARIANTS["1p"]
SELECTED_1P = V1P.selected()
ENC_KEYS = ["entity_id", "period"]


def _model_frames(spark, sf):
    return VR.split(VR.model_base(S.daily(spark, sf), V1P))


def q_encode_vocabulary(spark, sf):
    train, _ = _model_frames(spark, sf)
    return E.vocabulary(train, SELECTED_1P)


def q_encode_dummies(spark, sf):
    train, _ = _model_frames(spark, sf)
    return E.encode_long(train, E.vocabulary(train, SELECTED_1P), ENC_KEYS, SELECTED_1P)


def q_encode_pinned_vocab(spark, sf):
    train, test = _model_frames(spark, sf)
    return E.encode_long(test, E.vocabulary(train, SELECTED_1P), ENC_KEYS, SELECTED_1P)


def _logit(spark, sf, name="1p"):
    return VR.fit_global(S.daily(spark, sf), name, "logit")


def q_logit_fit(spark, sf):
    *_, fitted = _logit(spark, sf)
    return fitted.model.summary(spark).select("feature_no", "feature_name", "coefficient")


def q_logit_summary(spark, sf):
    *_, fitted = _logit(spark, sf)
    return fitted.model.summary(spark)


def q_logit_significant(spark, sf):
    *_, fitted = _logit(spark, sf)
    return fitted.model.summary(spark).where(F.col("p_value") < 0.05)


def _signal_fit(spark, sf):
    """The logistic model of one selected column on a label with signal (active today)."""
    base = VR.model_base(S.daily(spark, sf), V1P).withColumn(S.LABEL, F.col("not_churn"))
    return VR.fitted("logit", VR.split(VR.pattern_table(base, ["distance_travelled_discrete"]))[0], ["distance_travelled_discrete"])


def q_logit_significant_signal(spark, sf):
    """M4 on a label with signal: which features are significant is no matter of chance."""
    return _signal_fit(spark, sf).model.summary(spark).where("p_value < 0.05").select("feature_name")


def q_logit_wald_signal(spark, sf):
    """M1-M3 at value level: coefficients, sigma, z and p of a model that SQL can fit by Newton steps too."""
    t = _signal_fit(spark, sf).model.summary(spark)
    return t.select("feature_no", "feature_name", F.round("coefficient", 4).alias("coefficient"), F.round("sigma", 4).alias("sigma"),
                    F.round("z_score", 3).alias("z_score"), F.round("p_value", 4).alias("p_value"))


def q_logit_gradient(spark, sf):
    """M1 + M5 check: the C = 1 gradient at the fitted coefficients, per training dummy, is zero. Recomputed
    from the scored patterns: sum of w (p - y) x plus the coefficient (the intercept has no penalty)."""
    _, _, pat, fitted = _logit(spark, sf)
    train = VR.split(pat)[0]
    rest = F.col(VR.W) * (F.col("score") - F.col(S.LABEL))
    scored = E.with_positions(fitted.score(train), fitted.vocab, "at").select(rest.alias("r"), F.concat(F.array(F.lit(0)), F.transform("at", lambda i: i + 1)).alias("at"))
    grad = scored.select(F.explode("at").alias("feature_no"), "r").groupBy("feature_no").agg(F.sum("r").alias("g"))
    both = grad.join(fitted.model.summary(spark), "feature_no")
    penalty = F.when(F.col("feature_no") == 0, 0.0).otherwise(F.col("coefficient"))
    n = train.agg(F.sum(VR.W)).scalar().cast("double")
    return both.select("feature_no", "feature_name", F.round(F.abs(F.col("g") + penalty) / n, 4).alias("residual"))


def q_wald_information(spark, sf):
    """M2 check: sum of p (1 - p) x x' over the training rows for a probability known in SQL too (score share)."""
    base = VR.model_base(S.daily(spark, sf), V1P)
    pat = VR.split(VR.pattern_table(base, SELECTED_1P))[0]
    vocab = E.collect_vocabulary(E.vocabulary(pat, SELECTED_1P))
    p = F.when(F.col("not_churn") == 1, F.lit(0.75)).otherwise(F.lit(0.25))
    matrix = M.information_matrix(pat.withColumn("_wv", F.col(VR.W) * p * (1 - p)), vocab, "_wv")
    names = [f for _, _, f in vocab]
    cells = [(names[i], names[j], float(matrix[i, j])) for i in range(len(names)) for j in range(len(names)) if matrix[i, j] != 0]
    return spark.createDataFrame(cells, "feature_i string, feature_j string, information double")


def q_logit_score(spark, sf):
    """M5: probability of every row, development and out-of-time."""
    _, base, _, fitted = _logit(spark, sf)
    return fitted.score(base).select("entity_id", "period", "is_test", S.LABEL, "score")


def q_logit_score_rows(spark, sf):
    """M5 check: every row of the slice is scored once, with a probability."""
    s = q_logit_score(spark, sf)
    return s.groupBy("is_test").agg(F.count("*").alias("n_rows"), F.sum(S.LABEL).cast("bigint").alias("n_good"),
                                    F.count_if((F.col("score") > 0) & (F.col("score") < 1)).alias("n_probabilities"))


def _forest(spark, sf, name="1p"):
    return VR.fit_global(S.daily(spark, sf), name, "forest")


def q_rf_fit_score(spark, sf):
    """M6: forest probability of every row, development and out-of-time."""
    _, base, _, fitted = _forest(spark, sf)
    return fitted.score(base).select("entity_id", "period", "is_test", S.LABEL, "score")


def q_rf_score_rows(spark, sf):
    """M6 check: every row of the slice is scored once, with a probability."""
    s = q_rf_fit_score(spark, sf)
    return s.groupBy("is_test").agg(F.count("*").alias("n_rows"), F.sum(S.LABEL).cast("bigint").alias("n_good"),
                                    F.count_if(F.col("score").between(0, 1)).alias("n_probabilities"))


def _rf_importance(name):
    def q(spark, sf):
        """M7 + O3: importances, largest first."""
        *_, fitted = _forest(spark, sf, name)
        return M.importances(spark, fitted.model, fitted.vocab)
    return q


def q_rf_importance_sum(spark, sf):
    """M7 check: one importance per training dummy, none negative, summing to 1."""
    imp = _rf_importance("1p")(spark, sf)
    return imp.agg(F.count("*").alias("n_features"), F.round(F.sum("importance"), 9).alias("total"), (F.min("importance") >= 0).alias("none_negative"))


def q_kmeans_elbow_shape(spark, sf):
    """M8 check: ten points, the inertia never rises with k."""
    rows = VR.elbow(S.daily(spark, sf), "1p_attrs")
    drop = [True, *(b <= a * (1 + 1e-9) for (_, a), (_, b) in zip(rows, rows[1:]))]
    return spark.createDataFrame([(int(k), bool(d)) for (k, _), d in zip(rows, drop)], "k int, not_above_previous boolean")


def _elbow(name):
    def q(spark, sf):
        rows = VR.elbow(S.daily(spark, sf), name)
        return spark.createDataFrame([(int(k), float(c)) for k, c in rows], "k int, inertia double")
    return q


def q_kmeans_k1_sse(spark, sf):
    """M8 at k = 1: the mean squared distance from the overall mean (per training row, whole units)."""
    a = S.daily(spark, sf)
    v = VR.VARIANTS["1p_attrs"]
    train = VR.split(VR.model_base(a, v))[0]
    n = train.count()
    return spark.createDataFrame([(n, round(M.sse_one_cluster(train, v.kmeans_columns(a.measures)) / n))], "n_rows long, mean_square long")


def _assign(name):
    def q(spark, sf):
        rows = VR.clustered(S.daily(spark, sf), VR.VARIANTS[name])
        return rows.where(~F.col("is_test")).select("entity_id", "period", "cluster")
    return q


def q_kmeans_nearest(spark, sf):
    """M9 check: every training row sits at its nearest of three centres, where a centre is the mean of its rows."""
    a = S.daily(spark, sf)
    v = VR.VARIANTS["1p_attrs"]
    cols = v.kmeans_columns(a.measures)
    rows = VR.split(VR.clustered(a, v))[0]
    means = [[r[c] for c in cols] for r in rows.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).orderBy("cluster").collect()]
    near = M.nearest_centre(cols, means)
    share = F.count_if(F.col("cluster") == near) / F.count("*")
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"), (share > 0.999).alias("nearest"))


def q_kmeans_fixed_point(spark, sf):
    """M8/M9 check: carried until nothing moves, each centre is the mean of the rows nearest to it (per cluster, all columns)."""
    a = S.daily(spark, sf)
    v = VR.VARIANTS["1p_attrs"]
    cols = v.kmeans_columns(a.measures)
    train = VR.split(VR.cluster_rows(a, v))[0]
    centres = M.fit_kmeans(train, cols, VR.K, rel_tol=0.0)
    means = train.groupBy(M.nearest_centre(cols, centres).alias("cluster")).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    at = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "cluster int, " + ", ".join(f"`c_{c}` double" for c in cols))
    rests = F.lit(True)
    for c in cols:
        rests = rests & (F.abs(F.col(c) - F.col(f"c_{c}")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(c))))
    return means.join(at, "cluster").select("cluster", rests.alias("rests"))


def _rates(name, kind):
    return lambda spark, sf: VR.variant_rates(S.daily(spark, sf), name, kind)


def _rates_actual(name, kind):
    """The part of a model's weekly rates that does not depend on the model."""
    return lambda spark, sf: VR.variant_rates(S.daily(spark, sf), name, kind).select("period", "churn_actual")


def _evaluation(name, kind):
    return lambda spark, sf: VR.global_evaluation(S.daily(spark, sf), name, kind)


def _evaluation_checks(name, kind):
    return lambda spark, sf: VR.evaluation_checks(VR.global_evaluation(S.daily(spark, sf), name, kind))


def _cluster_evaluation(name, kind):
    return lambda spark, sf: VR.cluster_evaluation(S.daily(spark, sf), name, kind)


def _cluster_checks(name, kind):
    """Cluster family check: each cluster's model is evaluated on the whole out-of-time set."""
    def q(spark, sf):
        t = VR.evaluation_checks(VR.cluster_evaluation(S.daily(spark, sf), name, kind), ["cluster"])
        return t.where("is_test")
    return q


def _cluster_rank(name, kind, by_code=False):
    """Rankings per cluster; ``by_code`` uses the entity's remainder by three for K-means, so SQL can follow."""
    def q(spark, sf):
        cluster = F.col("entity_id") % 3 if by_code else None
        return VR.cluster_rankings(S.daily(spark, sf), name, kind, cluster)
    return q


def _cluster_summary(name):
    return lambda spark, sf: VR.cluster_logit_summary(S.daily(spark, sf), name)


def _cluster_importance(name):
    return lambda spark, sf: VR.cluster_forest_importance(S.daily(spark, sf), name)


KINDS = {"logit": "logit", "rf": "forest"}
SUFFIX = {"1p_attrs": "", "2p_global": "_2p", "3p_global": "_3p"}


def model_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "encode_vocabulary": q_encode_vocabulary,
        "encode_dummies": q_encode_dummies,
        "encode_pinned_vocab": q_encode_pinned_vocab,
        "logit_fit": q_logit_fit,
        "logit_summary": q_logit_summary,
        "logit_significant": q_logit_significant,
        "logit_significant_signal": q_logit_significant_signal,
        "logit_wald_signal": q_logit_wald_signal,
        "logit_gradient": q_logit_gradient,
        "wald_information": q_wald_information,
        "logit_score": q_logit_score,
        "logit_score_rows": q_logit_score_rows,
        "rf_fit_score": q_rf_fit_score,
        "rf_score_rows": q_rf_score_rows,
        "rf_importance_sum": q_rf_importance_sum,
        "kmeans_elbow_shape": q_kmeans_elbow_shape,
        "kmeans_k1_sse": q_kmeans_k1_sse,
        "kmeans_nearest": q_kmeans_nearest,
        "kmeans_fixed_point": q_kmeans_fixed_point,
    }
    for name in VR.GLOBAL:
        end = "" if name == "1p" else f"_{name}"
        q[f"rf_importance{end}"] = _rf_importance(name)
        for key, kind in KINDS.items():
            q[f"{key}_rates{end}"] = _rates(name, kind)
            q[f"{key}_evaluation{end}"] = _evaluation(name, kind)
            q[f"{key}_evaluation_checks{end}"] = _evaluation_checks(name, kind)
    q["logit_rates_actual"] = _rates_actual("1p", "logit")
    for name in VR.CLUSTERED:
        end = SUFFIX[name]
        q[f"kmeans_elbow{end}"] = _elbow(name)
        q[f"kmeans_assign{end}"] = _assign(name)
        q[f"cluster_logit_summary{end}"] = _cluster_summary(name)
        q[f"cluster_rf_importance{end}"] = _cluster_importance(name)
        for key, kind in KINDS.items():
            q[f"cluster_{key}_evaluation{end}"] = _cluster_evaluation(name, kind)
            q[f"cluster_{key}_checks{end}"] = _cluster_checks(name, kind)
        for kind in ("discrete", "continuous"):
            q[f"cluster_iv_{kind}{end}"] = _cluster_rank(name, kind)
            q[f"coded_iv_{kind}{end}"] = _cluster_rank(name, kind, by_code=True)
    return q


from ..operators import stats as ST  # noqa: E402


def q_describe_measures(spark, sf):
    """describe() of the measures of the dense 1-period panel."""
    return ST.describe(S.panel_1p(spark, sf), DAILY_MEASURES)


def stats_queries() -> dict[str, Query]:
    return {"describe_measures": q_describe_measures}
