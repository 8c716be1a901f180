"""Model evaluation as relational queries.

Every metric starts from a histogram ``(keys..., score, n_pos, n_neg)`` --
one partial-aggregated ``groupBy`` over the scored rows -- so nothing sorts
or windows raw rows. Curves use :func:`running_sums` (bucketed prefix sums);
threshold metrics are conditional sums over the histogram x a small
broadcast of thresholds.

Positive class = label 1 (the reference's "not churned / good").
Thresholds are strict: predict 1 when score > t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import LOG_DIGITS, linspace_thresholds, ratio, strict_threshold
from ..session import keep_fanout
from .cumulative import running_sums
from .scalars import attach

SCORE, LABEL = "score", "not_churn_1w"


def _count(cond: Column, weight: str | None) -> Column:
    """Rows that meet ``cond``, or their summed weight (rows that stand for many)."""
    return F.count_if(cond) if weight is None else F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0)).cast("bigint")


def score_histogram(df: DataFrame, keys: Sequence[str] = (), score: str = SCORE,
                    label: str = LABEL, weight: str | None = None) -> DataFrame:
    """(keys..., score, n_pos, n_neg). Persisted: every metric reads it from
    several branches, and without it each branch would re-run the whole
    upstream plan (the branches prune it differently, so exchanges are not reused)."""
    y = F.col(label)
    return keep_fanout(df.groupBy(*keys, score).agg(_count(y == 1, weight).alias("n_pos"), _count(y == 0, weight).alias("n_neg")))


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(df, small, keys)


def predict(df: DataFrame, threshold: Column | float, score: str = SCORE, out: str = "predict") -> DataFrame:
    """D1 / P12."""
    return df.withColumn(out, strict_threshold(score, threshold))


def threshold_counts(hist: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """(keys..., tp, fp, fn, tn) for one threshold expression (may depend on keys)."""
    above = F.col(SCORE) > threshold
    agg = [F.sum(F.when(above, F.col("n_pos")).otherwise(0)).alias("tp"),
           F.sum(F.when(above, F.col("n_neg")).otherwise(0)).alias("fp"),
           F.sum(F.when(~above, F.col("n_pos")).otherwise(0)).alias("fn"),
           F.sum(F.when(~above, F.col("n_neg")).otherwise(0)).alias("tn")]
    out = hist.groupBy(*keys).agg(*agg) if keys else hist.agg(*agg)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("tp", "fp", "fn", "tn")})


def confusion(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., actual, predicted, n) on the full 2x2 scaffold."""
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
                      for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return counts.select(*keys, F.inline(cells))


def _report_cols(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Per-class precision/recall/f1 and averages; 0 where undefined (sklearn's zero_division)."""
    def z(num, den):
        return F.coalesce(ratio(num, den), F.lit(0.0))
    s1, s0 = tp + fn, tn + fp
    p1, r1, f1 = z(tp, tp + fp), z(tp, s1), z(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = z(tn, tn + fn), z(tn, s0), z(2 * tn, 2 * tn + fn + fp)
    tot = (s0 + s1).cast("double")
    return {
        "precision_0": p0, "recall_0": r0, "f1_0": f0, "support_0": s0,
        "precision_1": p1, "recall_1": r1, "f1_1": f1, "support_1": s1,
        "accuracy": z(tp + tn, s0 + s1),
        "macro_precision": (p0 + p1) / 2, "macro_recall": (r0 + r1) / 2, "macro_f1": (f0 + f1) / 2,
        "weighted_precision": (p0 * s0 + p1 * s1) / tot, "weighted_recall": (r0 * s0 + r1 * s1) / tot,
        "weighted_f1": (f0 * s0 + f1 * s1) / tot,
    }


# Columns of one threshold's report in the sweep.
SWEEP_COLUMNS = ["accuracy", *(f"{m}_{c}" for c in (0, 1) for m in ("precision", "recall", "f1", "support")),
                 *(f"{a}_{m}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1"))]


def classification_report(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D3: long form (keys..., row, precision, recall, f1_score, support)."""
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    wide = counts.withColumns(_report_cols(c["tp"], c["fp"], c["fn"], c["tn"]))
    rows = []
    for row, p, r, f, s in (("0", "precision_0", "recall_0", "f1_0", "support_0"),
                            ("1", "precision_1", "recall_1", "f1_1", "support_1"),
                            ("accuracy", None, None, "accuracy", None),
                            ("macro avg", "macro_precision", "macro_recall", "macro_f1", None),
                            ("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1", None)):
        sup = F.col(s) if s else F.col("support_0") + F.col("support_1")
        rows.append(F.struct(F.lit(row).alias("row"),
                             (F.col(p) if p else F.lit(None).cast("double")).alias("precision"),
                             (F.col(r) if r else F.lit(None).cast("double")).alias("recall"),
                             F.col(f).alias("f1_score"), sup.cast("bigint").alias("support")))
    return wide.select(*keys, F.inline(F.array(*rows)))


def threshold_sweep(hist: DataFrame, keys: Sequence[str], thresholds: Sequence[float] | None = None) -> DataFrame:
    """The report at each threshold (11 by default), from the histogram x thresholds."""
    th = thresholds or linspace_thresholds(11)
    j = hist.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in th])))
    counts = threshold_counts(j, [*keys, "threshold"], F.col("threshold"))
    cols = _report_cols(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counts.select(*keys, "threshold", "tp", "fp", "fn", "tn", *[cols[k].alias(k) for k in SWEEP_COLUMNS])


def curve(hist: DataFrame, keys: Sequence[str], threshold: Column | None = None) -> DataFrame:
    """The histogram with everything that curves are made of: running sums by ascending score (population, good, bad and,
    with ``threshold``, rows predicted 0) beside the totals P, N and T. One pass serves ROC, AUROC, gains, KS."""
    h = hist.withColumns({"n_all": F.col("n_pos") + F.col("n_neg"),
                          "n_pred0": F.lit(0) if threshold is None else F.when(F.col(SCORE) > threshold, F.lit(0)).otherwise(F.col("n_pos") + F.col("n_neg"))})
    agg = [F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"), F.sum("n_pred0").alias("T")]
    totals = h.groupBy(*keys).agg(*agg) if keys else h.agg(*agg)
    return _attach(running_sums(h, keys, SCORE, ["n_all", "n_pos", "n_neg", "n_pred0"]), totals, keys)


def roc_points(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., threshold, fpr, tpr): the origin at threshold +inf, then one point per distinct score, highest first."""
    return roc_of(curve(hist, keys), keys)


def roc_of(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    points = c.select(*keys, F.col(SCORE).alias("threshold"), ratio(F.col("N") - F.col("cum_n_neg") + F.col("n_neg"), "N").alias("fpr"),
                      ratio(F.col("P") - F.col("cum_n_pos") + F.col("n_pos"), "P").alias("tpr"))
    zero = F.lit(0.0)
    origin = c.select(*keys).distinct() if keys else c.agg(F.count("*")).select()
    return points.unionByName(origin.select(*keys, F.lit(float("inf")).alias("threshold"), zero.alias("fpr"), zero.alias("tpr")))


def auroc(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D5 (+D6): AUROC with tied scores at half weight, and Gini = 2*AUROC - 1."""
    return auroc_of(running_sums(hist, keys, SCORE, ["n_neg"]), keys)


def auroc_of(cum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """2 * P * N * AUROC = sum over scores of n_pos * (2 * negatives below + n_neg),
    an exact integer (DECIMAL(38,0) so it cannot overflow at scale).
    """
    term = (F.col("n_pos").cast("decimal(38,0)")
            * (F.lit(2) * (F.col("cum_n_neg") - F.col("n_neg")) + F.col("n_neg")).cast("decimal(38,0)"))
    agg = [F.sum(term).alias("_num"), F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N")]
    s = cum.groupBy(*keys).agg(*agg) if keys else cum.agg(*agg)
    a = F.col("_num").cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double"))
    s = s.withColumn("auroc", F.when((F.col("P") > 0) & (F.col("N") > 0), a))
    return s.select(*keys, "auroc", (F.lit(2.0) * F.col("auroc") - F.lit(1.0)).alias("gini"))


def gains(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D7 (W2-W4): cumulative population / good / bad, ascending score, per distinct score."""
    return gains_of(curve(hist, keys), keys)


def gains_of(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    return c.select(*keys, SCORE,
                      F.col("cum_n_all").alias("cum_n_population"), F.col("cum_n_pos").alias("cum_n_good"),
                      F.col("cum_n_neg").alias("cum_n_bad"),
                      ratio("cum_n_all", F.col("P") + F.col("N")).alias("cum_perc_population"),
                      ratio("cum_n_pos", "P").alias("cum_perc_good"),
                      ratio("cum_n_neg", "N").alias("cum_perc_bad"))


def gains_predicted_bad(hist: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """Running share of rows predicted 0 (score <= t), ascending score."""
    return predicted_bad_of(curve(hist, keys, threshold), keys)


def predicted_bad_of(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    return c.select(*keys, SCORE, ratio("cum_n_pred0", "T").alias("cum_perc_predicted_bad"))


def ks(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """max(cum % bad - cum % good) over the distinct-score curve."""
    return ks_of(curve(hist, keys), keys)


def ks_of(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = gains_of(c, keys)
    agg = [F.max(F.col("cum_perc_bad") - F.col("cum_perc_good")).alias("ks")]
    return g.groupBy(*keys).agg(*agg) if keys else g.agg(*agg)


def psi_label(df: DataFrame, is_test: str = "is_test", label: str = LABEL, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """PSI pair of the churn share, development vs out-of-time (per group)."""
    y0 = F.col(label) == 0
    test = F.col(is_test)
    s = (df.groupBy(*by) if by else df).agg(_count(y0 & ~test, weight).alias("_d0"), _count(~test, weight).alias("_dn"),
               _count(y0 & test, weight).alias("_t0"), _count(test, weight).alias("_tn"))
    d, t = ratio("_d0", "_dn"), ratio("_t0", "_tn")
    one = F.lit(1.0)
    return s.select(
        *by, psi_term(t, d, t - d).alias("psi_churn"), psi_term(one - t, one - d, d - t).alias("psi_not_churn"),
        d.alias("dev_churn_share"), t.alias("oot_churn_share"))


def psi_term(a: Column, b: Column, diff: Column) -> Column:
    """diff * ln(a / b) with IEEE limits: +inf if one share is 0, NaN if both are."""
    return (F.when((a == 0) & (b == 0), F.lit(float("nan"))).when((a == 0) | (b == 0), F.lit(float("inf")))
            .otherwise(F.round(diff * F.log(a / F.when(b != 0, b)), LOG_DIGITS)))


def rates_by_period(result: DataFrame, period: str = "period", label: str = LABEL,
                    pred: str = "predict", weight: str | None = None) -> DataFrame:
    """Weekly actual vs predicted churn %, one conditional aggregation.

    Restates the reference's four-CTE left joins: only periods with at least
    one label-1 row appear; churn_actual is NULL without a label-0 row;
    churn_predict is NULL unless the period has both predict-1 and predict-0.
    """
    y, p = F.col(label), F.col(pred)
    g = result.groupBy(period).agg(_count(y == 1, weight).alias("_y1"), _count(y == 0, weight).alias("_y0"),
                                   _count(p == 1, weight).alias("_p1"), _count(p == 0, weight).alias("_p0"))
    pct = F.lit(100.0)
    return g.where(F.col("_y1") > 0).select(
        period,
        F.when(F.col("_y0") > 0, F.col("_y0") * pct / (F.col("_y1") + F.col("_y0"))).alias("churn_actual"),
        F.when((F.col("_p1") > 0) & (F.col("_p0") > 0),
               F.col("_p0") * pct / (F.col("_p1") + F.col("_p0"))).alias("churn_predict"))


