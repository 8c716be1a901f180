"""Fit -> score -> evaluate flows of the reference's variants (section 3.3).

Global family (1p/2p/3p): one logistic model and one forest for all
entities. Cluster family (1p_attrs/2p_global/3p_global): K-means (k = 3) on
the unscaled numeric columns of the training rows, then one logistic model
and one forest per cluster, each scoring the whole out-of-time set.

Every flow runs over any ``slices.Activity``. After the slice, one aggregate
counts the rows per (selected levels, not_churn, label, period, split): the
**pattern table**. It is bounded by levels x periods, and it holds all that
vocabulary, fits, Wald sums, scores and every evaluation table need; only
row-level scores go back to the rows.

Parameters per variant (selected columns, thresholds) are the reference's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES
from ..operators import encode as E
from ..operators import evaluate as D
from ..operators import models as M
from ..operators import woe as V
from ..session import keep, keep_fanout, written
from . import slices as S

RULE_COLUMNS = ["completed_trip_discrete", "total_fare_discrete", "total_ETA_discrete",
                "distance_travelled_discrete"]
W = "w"
K = 3


@dataclass(frozen=True)
class Variant:
    slice_name: str
    candidates: tuple                  # discrete candidates of the ranking
    discrete: tuple                    # selected discrete columns, per model
    lr: tuple                          # (development, out-of-time) thresholds, per model
    rf: tuple
    clustered: bool = False
    flags: tuple = ("not_churn",)      # flag columns beside the measures in the cluster features

    def selected(self, model: int = 0) -> list[str]:
        return [*self.discrete[model], *RULE_COLUMNS]

    def thresholds(self, kind: str, model: int = 0) -> tuple[float, float]:
        return (self.lr if kind == "logit" else self.rf)[model]

    def kmeans_columns(self, measures) -> list[str]:
        codes = ["ops_city_id", "device_type"] if S.SPECS[self.slice_name].attrs else []
        return [*codes, *measures, *self.flags]


ATTRS_5 = ("ops_city_id", "device_type", "vehicle_model", "vehicle_brand", "segment")
SEG, SEG_F = ("segment",), ("segment", "not_churn")
SEG_FP = ("segment", "not_churn", "not_churn_pre_1w")

# Discrete candidates, selected columns and decision thresholds of the variants.
VARIANTS = {
    "1p": Variant("slice_1p", ATTRS_5, (SEG,), ((0.6, 0.5),), ((0.6, 0.5),)),
    "2p": Variant("slice_2p", SEG_F, (SEG_F,), ((0.6, 0.6),), ((0.6, 0.6),)),
    "3p": Variant("slice_3p", SEG_FP, (SEG_FP,), ((0.6, 0.6),), ((0.6, 0.5),)),
    "1p_attrs": Variant("slice_1p_attrs", ATTRS_5, (SEG, (), SEG), ((0.5, 0.5), (0.5, 0.5), (0.5, 0.9)),
                        ((0.5, 0.5), (0.5, 0.5), (0.5, 0.7)), True),
    "2p_global": Variant("slice_2p_global", SEG_F, (SEG_F,) * 3, ((0.9, 0.5), (0.5, 0.6), (0.5, 0.9)),
                         ((0.9, 0.7), (0.5, 0.6), (0.5, 0.9)), True),
    "3p_global": Variant("slice_3p_global", SEG_FP, (SEG_FP,) * 3, ((0.9, 0.5), (0.8, 0.7), (0.6, 0.5)),
                         ((0.7, 0.5), (0.8, 0.8), (0.6, 0.5)), True, ("not_churn", "not_churn_pre_1w")),
}
GLOBAL = ("1p", "2p", "3p")
CLUSTERED = ("1p_attrs", "2p_global", "3p_global")


def model_base(a: S.Activity, v: Variant) -> DataFrame:
    """The variant's slice with the rule bins (lazy)."""
    df = S.slice_of(a, S.SPECS[v.slice_name])
    return df.withColumns({n: RULES[n].expr() for n in RULE_COLUMNS})


def split(df: DataFrame):
    return df.where(~F.col("is_test")), df.where(F.col("is_test"))


def pattern_table(base: DataFrame, columns, more=(), period: str = "period") -> DataFrame:
    """(levels..., not_churn, label, period, is_test, w): one partial aggregate over the slice."""
    keys = list(dict.fromkeys([*columns, "not_churn", S.LABEL, period, "is_test", *more]))
    return keep(base.groupBy(*keys).agg(F.count(F.lit(1)).alias(W)))


# ---------------------------------------------------------------- models
class Fitted:
    """One fitted model: what it was fitted on, and how it scores any frame with its columns."""

    def __init__(self, kind: str, model, vocab) -> None:
        self.kind, self.model, self.vocab = kind, model, vocab

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.score(df) if self.kind == "logit" else M.forest_score(self.model, df, self.vocab)


def fitted(kind: str, train: DataFrame, columns) -> Fitted:
    """A model of the weighted pattern rows ``train``."""
    vocab = E.collect_vocabulary(E.vocabulary(train, columns))
    fit = M.fit_logit if kind == "logit" else M.fit_forest
    return Fitted(kind, fit(train, vocab, weight=W), vocab)


def fit_global(a: S.Activity, name: str, kind: str = "logit"):
    """(variant, base, pattern table, fitted model) of a global variant."""
    v = VARIANTS[name]
    base = model_base(a, v)
    pat = pattern_table(base, v.selected(), period=a.period)
    train = split(pat)[0]
    return v, base, pat, fitted(kind, train, v.selected())


def scored_result(scored: DataFrame, thresholds, period: str = "period") -> DataFrame:
    """Active rows with their prediction at the split's threshold, development and out-of-time."""
    t = F.when(F.col("is_test"), F.lit(thresholds[1])).otherwise(F.lit(thresholds[0]))
    out = D.predict(scored, t).where(F.col("not_churn") == 1)
    keyed = [c for c in ("entity_id", "driver_id") if c in out.columns]
    return out.select(*keyed, period, S.LABEL, "predict", "is_test", "score", *[W] * (W in out.columns))


def variant_rates(a: S.Activity, name: str, kind: str = "logit") -> DataFrame:
    """Steps 8-10 of a global variant: weekly actual vs predicted from the scored pattern table."""
    v, _, pat, fit = fit_global(a, name, kind)
    return D.rates_by_period(scored_result(fit.score(pat), v.thresholds(kind), a.period), a.period, weight=W)


def export_rates(a: S.Activity, out_dir: str, name: str = "1p") -> dict[str, str]:
    """S3 + O1: the reference's ``logistic_<n>w.csv`` / ``rf_<n>w.csv`` reports, in period order."""
    from ..sources.tables import write_ordered
    paths = {}
    for kind, stem in (("logit", "logistic"), ("forest", "rf")):
        path = f"{out_dir.rstrip('/')}/{stem}_{name}.csv"
        write_ordered(variant_rates(a, name, kind), path, [a.period])
        paths[kind] = path
    return paths


# ---------------------------------------------------------------- evaluation
EVALUATION = "section string, is_test boolean, threshold double, item string, value double"


def threshold_at(thresholds) -> Column:
    """The split's threshold: ``(development, out-of-time)``, or such a pair per cluster."""
    if not isinstance(thresholds, dict):
        return F.when(F.col("is_test"), F.lit(thresholds[1])).otherwise(F.lit(thresholds[0]))
    t = None
    for c, pair in thresholds.items():
        t = (F if t is None else t).when(F.col("cluster") == c, threshold_at(pair))
    return t


def evaluation(hist: DataFrame, thresholds, psi: DataFrame, by=()) -> DataFrame:
    """All evaluation tables of the models from their score histogram ``(by..., is_test, score, n_pos, n_neg)``, stacked as
    ``(by..., section, is_test, threshold, item, value)``: confusion, report, roc, gains, predicted_bad, summary, sweep, psi.
    Models are a key like the split: one set of plans serves all, and one running sum all curves."""
    by = list(by)
    keys = [*by, "is_test"]
    t = threshold_at(thresholds)
    counts = D.threshold_counts(hist, keys, t)
    none = F.lit(None).cast("double")
    curve = keep_fanout(D.curve(hist, keys, t))

    def long(df, section, at, items):
        cells = F.array(*[F.struct(F.lit(n).alias("item"), c.cast("double").alias("value")) for n, c in items])
        return df.select(*by, F.lit(section).alias("section"), "is_test", at.alias("threshold"), F.inline(cells))

    col = F.col
    report = D.classification_report(counts, keys)
    out = [
        long(counts, "confusion", t, [(c, col(c)) for c in ("tn", "fp", "fn", "tp")]),
        report.select(*by, F.lit("report").alias("section"), "is_test", t.alias("threshold"), F.inline(F.array(*[
            F.struct(F.concat_ws(" ", "row", F.lit(c)).alias("item"), col(c).cast("double").alias("value"))
            for c in ("precision", "recall", "f1_score", "support")]))),
        long(D.roc_of(curve, keys), "roc", col("threshold"), [("fpr", col("fpr")), ("tpr", col("tpr"))]),
        long(D.gains_of(curve, keys), "gains", col("score"), [(c, col(c)) for c in (
            "cum_n_population", "cum_n_good", "cum_n_bad", "cum_perc_population", "cum_perc_good", "cum_perc_bad")]),
        long(D.predicted_bad_of(curve, keys), "predicted_bad", col("score"), [("cum_perc_predicted_bad", col("cum_perc_predicted_bad"))]),
        long(D.auroc_of(curve.drop("P", "N"), keys).join(D.ks_of(curve, keys), keys), "summary", none, [(c, col(c)) for c in ("auroc", "gini", "ks")]),
        long(D.threshold_sweep(hist, keys), "sweep", col("threshold"), [(c, col(c)) for c in D.SWEEP_COLUMNS]),
        long(psi.withColumn("is_test", F.lit(True)), "psi", none, [(c, col(c)) for c in ("psi_churn", "psi_not_churn")]),
    ]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def global_evaluation(a: S.Activity, name: str, kind: str) -> DataFrame:
    v, _, pat, fit = fit_global(a, name, kind)
    hist = D.score_histogram(fit.score(pat), ["is_test"], weight=W)
    return evaluation(hist, v.thresholds(kind), D.psi_label(pat, weight=W))


def evaluation_checks(table: DataFrame, by=()) -> DataFrame:
    """What an evaluation must agree on with the data, whatever the model: the confusion cells add up to the rows
    and goods of the split, the gains curve ends at them, the ROC runs from (0,0) to (1,1) without falling."""
    item, value, section = F.col("item"), F.col("value"), F.col("section")
    pick = lambda s, i: F.when((section == s) & item.isin(*i), value)
    near_one = lambda s, i: F.round(F.max(pick(s, [i])), 9) == 1.0
    return table.where(section != "psi").groupBy(*by, "is_test").agg(
        F.sum(pick("confusion", ["tn", "fp", "fn", "tp"])).cast("bigint").alias("n_rows"),
        F.sum(pick("confusion", ["fn", "tp"])).cast("bigint").alias("n_good"),
        F.max(pick("gains", ["cum_n_population"])).cast("bigint").alias("gains_rows"),
        F.max(pick("gains", ["cum_n_good"])).cast("bigint").alias("gains_good"),
        F.max(pick("sweep", ["support_1"])).cast("bigint").alias("sweep_good"),
        (near_one("roc", "tpr") & near_one("roc", "fpr") & (F.min(pick("roc", ["tpr"])) == 0)).alias("roc_spans"),
        (F.round(F.max(pick("summary", ["gini"])) - 2 * F.max(pick("summary", ["auroc"])), 9) == -1.0).alias("gini_agrees"))


# ---------------------------------------------------------------- cluster family
def cluster_rows(a: S.Activity, v: Variant, more=()) -> DataFrame:
    """What the cluster family reads of the slice, written once: cluster features, candidates, selected columns, label, split."""
    chosen = [c for some in v.discrete for c in some]
    keyed = ["not_churn", S.LABEL, a.period, "is_test"]
    columns = list(dict.fromkeys([*more, *v.kmeans_columns(a.measures), *v.candidates, *chosen, *RULE_COLUMNS, *keyed]))
    return written(model_base(a, v).select(*columns))


def with_clusters(rows: DataFrame, a: S.Activity, v: Variant, k: int = K) -> DataFrame:
    """Adds the K-means cluster: centres fitted on the training rows, the label a row-local expression over them."""
    columns = v.kmeans_columns(a.measures)
    centres = M.fit_kmeans(split(rows)[0], columns, k)
    return rows.withColumn("cluster", M.nearest_centre(columns, centres).cast("int"))


def clustered(a: S.Activity, v: Variant, k: int = K, cluster=None) -> DataFrame:
    """The variant's rows (:func:`cluster_rows` and the entity) with their cluster; ``cluster`` may give it as an expression instead of K-means."""
    rows = cluster_rows(a, v, [a.entity])
    return with_clusters(rows, a, v, k) if cluster is None else rows.withColumn("cluster", cluster.cast("int"))


def cluster_rankings(a: S.Activity, name: str, kind: str, cluster=None, k: int = K) -> DataFrame:
    """Step 6 per cluster: IV ranking of the training rows of each cluster, the cluster being a key of every aggregate."""
    v, by = VARIANTS[name], ["cluster"]
    train = split(clustered(a, v, k, cluster))[0]
    if kind == "discrete":
        return V.rank_order(V.iv_rank_discrete(train, v.candidates, by=by), "DISCRETE_COL", "DISTINCT", by)
    return V.rank_order(V.iv_rank_continuous(train, a.measures, by=by), "CONTINUOUS_COL", "BEST_CUT", by)


def cluster_fits(a: S.Activity, name: str, kind: str, k: int = K, cluster=None) -> tuple[Variant, DataFrame, dict[int, Fitted]]:
    """(variant, pattern table of all clusters, fitted model of each cluster with training rows). The logistic models share
    their steps' aggregates."""
    v = VARIANTS[name]
    rows = clustered(a, v, k, cluster)
    columns = sorted({c for i in range(k) for c in v.selected(i)})
    pat = pattern_table(rows, columns, ["cluster"], a.period)
    train = split(pat)[0]
    have = sorted(r.cluster for r in train.select("cluster").distinct().collect())
    vocabs = E.vocabularies(train, {c: v.selected(c) for c in have}, "cluster")
    if kind == "logit":
        fits = M.fit_logits({c: (train.where(F.col("cluster") == c), vocabs[c]) for c in have}, weight=W)
        return v, pat, {c: Fitted(kind, fits[c], vocabs[c]) for c in have}
    return v, pat, {c: Fitted(kind, M.fit_forest(train.where(F.col("cluster") == c), vocabs[c], weight=W), vocabs[c]) for c in have}


def cluster_scored(pat: DataFrame, fits: dict[int, Fitted], train: bool = True) -> DataFrame:
    """Each cluster's model on its training rows (if asked for) and on the whole out-of-time set; ``cluster`` is the model's."""
    out = None
    for c, fit in fits.items():
        mine = F.col("is_test") | (F.col("cluster") == c) if train else F.col("is_test")
        part = fit.score(pat.where(mine)).withColumn("cluster", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def cluster_evaluation(a: S.Activity, name: str, kind: str, k: int = K) -> DataFrame:
    """Step 9 per cluster: evaluation of each cluster's model on its training rows and on the whole out-of-time set, from one
    histogram keyed by cluster."""
    v, pat, fits = cluster_fits(a, name, kind, k)
    scored = cluster_scored(pat, fits)
    hist = D.score_histogram(scored, ["cluster", "is_test"], weight=W)
    return evaluation(hist, {c: v.thresholds(kind, c) for c in fits}, D.psi_label(scored, weight=W, by=["cluster"]), ["cluster"])


def cluster_logit_summary(a: S.Activity, name: str = "1p_attrs", k: int = K) -> DataFrame:
    """Coefficient tables of the clusters' models, each with the AUROC of its out-of-time scoring."""
    _, pat, fits = cluster_fits(a, name, "logit", k)
    hist = D.score_histogram(cluster_scored(pat, fits, train=False), ["cluster"], weight=W)
    auc = D.auroc(hist, ["cluster"]).select("cluster", F.col("auroc").alias("oot_auroc"))
    out = None
    for c, fit in fits.items():
        t = fit.model.summary(pat.sparkSession).select(F.lit(c).alias("cluster"), "*")
        out = t if out is None else out.unionByName(t)
    return out.join(F.broadcast(auc), "cluster", "left")


def cluster_forest_importance(a: S.Activity, name: str = "1p_attrs", k: int = K) -> DataFrame:
    """M6/M7 per cluster: one forest per cluster, importances stacked with the cluster id."""
    _, pat, fits = cluster_fits(a, name, "forest", k)
    out = None
    for c, fit in fits.items():
        t = M.importances(pat.sparkSession, fit.model, fit.vocab).select(F.lit(c).alias("cluster"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def elbow(a: S.Activity, name: str) -> list[tuple[int, float]]:
    v = VARIANTS[name]
    return M.kmeans_elbow(split(model_base(a, v))[0], v.kmeans_columns(a.measures))
