"""Evaluation: ties, brute-force AUROC/KS, bucketed running sums, rates edge cases."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from retentio.operators import evaluate as D
from retentio.operators.cumulative import running_sums


def scored(spark, scores, labels, split=None):
    split = split or [False] * len(scores)
    return spark.createDataFrame([(float(s), int(y), bool(t)) for s, y, t in zip(scores, labels, split)],
                                 "score double, not_churn_1w int, is_test boolean")


def brute_auc(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auroc_with_ties_and_symmetry(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(400), 1)           # heavy ties
    y = (rng.random(400) < s).astype(int)
    a = D.auroc(D.score_histogram(scored(spark, s, y)), []).first()
    assert abs(a.auroc - brute_auc(s, y)) < 1e-12
    assert abs(a.gini - (2 * a.auroc - 1)) < 1e-15
    b = D.auroc(D.score_histogram(scored(spark, -s, y)), []).first()
    assert abs(a.auroc + b.auroc - 1) < 1e-12


def test_running_sums_many_buckets(spark):
    n = 3000
    rng = np.random.default_rng(9)
    vals = rng.permutation(n).astype(float)
    df = spark.createDataFrame([(float(v), 1, int(v) % 3) for v in vals], "score double, k int, c int")
    out = running_sums(df, ["k"], "score", ["c"], n_buckets=16).orderBy("score").collect()
    exp = np.cumsum([int(v) % 3 for v in sorted(vals)])
    assert [r.cum_c for r in out] == list(exp)
    desc = running_sums(df, [], "score", ["c"], descending=True, n_buckets=16).orderBy(F.desc("score")).collect()
    assert [r.cum_c for r in desc] == list(np.cumsum([int(v) % 3 for v in sorted(vals, reverse=True)]))


def test_ks_and_gains(spark):
    s = [0.1, 0.2, 0.2, 0.4, 0.9, 0.9]
    y = [0, 0, 1, 1, 1, 0]
    g = D.gains(D.score_histogram(scored(spark, s, y)), []).orderBy("score").collect()
    assert [r.cum_n_population for r in g] == [1, 3, 4, 6]
    assert g[-1].cum_perc_good == 1.0 and g[-1].cum_perc_bad == 1.0
    ks = D.ks(D.score_histogram(scored(spark, s, y)), []).first().ks
    assert abs(ks - max(r.cum_perc_bad - r.cum_perc_good for r in g)) < 1e-15


def test_report_single_class_and_sweep(spark):
    df = scored(spark, [0.7, 0.8, 0.9], [1, 1, 1])
    h = D.score_histogram(df)
    c = D.threshold_counts(h, [], F.lit(0.75))
    rep = {r.row: r for r in D.classification_report(c, []).collect()}
    assert rep["0"].precision == 0.0 and rep["0"].support == 0
    assert rep["1"].recall == 2 / 3 and rep["accuracy"].f1_score == 2 / 3
    sw = D.threshold_sweep(h, []).orderBy("threshold").collect()
    assert len(sw) == 11 and sw[3].threshold == 0.30000000000000004
    assert sw[-1].tp == 0 and sw[0].tp == 3


def test_confusion_scaffold_has_zero_cells(spark):
    df = scored(spark, [0.9, 0.8], [1, 1])
    cells = D.confusion(D.threshold_counts(D.score_histogram(df), [], F.lit(0.5)), []).collect()
    assert len(cells) == 4 and sum(r.n for r in cells) == 2


def test_psi_of_identical_shares_is_zero(spark):
    df = scored(spark, [0.5] * 8, [0, 1, 1, 1, 0, 1, 1, 1], [False] * 4 + [True] * 4)
    r = D.psi_label(df).first()
    assert r.psi_churn == 0.0 and r.psi_not_churn == 0.0


def test_rates_edge_weeks(spark):
    d = dt.date
    rows = [(d(2024, 1, 1), 1, 1), (d(2024, 1, 1), 1, 0),   # no churn row -> NULL actual
            (d(2024, 1, 8), 0, 0), (d(2024, 1, 8), 0, 1),   # only churn -> week missing
            (d(2024, 1, 15), 1, 1), (d(2024, 1, 15), 0, 1)]  # no predict-0 -> NULL predict
    res = spark.createDataFrame(rows, "period date, not_churn_1w int, predict int")
    got = {str(r.period): (r.churn_actual, r.churn_predict) for r in D.rates_by_period(res).collect()}
    assert got == {"2024-01-01": (None, 50.0), "2024-01-15": (50.0, None)}
    assert math.isfinite(50.0)


def test_evaluation_by_cluster_is_the_evaluation_of_each_cluster(spark):
    import random

    from retentio.operators import evaluate as D
    from retentio.plans import variants as VR
    rnd = random.Random(9)
    rows = [(c, t, round(rnd.random(), 1 + c), int(rnd.random() < 0.5)) for c in (0, 1) for t in (False, True) for _ in range(80)]
    df = spark.createDataFrame(rows, "cluster int, is_test boolean, score double, not_churn_1w int")
    limits = {0: (0.3, 0.5), 1: (0.6, 0.2)}
    both = VR.evaluation(D.score_histogram(df, ["cluster", "is_test"]), limits, D.psi_label(df, by=["cluster"]), ["cluster"])
    got = {tuple(r) for r in both.collect()}
    want = set()
    for c, pair in limits.items():
        mine = df.where(f"cluster = {c}")
        want |= {(c, *r) for r in VR.evaluation(D.score_histogram(mine, ["is_test"]), pair, D.psi_label(mine)).collect()}
    assert got == want and len({r[1] for r in got}) == 8
