"""WoE / IV: infinite levels, adjusted IV, best class count against a pandas brute force."""

import math

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from retentio.operators import woe as V


def frame(spark, rows, col="lvl", coltype="string"):
    return spark.createDataFrame(rows, f"{col} {coltype}, not_churn_1w int")


def brute_iv(levels, ys):
    """IV and IV_adjusted by definition (numpy, IEEE limits)."""
    df = pd.DataFrame({"l": levels, "y": ys})
    g = df.groupby("l")["y"].agg(["count", "sum"])
    good, bad = g["sum"].astype(float), (g["count"] - g["sum"]).astype(float)

    def iv(gd, bd):
        pg, pb = gd / gd.sum(), bd / bd.sum()
        with np.errstate(divide="ignore"):
            w = np.log(pg / pb)
        return float(((pg - pb) * w).sum())
    keep = (good > 0) & (bad > 0)
    return iv(good, bad), (iv(good[keep], bad[keep]) if keep.any() else None)


def test_woe_inf_levels(spark):
    rows = [("allgood", 1)] * 5 + [("allbad", 0)] * 3 + [("m1", 1), ("m1", 0), ("m1", 1)] + [("m2", 0), ("m2", 0), ("m2", 1)]
    out = {r.lvl: r for r in V.woe_discrete(frame(spark, rows), "lvl").collect()}
    assert out["allgood"].WoE == math.inf and out["allbad"].WoE == -math.inf
    assert out["m1"].IV == math.inf
    iv, adj = brute_iv([r[0] for r in rows], [r[1] for r in rows])
    assert math.isinf(iv)
    assert abs(out["m1"].IV_adjusted - adj) < 1e-8
    assert out["m1"].n_good == 2 and out["m1"].n_bad == 1 and out["m1"].n_obs == 3
    assert abs(sum(r.prop_n_obs for r in out.values()) - 1) < 1e-12


def test_all_levels_pure_gives_null_adjusted(spark):
    rows = [("a", 1), ("a", 1), ("b", 0)]
    r = V.woe_discrete(frame(spark, rows), "lvl").first()
    assert r.IV == math.inf and r.IV_adjusted is None


def test_iv_finite_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    lv = rng.integers(0, 6, 300)
    y = (rng.random(300) < 0.3 + 0.1 * lv / 6).astype(int)
    rows = [(f"L{a}", int(b)) for a, b in zip(lv, y)]
    r = V.woe_discrete(frame(spark, rows), "lvl").first()
    iv, adj = brute_iv([x for x, _ in rows], [yy for _, yy in rows])
    assert abs(r.IV - iv) < 1e-8 and abs(r.IV_adjusted - adj) < 1e-8


def test_best_class_count_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.gamma(2.0, 10.0, 500), 1)
    y = (rng.random(500) < 1 / (1 + np.exp(-(x - 20) / 8))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, not_churn_1w int")
    best = V.best_class_count(df, ["x"]).first()
    scores = []
    for k in range(3, 20):
        bins = pd.cut(pd.Series(x), k, labels=False)
        scores.append(brute_iv(list(bins), list(y))[1])
    k_best = 3 + int(np.argmax(scores))
    assert best.best_k == k_best
    assert abs(best.IV_adjusted - scores[k_best - 3]) < 1e-8


def test_rank_discrete_counts_levels(spark):
    rows = [(i % 3, i % 2, int(i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, not_churn_1w int")
    got = {r.DISCRETE_COL: r.DISTINCT for r in V.iv_rank_discrete(df, ["a", "b"]).collect()}
    assert got == {"a": 3, "b": 2}


def test_nulls_and_nan_have_no_bin(spark):
    rows = [(None, 1), (float("nan"), 0), (1.0, 1), (2.0, 0), (2.0, 1), (10.0, 0)]
    df = spark.createDataFrame(rows, "x double, not_churn_1w int")
    out = V.woe_continuous(df, "x", k=3).collect()
    assert sum(r.n_obs for r in out) == 4
    lv = spark.createDataFrame([(None, 1), ("a", 0), ("a", 1), ("b", 1)], "lvl string, not_churn_1w int")
    assert {r.lvl for r in V.woe_discrete(lv, "lvl").collect()} == {"a", "b"}
    assert V.iv_rank_discrete(lv, ["lvl"]).first().DISTINCT == 2


def test_interval_counts_keep_every_bin_exact(spark):
    from retentio.operators.binning import edge_list, snapped
    rng = np.random.default_rng(5)
    ks = range(3, 20)
    for x in (rng.gamma(2.0, 100.0, 300), np.round(rng.normal(0, 3, 300)), np.array([5.0] * 4), np.array([0.0, 1e-9, 1e9])):
        merged = sorted({e for k in ks for e in edge_list(float(x.min()), float(x.max()), k)})
        got = [r.s for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(snapped(F.col("x"), merged).alias("s")).collect()]
        assert got == [merged[np.searchsorted(merged, v)] for v in x]
    assert V.interval_counts(spark.createDataFrame([(float(v), 1) for v in rng.normal(size=2000)], "x double, not_churn_1w int"), ["x"], ks)[0].count() <= 190


def test_rankings_by_group_are_the_rankings_of_each_group(spark):
    import random
    rnd = random.Random(3)
    rows = [(g, rnd.choice("xyz"), rnd.choice([None, "u", "v"]), rnd.gauss(g, 1 + g), None if rnd.random() < 0.1 else rnd.random() * 10 ** g, int(rnd.random() < 0.3 + 0.2 * g))
            for g in range(3) for _ in range(300)] + [(3, "x", None, None, None, 1)]
    df = spark.createDataFrame(rows, "g int, a string, b string, m double, n double, not_churn_1w int")
    for rank, cols, name, tie in ((V.iv_rank_discrete, ["a", "b"], "DISCRETE_COL", "DISTINCT"), (V.iv_rank_continuous, ["m", "n"], "CONTINUOUS_COL", "BEST_CUT")):
        together = {tuple(r) for r in V.rank_order(rank(df, cols, by=["g"]), name, tie, ["g"]).collect()}
        alone = {(g, *r) for g in range(4) for r in V.rank_order(rank(df.where(f"g = {g}"), cols), name, tie).collect()}
        assert together == alone and len({r[0] for r in together}) >= 3
