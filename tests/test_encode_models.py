"""Pinned vocabulary and model properties (gradient, Wald, forest, elbow)."""

import math

import numpy as np
from pyspark.sql import functions as F

from retentio.operators import encode as E
from retentio.operators import models as M


def test_unseen_level_encodes_to_zeros(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, g string")
    test = spark.createDataFrame([(4, "a"), (5, "z"), (6, "c")], "id int, g string")
    vocab = E.vocabulary(train, ["g"])
    assert [r.feature for r in vocab.orderBy("position").collect()] == ["g:a", "g:b"]  # 'c' = baseline
    enc = {r.id: r.feature for r in E.encode_long(test, vocab, ["id"], ["g"]).collect()}
    assert enc == {4: "g:a"}                    # unseen 'z' and baseline 'c' -> all zeros


def test_numeric_levels_sort_numerically(spark):
    train = spark.createDataFrame([(i, v) for i, v in enumerate([9, 10, 2])], "id int, n int")
    vocab = [r.level for r in E.vocabulary(train, ["n"]).orderBy("position").collect()]
    assert vocab == ["2", "9"]


def toy(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 3, n)
    b = rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * a - 1.0 * b)))).astype(int)
    return spark.createDataFrame([(f"a{x}", f"b{z}", int(t)) for x, z, t in zip(a, b, y)],
                                 "ca string, cb string, not_churn_1w int"), a, b, y


def test_logit_is_the_c1_ridge_optimum_and_wald_matches_numpy(spark):
    df, a, b, y = toy(spark)
    vocab = E.collect_vocabulary(E.vocabulary(df, ["ca", "cb"]))
    fit = M.fit_logit(df, vocab)
    X = np.column_stack([(a == 0), (a == 1), (b == 0)]).astype(float)
    assert [f for _, _, f in vocab] == ["ca:a0", "ca:a1", "cb:b0"]
    eta = X @ fit.coef + fit.intercept
    p = 1 / (1 + np.exp(-eta))
    grad_w = X.T @ (p - y) + fit.coef            # C = 1, intercept unpenalised
    grad_b = np.sum(p - y)
    assert np.abs(grad_w).max() < 1e-4 and abs(grad_b) < 1e-4
    F_ = (X * (p * (1 - p))[:, None]).T @ X
    sig = np.sqrt(np.diag(np.linalg.inv(F_)))
    assert np.allclose(fit.sigma, sig, rtol=1e-5)
    pv = [math.erfc(abs(c / s) / math.sqrt(2)) for c, s in zip(fit.coef, sig)]
    assert np.allclose(fit.p, pv, rtol=1e-4)
    summ = fit.summary(spark).orderBy("feature_no").collect()
    assert summ[0].feature_name == "Intercept" and summ[0].p_value is None and len(summ) == 4
    sc = fit.score(df).select("score").collect()
    assert all(0 < r.score < 1 for r in sc)


def test_newton_steps_arrive_where_the_estimator_does(spark):
    df, *_ = toy(spark)
    vocab = E.collect_vocabulary(E.vocabulary(df, ["ca", "cb"]))
    fit = M.fit_logit(df, vocab)
    est = M.estimated(df, vocab, "not_churn_1w", 1.0, df.count(), None)
    assert np.allclose(np.r_[fit.intercept, fit.coef], est, atol=1e-5)


def test_models_fitted_together_are_the_models_fitted_alone(spark):
    df, *_ = toy(spark, 600, 5)
    df = df.withColumn("g", F.when(F.col("cb") == "b0", 0).otherwise(1)).withColumn("cc", F.concat(F.lit("x"), F.length("ca") + F.col("not_churn_1w")))
    parts = {g: df.where(F.col("g") == g) for g in (0, 1)}
    vocabs = E.vocabularies(df, {0: ["ca"], 1: ["ca", "cc"]}, "g")
    assert vocabs == {g: E.collect_vocabulary(E.vocabulary(parts[g], c)) for g, c in ((0, ["ca"]), (1, ["ca", "cc"]))}
    both = M.fit_logits({g: (parts[g], vocabs[g]) for g in (0, 1)})
    for g in (0, 1):
        alone = M.fit_logit(parts[g], vocabs[g])
        assert np.allclose(both[g].coef, alone.coef, atol=1e-9) and np.allclose(both[g].p, alone.p, atol=1e-9)


def test_weights_stand_for_rows(spark):
    df, *_ = toy(spark)
    vocab = E.collect_vocabulary(E.vocabulary(df, ["ca", "cb"]))
    pat = df.groupBy("ca", "cb", "not_churn_1w").agg(F.count("*").alias("w"))
    a, b = M.fit_logit(df, vocab), M.fit_logit(pat, vocab, weight="w")
    assert np.allclose(a.coef, b.coef, atol=1e-9) and np.allclose(a.sigma, b.sigma, atol=1e-9)


def test_one_class_and_empty_frames_are_errors(spark):
    import pytest
    df, *_ = toy(spark)
    vocab = E.collect_vocabulary(E.vocabulary(df, ["ca", "cb"]))
    with pytest.raises(ValueError, match="singular"):
        M.fit_logit(df.where("not_churn_1w = 1"), vocab)
    with pytest.raises(ValueError, match="empty"):
        M.fit_logit(df.limit(0), vocab)


def test_a_column_of_many_levels_encodes_and_fits(spark):
    """5,000 levels: the plan's text does not grow with them, and the fit is the sparse one."""
    rows = spark.range(20_000).select(F.format_string("l%05d", F.col("id") % 5000).alias("ca"), (F.xxhash64("id") % 2 == 0).cast("int").alias("not_churn_1w"))
    vocab = E.collect_vocabulary(E.vocabulary(rows, ["ca"]))
    x = E.with_vector(rows, vocab)
    assert len(vocab) == 4999 and x.first()["_features"].size == 4999 and x.where("ca = 'l04999'").first()["_features"].numNonzeros() == 0
    few = E.with_vector(rows, vocab[:3])
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(x) < 1.2 * size(few)
    fit = M.fit_logit(rows, vocab)
    p = rows.groupBy("ca").agg(F.avg("not_churn_1w").alias("y")).join(fit.score(rows).groupBy("ca").agg(F.first("score").alias("p")), "ca")
    assert p.where("y = 1").agg(F.min("p")).first()[0] > 0.5 > p.where("y = 0").agg(F.max("p")).first()[0]
    assert len(fit.sigma) == 4999 and (fit.sigma > 0).all()


def test_positions_of_unseen_null_and_baseline_levels(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("z", 9), (None, None)], "g string, n int")
    vocab = [("g", "a", "g:a"), ("g", "b", "g:b"), ("n", "2", "n:2")]
    assert [r.at for r in E.with_positions(df, vocab, "at").collect()] == [[0], [1, 2], [], []]
    assert [r.v.toArray().tolist() for r in E.with_vector(df, vocab, "v").collect()] == [[1, 0, 0], [0, 1, 1], [0, 0, 0], [0, 0, 0]]
    assert E.with_positions(df, [], "at").first().at == [] and E.with_vector(df, [], "v").first().v.size == 0


def test_forest_on_lots_scores_like_the_forest_on_rows(spark):
    """Out-of-time AUROC of resamples of patterns in lots against the row bootstrap."""
    from retentio.operators import evaluate as D
    rng = np.random.default_rng(11)
    n = 9000
    cols = {c: rng.integers(0, k, n) for c, k in (("ca", 6), ("cb", 4), ("cc", 3))}
    eta = 0.5 * (cols["ca"] > 2) - 0.8 * (cols["cb"] == 1) + 0.6 * (cols["cc"] == 2) * (cols["ca"] == 5)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    df = spark.createDataFrame([(f"a{a}", f"b{b}", f"c{c}", int(t), i % 3 == 0) for i, (a, b, c, t) in enumerate(zip(*cols.values(), y))],
                               "ca string, cb string, cc string, not_churn_1w int, is_test boolean")
    train, test = df.where("NOT is_test"), df.where("is_test")
    vocab = E.collect_vocabulary(E.vocabulary(train, ["ca", "cb", "cc"]))
    auc = []
    for lots in (10**9, 600):
        model = M.fit_forest(train, vocab, num_trees=40, bag_rows=lots)
        auc.append(D.auroc(D.score_histogram(M.forest_score(model, test, vocab)), []).first()["auroc"])
    assert auc[0] > 0.55 and abs(auc[0] - auc[1]) < 0.01


def test_forest_importances_sum_to_one(spark):
    df, *_ = toy(spark, 300, 2)
    vocab = E.collect_vocabulary(E.vocabulary(df, ["ca", "cb"]))
    model = M.fit_forest(df, vocab, num_trees=20)
    imp = M.importances(spark, model, vocab).collect()
    assert abs(sum(r.importance for r in imp) - 1) < 1e-9
    assert [r.rank_no for r in imp] == [1, 2, 3] and imp == sorted(imp, key=lambda r: (-r.importance, r.feature_name))


def test_forest_scores_in_a_session_that_has_observed_a_frame(spark):
    from pyspark.sql import Observation
    df, *_ = toy(spark, 100, 3)
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).collect()
    vocab = E.collect_vocabulary(E.vocabulary(df, ["ca", "cb"]))
    model = M.fit_forest(df, vocab, num_trees=3)
    assert M.forest_score(model, df, vocab).where("score BETWEEN 0 AND 1").count() == seen.get["n"] == 100


def test_elbow_non_increasing_and_k1_is_total_ss(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(float(x), float(z)) for x, z in pts], "x double, z double")
    elbow = dict(M.kmeans_elbow(df, ["x", "z"], ks=range(1, 5), restarts=3))
    assert abs(elbow[1] - ((pts - pts.mean(0)) ** 2).sum()) < 1e-6 * elbow[1]
    assert elbow[1] >= elbow[2] >= elbow[3] * 0.999
    lab = M.kmeans_assign(df, ["x", "z"], k=3)
    sizes = sorted(r["count"] for r in lab.groupBy("cluster").count().collect())
    assert sizes == [40, 40, 40]
    assert lab.agg(F.min("cluster"), F.max("cluster")).first() == (0, 2)


def test_kmeans_does_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(c, 1.2, (150, 2)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(float(x), float(z)) for x, z in pts], "x double, z double")
    sizes = [sorted((r.cluster, r["count"]) for r in M.kmeans_assign(df.repartition(n), ["x", "z"]).groupBy("cluster").count().collect()) for n in (1, 3, 7)]
    assert sizes[0] == sizes[1] == sizes[2]


def test_nearest_centres_by_products_are_those_by_differences():
    """Rows far from the origin, equal and nearly equal distances: the first of the nearest, as the differences tell it; and held at once
    are the distances of a few rows, not of a batch."""
    rng = np.random.default_rng(6)
    for scale, offset in ((1.0, 0.0), (1e-3, 1e7), (1e6, -1e8)):
        x = offset + scale * rng.integers(0, 6, (500, 3)).astype(float)
        points = np.concatenate([x[:4], x[:4] + scale * 1e-9, [x[0]] * 3, offset + scale * rng.random((5, 3)) * 6])
        cuts = [0, 4, 8, 11, 16]
        own = M.nearest_of(x, points, cuts)
        for lo, hi in zip(cuts, cuts[1:]):
            want = np.stack([((x - p) ** 2).sum(axis=1) for p in points[lo:hi]]).argmin(axis=0)
            assert (own[lo:hi].sum(axis=0) == 1).all() and (own[lo:hi].argmax(axis=0) == want).all()
    assert M.CHUNK_ROWS * 540 * 8 < 10_000_000


def test_scaled_clusters_see_small_columns(spark):
    """H8: with ``scale`` a column of small numbers counts as much as one of large numbers."""
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal(0, 1e6)), float(side + rng.normal(0, 0.01)), side) for side in (0, 1) for _ in range(150)]
    df = spark.createDataFrame(rows, "big double, small double, side int")
    split = lambda **kw: M.kmeans_assign(df, ["big", "small"], k=2, **kw).groupBy("side").agg(F.countDistinct("cluster").alias("n")).collect()
    assert [r.n for r in split(scale=True)] == [1, 1] and [r.n for r in split()] == [2, 2]
    assert M.kmeans_elbow(df, ["big", "small"], ks=[1, 2], restarts=2, scale=True)[0][1] == __import__("pytest").approx(600, rel=1e-9)


def test_cluster_features_must_not_be_null_and_repeat_as_weights(spark):
    import pytest
    df = spark.createDataFrame([(0.0, 0.0)] * 500 + [(5.0, 1.0)] * 3 + [(9.0, 2.0)], "x double, z double")
    rows = M.weighted_rows(df, ["x", "z"])
    assert {(tuple(r.x), r.w) for r in rows.collect()} == {((0.0, 0.0), 500.0), ((5.0, 1.0), 3.0), ((9.0, 2.0), 1.0)}
    centres = M.fit_kmeans(df, ["x", "z"], 2)
    assert np.allclose(centres, [[0, 0], [6, 1.25]])
    assert M.kmeans_elbow(df, ["x", "z"], ks=[3], restarts=2)[0][1] == pytest.approx(0, abs=1e-12)
    with pytest.raises(Exception, match="NULL in a cluster feature"):
        M.fit_kmeans(df.unionByName(spark.createDataFrame([(None, 1.0)], "x double, z double")), ["x", "z"])


def test_collinear_dummies_are_named(spark):
    import pytest
    rows = [("a", "x", 1), ("a", "x", 0), ("b", "y", 1), ("b", "y", 0), ("c", "z", 1), ("c", "z", 0)] * 5
    df = spark.createDataFrame(rows, "ca string, cb string, not_churn_1w int")
    with pytest.raises(ValueError, match="ca:a.*cb:x"):
        M.fit_logit(df, E.collect_vocabulary(E.vocabulary(df, ["ca", "cb"])))


def test_vocabulary_has_no_bound(spark):
    df = spark.createDataFrame([(f"l{i:05d}", "b") for i in range(12_000)], "ca string, cb string")
    vocab = E.vocabulary(df, ["ca", "cb"])
    assert vocab.count() == 11_999 and E.encode_long(df.withColumn("id", F.col("ca")), vocab, ["id"], ["ca"]).count() == 11_999
