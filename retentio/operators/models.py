"""Model fits (M1-M10), as Spark aggregates over tables that the data's levels bound, and on ``pyspark.ml``.

* Logistic regression (M1) is the reference's default ridge fit (C = 1, unpenalised intercept). With dummy
  features the likelihood depends on the distinct feature patterns only: the fit runs on ``(active positions, label,
  weight)`` rows. Each Newton step is one aggregate over the pairs of dummies that are active together, which gives gradient,
  information matrix and loss of all models at once (one model per cluster is no more work than one); the driver
  solves the d x d system. Beyond ``NEWTON_FEATURES`` dummies the estimator of ``pyspark.ml`` fits on sparse vectors.
* Wald statistics (M2): the information matrix without intercept holds ``sum w p (1 - p)`` over the rows in which two dummies
  are active together, so the same aggregate gives it.
* Forest (M6/M7): ``pyspark.ml`` on the weighted patterns.
* K-means (M8/M9): Lloyd's steps of all (k, start) in one scan of the weighted distinct rows per step.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, keep, written
from .binning import doubles
from .encode import with_positions, with_vector

LABEL = "not_churn_1w"
# Dummies up to which a fit takes Newton steps with a dense d x d matrix on the driver.
NEWTON_FEATURES = 1500


# ---------------------------------------------------------------- logistic ---
class LogitFit:
    """Fitted logistic model plus its coefficient table (M1-M4)."""

    def __init__(self, vocab_list, coef, intercept, information, n_train):
        self.vocab_list, self.coef, self.intercept = list(vocab_list), np.asarray(coef, float), float(intercept)
        self.information, self.n_train = information, n_train
        self.sigma, self.z, self.p = wald_no_intercept(information, self.coef, self.features)

    @property
    def features(self) -> list[str]:
        return [f for _, _, f in self.vocab_list]

    def summary(self, spark) -> DataFrame:
        """M3: (feature_no, feature_name, coefficient, sigma, z_score, p_value); row 0 = intercept."""
        rows = [(0, "Intercept", float(self.intercept), None, None, None)]
        for i, f in enumerate(self.features):
            rows.append((i + 1, f, float(self.coef[i]), _f(self.sigma[i]), _f(self.z[i]), _f(self.p[i])))
        return spark.createDataFrame(
            rows, "feature_no int, feature_name string, coefficient double, sigma double, "
                  "z_score double, p_value double")

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """M5: positive-class probability, computed row-wise (no shuffle)."""
        x = with_positions(df, self.vocab_list, "_positions")
        return x.withColumn(out, probability(linear(F.col("_positions"), self.intercept, self.coef))).drop("_positions")


def _f(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)


def linear(positions: Column, intercept: float, coef: Sequence[float]) -> Column:
    """Intercept plus the coefficients at the positions; the coefficients are one literal array."""
    if not len(coef):
        return F.lit(float(intercept))
    parts = F.transform(positions, lambda i: F.element_at(doubles(coef), i + 1))
    return F.aggregate(parts, F.lit(float(intercept)), lambda s, x: s + x)


def probability(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def positions_table(models: Mapping[int, tuple[DataFrame, Sequence]], label: str, weight: str | None) -> DataFrame:
    """``(model, positions, y, n)``: the weighted patterns of every model's training rows."""
    n = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = [with_positions(df, vocab, "positions").select(F.lit(m).alias("model"), "positions", F.col(label).cast("double").alias("y"), n.alias("n"))
             .groupBy("model", "positions", "y").agg(F.sum("n").alias("n")) for m, (df, vocab) in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Sums:
    """What one aggregate tells about a model at given parameters (the intercept first): the information matrix, the
    gradient of the unpenalised loss, the loss."""

    def __init__(self, d: int) -> None:
        self.matrix, self.gradient, self.loss = np.zeros((d + 1, d + 1)), np.zeros(d + 1), 0.0


def sums_at(rows: DataFrame, params: Mapping[int, np.ndarray]) -> dict[int, Sums]:
    """One aggregate over pairs of active dummies (and the intercept, place 0) for all models in ``params``."""
    eta = None
    for m, b in params.items():
        e = linear(F.col("positions"), b[0], b[1:])
        eta = F.when(F.col("model") == m, e) if eta is None else eta.when(F.col("model") == m, e)
    p, y, n, eta_ = F.col("p"), F.col("y"), F.col("n"), F.col("eta")
    x = rows.where(F.col("model").isin(list(params))).withColumn("eta", eta).withColumn("p", probability(eta_))
    x = x.select("model", F.concat(F.array(F.lit(0)), F.transform("positions", lambda i: i + 1)).alias("at"), (n * p * (1 - p)).alias("v"), (n * (p - y)).alias("r"),
                 (n * (F.log1p(F.exp(-F.abs(eta_))) + F.greatest(eta_, F.lit(0.0)) - y * eta_)).alias("loss"))
    pairs = F.flatten(F.transform("at", lambda i: F.transform(F.filter("at", lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    cells = x.select("model", F.explode(pairs).alias("c"), "v", "r", "loss").groupBy("model", "c.i", "c.j").agg(
        F.sum("v").alias("v"), F.sum("r").alias("r"), F.sum("loss").alias("loss"))
    out = {m: Sums(len(b) - 1) for m, b in params.items()}
    for c in cells.collect():
        s = out[c["model"]]
        s.matrix[c["i"], c["j"]] = s.matrix[c["j"], c["i"]] = c["v"]
        if c["i"] == c["j"]:
            s.gradient[c["i"]] = c["r"]
            s.loss = c["loss"] if c["i"] == 0 else s.loss
    return out


def fit_logits(models: Mapping[int, tuple[DataFrame, Sequence]], label: str = LABEL, C: float = 1.0, max_iter: int = 100,
               weight: str | None = None) -> dict[int, LogitFit]:
    """One ridge fit per ``model -> (training rows, vocabulary)``; their Newton steps share the aggregates."""
    rows = keep(positions_table(models, label, weight))
    about = {r["model"]: (r["n"], r["good"]) for r in rows.groupBy("model").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good")).collect()}
    if any(not about.get(m, (0,))[0] for m in models):
        raise ValueError("empty training frame")
    params = {m: np.zeros(len(vocab) + 1) for m, (_, vocab) in models.items()}
    at: dict[int, Sums] = {}
    large = [m for m, (_, vocab) in models.items() if len(vocab) > NEWTON_FEATURES]
    for m in large:
        params[m] = estimated(models[m][0], models[m][1], label, C, about[m][0], weight)
    # With one class alone the intercept is infinite and nothing is left to learn.
    one_class = {m for m, (n, good) in about.items() if good in (0, n)}
    for m in one_class:
        params[m][0] = math.inf if about[m][1] else -math.inf
        at[m] = Sums(len(params[m]) - 1)
    if large:
        at |= sums_at(rows, {m: params[m] for m in large if m not in one_class})
    last: dict[int, tuple[np.ndarray, float, np.ndarray]] = {}
    active = [m for m in models if m not in large and m not in one_class]
    for _ in range(max_iter):
        if not active:
            break
        found = sums_at(rows, {m: params[m] for m in active})
        for m in list(active):
            s, b = found[m], params[m]
            penalty = np.r_[0.0, np.full(len(b) - 1, 1 / C)]
            loss = s.loss + 0.5 * float((penalty * b * b).sum())
            if m in last and loss > last[m][1] + 1e-9 * max(1.0, abs(last[m][1])):  # went too far: half the step
                before, value, step = last[m]
                last[m] = before, value, step / 2
                params[m] = before + step / 2
                continue
            step = -np.linalg.solve(s.matrix + np.diag(penalty), s.gradient + penalty * b)
            last[m], at[m], params[m] = (b, loss, step), s, b + step
            if np.abs(step).max() < 1e-9:
                active.remove(m)
    rows.unpersist()
    return {m: LogitFit(vocab, params[m][1:], params[m][0], at[m].matrix[1:, 1:], about[m][0]) for m, (_, vocab) in models.items()}


def estimated(train: DataFrame, vocab, label: str, C: float, n: float, weight: str | None) -> np.ndarray:
    """The same optimum by the estimator, on sparse vectors, for designs too wide for a dense matrix per step."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = with_vector(train.withColumns({"_label": F.col(label).cast("double"), "_w": w}), vocab)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_w", regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=1e-10, maxIter=1000, family="binomial")
    model = lr.fit(x)
    return np.r_[model.intercept, model.coefficients.toArray()]


def fit_logit(train: DataFrame, vocab_list, label: str = LABEL, C: float = 1.0, weight: str | None = None) -> LogitFit:
    return fit_logits({0: (train, vocab_list)}, label, C, weight=weight)[0]


def wald_no_intercept(information: np.ndarray, coef: np.ndarray, names: Sequence[str]):
    """M2 as in the reference: F without intercept and penalty, sigma = sqrt(diag F^-1)."""
    dependent = dependent_columns(information, names)
    if dependent:
        raise ValueError(f"singular information matrix; collinear or empty dummies: {dependent}")
    sigma = np.sqrt(np.diagonal(np.linalg.inv(information)))
    z = coef / sigma
    p = np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in z])
    return sigma, z, p


def information_matrix(rows: DataFrame, vocab_list, weight: str) -> np.ndarray:
    """Sum of weight * x x^T over the rows: the weighted counts of dummies that are active together."""
    x = with_positions(rows, vocab_list, "_at")
    pairs = F.flatten(F.transform("_at", lambda i: F.transform("_at", lambda j: F.struct(i.alias("i"), j.alias("j")))))
    out = np.zeros((len(vocab_list), len(vocab_list)))
    for c in x.select(F.explode(pairs).alias("c"), F.col(weight).alias("v")).groupBy("c.i", "c.j").agg(F.sum("v").alias("v")).collect():
        out[c["i"], c["j"]] = c["v"]
    return out


def dependent_columns(fmat: np.ndarray, names: Sequence[str], tol: float = 1e-10) -> list[str]:
    """Names of the columns that a linear dependency involves: empty ones, and those with a
    share in a null direction of the matrix scaled to unit diagonal."""
    diag = np.diagonal(fmat)
    empty = [n for n, v in zip(names, diag) if v <= 0]
    keep_ = np.flatnonzero(diag > 0)
    if not len(keep_):
        return empty
    scale = 1 / np.sqrt(diag[keep_])
    scaled = fmat[np.ix_(keep_, keep_)] * scale[:, None] * scale[None, :]
    try:  # far from singular: no need of its eigenvectors
        if np.diagonal(np.linalg.cholesky(scaled)).min() > 1e-3:
            return empty
    except np.linalg.LinAlgError:
        pass
    values, vectors = np.linalg.eigh(scaled)
    share = np.abs(vectors[:, values < tol]).max(axis=1, initial=0.0)
    return empty + [names[i] for i, s in zip(keep_, share) if s > 1e-6]


# ------------------------------------------------------------------ forest ---
# Rows that a tree's resample draws on: patterns stand for their rows in lots of equal weight, so many in all.
BAG_ROWS = 20_000


def fit_forest(train: DataFrame, vocab_list, label: str = LABEL, num_trees: int = 100, seed: int = 42,
               max_depth: int = 30, weight: str | None = None, bag_rows: int = BAG_ROWS) -> RandomForestClassificationModel:
    """M6: 100 gini trees, sqrt features per split, bootstrap, fixed seed, fitted on weighted patterns.

    Trees see a row through its dummies only, so equal rows are one pattern with a weight, and the fit depends on the combinations of levels, not
    on the rows. A resample must still vary as one of rows does: the estimator draws each of its rows Poisson(1) times,
    so a pattern of ``w`` rows becomes lots of equal weight, one per row up to ``bag_rows`` lots in all. Below that the resample is the
    row bootstrap; beyond, every tree draws ``bag_rows`` lots that stand for all rows (an m-out-of-n bootstrap)."""
    ensure_checkpoint_dir(train.sparkSession)
    columns = list(dict.fromkeys(c for c, _, _ in vocab_list))
    n = F.lit(1) if weight is None else F.col(weight)
    pat = keep(train.groupBy(*columns, F.col(label).cast("double").alias("label")).agg(F.sum(n).cast("double").alias("w")))
    total = pat.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        raise ValueError("empty training frame")
    lots = F.greatest(F.lit(1), F.round(F.col("w") / F.lit(max(1.0, total / bag_rows))).cast("int"))
    rows = pat.orderBy(*columns, "label").withColumns({"_lots": lots}).withColumn("_lot", F.explode(F.sequence(F.lit(1), F.col("_lots"))))
    x = with_vector(rows.withColumn("w", F.col("w") / F.col("_lots")), vocab_list).select("_features", "label", "w")
    rf = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="w", numTrees=num_trees,
                                impurity="gini", featureSubsetStrategy="sqrt", maxDepth=max_depth,
                                minInstancesPerNode=1, bootstrap=True, subsamplingRate=1.0, seed=seed,
                                cacheNodeIds=True, checkpointInterval=10)
    # The fitted model carries a summary of the training frame and with it the session, which cannot be sent to the
    # executors once a frame was observed; a copy holds the trees alone.
    model = rf.fit(x).copy()
    pat.unpersist()
    return model


def forest_score(model, df: DataFrame, vocab_list, out: str = "score") -> DataFrame:
    x = with_vector(df, vocab_list)
    return model.transform(x).withColumn(out, vector_to_array("probability")[1]).drop(
        "_features", "rawPrediction", "probability", "prediction")


def importances(spark, model, vocab_list) -> DataFrame:
    """M7 + O3: (feature_name, importance, rank_no), importances summing to 1, largest first (the name breaks ties)."""
    imp = model.featureImportances.toArray()
    rows = sorted(((f, float(imp[i])) for i, (_, _, f) in enumerate(vocab_list)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows, 1)], "feature_name string, importance double, rank_no int")


# ------------------------------------------------------------------ kmeans ---
# Rows (chosen by a hash of their values) on which the starts are drawn; the steps themselves see all rows.
START_ROWS = 5000
# A step's partial sums are collected from the tasks directly up to this many, else summed by a shuffle first.
PARTIALS = 200_000


def column_scales(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Standard deviation of each column (1 for constants): what ``scale=True`` divides by (H8)."""
    r = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [r[f"s{i}"] or 1.0 for i in range(len(columns))]


def weighted_rows(df: DataFrame, columns: Sequence[str], scales: Sequence[float] | None = None) -> DataFrame:
    """``(x array<double>, w)``: the distinct feature rows and how often each occurs, as a written table. A panel's gap rows are one row."""
    cols = [F.col(c).cast("double") / F.lit(float(s)) for c, s in zip(columns, scales or [1.0] * len(columns))]
    x = df.select(F.array(*[F.coalesce(c, F.raise_error(F.lit("NULL in a cluster feature")).cast("double")) for c in cols]).alias("x"))
    return written(x.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w")))


def sse_one_cluster(df: DataFrame, columns: Sequence[str]) -> float:
    """Inertia of k = 1: sum over columns of n * var_pop."""
    aggs = [(F.var_pop(F.col(c).cast("double")) * F.count(c)).alias(f"v{i}") for i, c in enumerate(columns)]
    return float(sum(v or 0.0 for v in df.agg(*aggs).first()))


# Rows whose distances to all centres are held at a time.
CHUNK_ROWS = 1024


def nearest_of(x: np.ndarray, points: np.ndarray, cuts: Sequence[int]) -> np.ndarray:
    """``(centre, row)``: 1 where the centre is its start's nearest one to the row (ties: the first). Centres of one start lie between two cuts.

    One product gives all squared distances up to rounding; where that cannot tell the nearest from the second, the differences decide."""
    mid = points.mean(axis=0)
    xs, ps = x - mid, points - mid
    x2, p2 = (xs * xs).sum(axis=1), (ps * ps).sum(axis=1)
    far = p2[:, None] - 2 * (ps @ xs.T)
    # Sums of d products round by less than this; the shift adds some more.
    tol = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (x2 + p2.max() + (x * x).sum(axis=1) + (mid * mid).sum())
    own = np.empty(far.shape)
    for lo, hi in zip(cuts, cuts[1:]):
        own[lo:hi] = far[lo:hi] <= far[lo:hi].min(axis=0) + tol
        close = np.flatnonzero(own[lo:hi].sum(axis=0) != 1)
        if len(close):
            exact = np.stack([((x[close] - p) ** 2).sum(axis=1) for p in points[lo:hi]])
            own[lo:hi, close] = exact.argmin(axis=0) == np.arange(hi - lo)[:, None]
    return own


def step_sums(rows: DataFrame, centres: Mapping[int, np.ndarray], distances: bool = True) -> dict[int, np.ndarray]:
    """One scan for all starts: per start and centre the sum of its rows, their weight and, if asked for, their squared distances ``(k, d + 2)``."""
    d = next(iter(centres.values())).shape[1]
    points = np.concatenate(list(centres.values()))
    cuts = np.cumsum([0, *map(len, centres.values())])

    def run(batches):
        total = np.zeros((len(points), d + 2))
        for batch in batches:
            whole, weights = batch.column(0).flatten().to_numpy().reshape(-1, d), batch.column(1).to_numpy()
            for at in range(0, len(whole), CHUNK_ROWS):
                x, w = whole[at:at + CHUNK_ROWS], weights[at:at + CHUNK_ROWS]
                own = nearest_of(x, points, cuts)
                total[:, :d + 1] += own @ np.c_[x * w[:, None], w]
                if distances:
                    for lo, hi in zip(cuts, cuts[1:]):
                        near = lo + own[lo:hi].argmax(axis=0)
                        total[:, d + 1] += np.bincount(near, ((x - points[near]) ** 2).sum(axis=1) * w, len(points))
        at = [(s, i) for s, c in centres.items() for i in range(len(c))]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()),
                                          pa.array(total.tolist(), pa.list_(pa.float64()))], ["s", "i", "v"])

    parts = rows.select("x", "w").mapInArrow(run, "s int, i int, v array<double>")
    if rows.rdd.getNumPartitions() * len(points) > PARTIALS:
        parts = parts.groupBy("s", "i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(d + 2)]).alias("v"))
    out = {s: np.zeros((len(c), d + 2)) for s, c in centres.items()}
    for r in parts.collect():
        out[r["s"]][r["i"]] += r["v"]
    return out


def plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ draws on the start rows, each carried to rest there, so that few steps are left for the full scans."""
    c = x[[rng.choice(len(x), p=w / w.sum())]]
    for _ in range(k - 1):
        far = np.min([((x - p) ** 2).sum(axis=1) for p in c], axis=0) * w
        c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum() if far.sum() > 0 else w / w.sum())]])
    for _ in range(100):
        near = np.argmin([((x - p) ** 2).sum(axis=1) for p in c], axis=0)
        new = np.array([np.average(x[near == i], axis=0, weights=w[near == i]) if (near == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c, rtol=1e-12, atol=0):
            break
        c = new
    return c


def lloyd(rows: DataFrame, ks: Sequence[int], restarts: int, seed: int, max_iter: int, rel_tol: float) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """``(k, start) -> (inertia, centres)``. As in the reference a start rests once its centres' squared shifts sum up to at most ``rel_tol``
    times the mean variance of the features; an empty cluster keeps its centre."""
    some = rows.orderBy(F.xxhash64("x"), "x").limit(START_ROWS).collect()
    if not some:
        return {}
    x, w = np.array([r["x"] for r in some]), np.array([r["w"] for r in some])
    starts = [(k, r) for k in ks for r in range(restarts)]
    # The overall mean and the spread around it, as the step of a single centre.
    whole = step_sums(rows, {0: np.zeros((1, x.shape[1]))})[0][0]
    mean = whole[:-2] / whole[-2]
    spread = step_sums(rows, {0: mean[None, :]})[0][0][-1] / whole[-2] / x.shape[1]
    centres = {i: plus_plus(x, w, min(k, len(x)), np.random.default_rng(seed + r)) for i, (k, r) in enumerate(starts)}
    active = dict(centres)
    for _ in range(max_iter):
        if not active:
            break
        for i, total in step_sums(rows, active, distances=False).items():
            new = np.where(total[:, -2:-1] > 0, total[:, :-2] / np.where(total[:, -2:-1] > 0, total[:, -2:-1], 1), active[i])
            shift = float(((new - active[i]) ** 2).sum())
            active[i] = centres[i] = new
            if shift <= rel_tol * spread:
                del active[i]
    final = step_sums(rows, centres)
    return {at: (float(final[i][:, -1].sum()), centres[i]) for i, at in enumerate(starts)}


def kmeans_elbow(df: DataFrame, columns: Sequence[str], ks=range(1, 11), restarts: int = 10,
                 max_iter: int = 300, seed: int = 0, scale: bool = False, rel_tol: float = 1e-4) -> list[tuple[int, float]]:
    """M8: best inertia over ``restarts`` starts for each k (unscaled features unless ``scale``)."""
    rows = weighted_rows(df, columns, column_scales(df, columns) if scale else None)
    found = lloyd(rows, [k for k in ks if k > 1], restarts, seed, max_iter, rel_tol)
    found |= lloyd(rows, [1], 1, seed, max_iter, 0.0) if 1 in ks else {}
    return [(k, min(cost for (at, _), (cost, _) in found.items() if at == k)) for k in sorted({k for k, _ in found})]


def fit_kmeans(df: DataFrame, columns: Sequence[str], k: int = 3, restarts: int = 10, seed: int = 0,
               max_iter: int = 300, scales: Sequence[float] | None = None, rel_tol: float = 1e-4) -> np.ndarray:
    """Centres of the best of ``restarts`` starts, ordered by norm: neither the seeds nor the
    partitioning of the input decide which solution is returned or how it is numbered."""
    found = lloyd(weighted_rows(df, columns, scales), [k], restarts, seed, max_iter, rel_tol)
    if not found:
        return np.zeros((0, len(columns)))
    best = min((round(cost, 6), at) for at, (cost, _) in found.items())[1]
    points = found[best][1] * np.array(scales or 1.0)
    return np.array(sorted(points, key=lambda c: (float(np.linalg.norm(c)), tuple(c))))


def nearest_centre(columns: Sequence[str], centres: np.ndarray, scales: Sequence[float] | None = None):
    """Number of the nearest centre (ties: the smaller number), as a row-local expression."""
    if len(centres) < 2:
        return F.lit(0)
    by = scales or [1.0] * len(columns)
    far = [F.struct(sum((F.pow((F.col(c).cast("double") - F.lit(float(v))) / F.lit(float(s)), F.lit(2)) for c, v, s in zip(columns, centre, by)), F.lit(0.0)).alias("d"),
                    F.lit(i).alias("i")) for i, centre in enumerate(centres)]
    return F.least(*far)["i"]


def kmeans_assign(df: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 0, max_iter: int = 300,
                  out: str = "cluster", restarts: int = 10, scale: bool = False, rel_tol: float = 1e-4) -> DataFrame:
    """M9: k-means labels, numbered by centre norm."""
    scales = column_scales(df, columns) if scale else None
    return df.withColumn(out, nearest_centre(columns, fit_kmeans(df, columns, k, restarts, seed, max_iter, scales, rel_tol), scales))
