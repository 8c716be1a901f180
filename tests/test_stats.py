"""Exact quartiles: refinement of long stretches, ties, bounded listing and job count."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import stats as ST


def force(values):
    v = np.array([x for x in values if x is not None and x == x], float)
    return [float(np.quantile(v, q)) for q in ST.QUARTILES]


@pytest.mark.parametrize("listed", [10_000, 3])
def test_quartiles_equal_numpy_however_often_a_stretch_is_cut(spark, monkeypatch, listed):
    monkeypatch.setattr(ST, "LISTED", listed)
    monkeypatch.setattr(ST, "STRETCHES", 4)
    rng = np.random.default_rng(7)
    cols = {"normal": rng.normal(size=700).tolist(), "mostly_one": [1.0] * 500 + rng.random(200).tolist(), "two": [0.0] * 350 + [5.0] * 350,
            "constant": [2.5] * 700, "tiny": (rng.random(700) * 1e-300).tolist(), "holes": [None, float("nan")] * 300 + rng.integers(0, 9, 100).tolist()}
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in cols.values()]))
    got = {r.measure: r for r in ST.describe(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), list(cols)).collect()}
    for c, values in cols.items():
        assert [got[c].p25, got[c].p50, got[c].p75] == pytest.approx([round(v, 9) for v in force(values)], abs=2e-9)
    assert got["holes"]["count"] == 100


def test_many_distinct_values_in_few_jobs_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(ST, "LISTED", 2000)
    n = 1_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) / 3).alias("x"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    r = ST.describe(df, ["x"]).collect()[0]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert [r.p25, r.p50, r.p75] == pytest.approx([(n - 1) * q / 3 for q in ST.QUARTILES], abs=1e-6)
    assert r["count"] == n and jobs <= 14
