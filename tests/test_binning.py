"""Rule bins at their bounds, equal-width cuts against pandas.cut."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentio.functions.rules import COMPLETED_TRIP, DISTANCE_TRAVELLED, SEGMENT, TOTAL_ETA, TOTAL_FARE
from retentio.operators import binning as B


def labels(spark, rule, values):
    df = spark.createDataFrame([(float(v),) for v in values], f"{rule.source} double")
    return [r[0] for r in df.select(rule.expr()).collect()]


def test_rule_bounds_inclusive_and_strict(spark):
    assert labels(spark, COMPLETED_TRIP, [7, 7.0001, 14, 100, 100.5]) == ["0 - 7", "7 - 14", "7 - 14", "50 - 100", ">100"]
    assert labels(spark, TOTAL_FARE, [1e5, 1e5 + 1, 5e6, 5e6 + 1]) == ["< 100k", "100k - 1 mil", "1 - 5 mil", "> 5 mil"]
    assert labels(spark, TOTAL_ETA, [1, 60, 480, 481]) == ["< 1 min", "1 - 60 mins", "60 - 480 mins", "> 480"]
    # distance: first bound strict
    assert labels(spark, DISTANCE_TRAVELLED, [0.99, 1, 10, 1000, 1000.1]) == [
        "< 1 km", "1 - 10km", "1 - 10km", "100 - 1000km", "> 1000km"]
    # segment: all strict
    assert labels(spark, SEGMENT, [9.9, 10, 20, 40, 60]) == [
        "Part-time", "Low-medium", "Medium", "Full-time", "High Full-time"]


def pandas_bins(values, k):
    return pd.cut(pd.Series(values, dtype="float64"), k, labels=False).astype(int).to_numpy() + 1


def spark_bins(spark, values, k):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double")
    out = B.equal_width(df, "x", k, out="b").orderBy("i").select("b").collect()
    return np.array([r.b for r in out])


def test_equal_width_matches_pandas_cut(spark):
    rng = np.random.default_rng(7)
    for k in (3, 7, 19, 50):
        vals = np.round(rng.gamma(2.0, 300.0, 400), 2)
        assert (spark_bins(spark, vals, k) == pandas_bins(vals, k)).all()


def test_equal_width_constant_and_zero_column(spark):
    for c in (5.0, 0.0, -3.0):
        vals = [c] * 10
        assert (spark_bins(spark, vals, 4) == pandas_bins(vals, 4)).all()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=500), min_size=2, max_size=40),
       st.integers(min_value=3, max_value=19))
def test_equal_width_property(spark, xs, k):
    vals = [v / 4 for v in xs]
    assert (spark_bins(spark, vals, k) == pandas_bins(vals, k)).all()


def test_edges_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (5.0,)], "x double")
    got = {r.x: r.b for r in B.equal_width(df, "x", 4, out="b").collect()}
    assert got == {0.0: 1, 5.0: 2, 10.0: 4}     # width_bucket would put 5.0 in bin 3
    assert F is not None
