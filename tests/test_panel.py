"""Panel operators on hand-made frames (gap_week, attrs_change, invariants)."""

import datetime as dt

from pyspark.sql import functions as F

from retentio.operators import panel as P

D = dt.date


def obs(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, period date, attr string, m double, not_churn int")


def fills():
    return {"m": 0.0, "not_churn": 0}


def test_densify_fills_gaps_from_first_period(spark):
    df = obs(spark, [(1, D(2024, 1, 1), "a", 5.0, 1), (1, D(2024, 1, 4), "a", None, 1),
                     (2, D(2024, 1, 2), "b", 2.0, 0), (3, D(2024, 1, 3), "c", 1.0, 1)])
    pn = P.densify(df, fills())
    got = {(r.entity_id, str(r.period)): (r.attr, r.m, r.not_churn) for r in pn.collect()}
    # entity 1: 4 periods from its first; gap rows carry the attribute and get zeros
    assert got[(1, "2024-01-02")] == ("a", 0.0, 0)
    assert got[(1, "2024-01-04")] == ("a", 0.0, 1)   # observed NULL measure -> 0
    # entity 2 starts on day 2, entity 3 on day 3: rows = sum of #periods >= first
    assert len(got) == 4 + 3 + 2
    assert not any(k == (2, "2024-01-01") for k in got)


def test_densify_matches_grid_left_join(spark):
    df = obs(spark, [(e, D(2024, 1, d), "x", float(e * d), (e + d) % 2)
                     for e in range(1, 6) for d in range(1, 9) if (e * d) % 3 != 0])
    a = P.densify(df, fills()).select("entity_id", "period", "m", "not_churn", P.PERIOD_IDX)
    b = P.densify_on_grid(df, fills(), ["attr"]).select("entity_id", "period", "m", "not_churn", P.PERIOD_IDX)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_gap_week_inner_vs_filled_label(spark):
    # the whole calendar day 2024-01-03 is missing from the data
    df = obs(spark, [(1, D(2024, 1, 1), "a", 1.0, 1), (1, D(2024, 1, 2), "a", 1.0, 1),
                     (1, D(2024, 1, 4), "a", 1.0, 1), (1, D(2024, 1, 5), "a", 1.0, 0)])
    pn = P.densify(df, fills())
    assert pn.count() == 4                      # periods are the observed calendar, no 01-03 row
    inner = {str(r.period): r.y for r in P.offset_flag(pn, "not_churn", "y", +1, how="inner").collect()}
    filled = {str(r.period): r.y for r in P.drop_newest(P.offset_flag(pn, "not_churn", "y", +1)).collect()}
    assert "2024-01-02" not in inner            # next row is two days later: no label
    assert filled["2024-01-02"] == 0            # filled form: churn
    assert inner["2024-01-04"] == 0 and filled["2024-01-01"] == 1


def test_previous_flag_and_trailing_identity(spark):
    df = obs(spark, [(1, D(2024, 1, d), "a", float(d), d % 2) for d in range(1, 6)])
    pn = P.densify(df, fills())
    prev = {str(r.period): r.p for r in P.offset_flag(pn, "not_churn", "p", -1).collect()}
    assert prev["2024-01-01"] == 0 and prev["2024-01-03"] == 0 and prev["2024-01-02"] == 1
    same = P.trailing_mean(pn, ["m"], 1).select("period", "m").collect()
    assert sorted(r.m for r in same) == [1.0, 2.0, 3.0, 4.0, 5.0]
    two = {str(r.period): r.m for r in P.trailing_mean(pn, ["m"], 2).collect()}
    assert two["2024-01-01"] == 1.0 and two["2024-01-03"] == 2.5


def test_attrs_change_fanout_and_attr_keyed_join(spark):
    # entity 1 changes attribute on day 3
    df = obs(spark, [(1, D(2024, 1, 1), "a", 1.0, 1), (1, D(2024, 1, 2), "a", 2.0, 1),
                     (1, D(2024, 1, 3), "b", 3.0, 1)])
    fan = P.densify_on_grid(df, fills(), ["attr"])
    assert fan.count() == 6                      # one row per attribute tuple and period
    keyed = P.densify_on_grid(df, fills(), ["attr"], join_on_attrs=True)
    got = {(r.attr, str(r.period)): r.m for r in keyed.collect()}
    assert got[("a", "2024-01-03")] == 0.0       # observed under 'b': zero gap row for 'a'
    assert got[("b", "2024-01-03")] == 3.0
    assert got[("b", "2024-01-01")] == 0.0       # tuple 'b' starts at the entity's first period
    cols = ["entity_id", "period", "attr", "m", "not_churn", P.PERIOD_IDX]
    by_tuple = P.densify_by_tuple(df, fills(), ["attr"]).select(*cols)
    assert by_tuple.exceptAll(keyed.select(*cols)).count() == 0
    assert keyed.select(*cols).exceptAll(by_tuple).count() == 0


def test_densify_by_tuple_null_attrs_and_multiple_entities(spark):
    rows = [(1, D(2024, 1, 1), None, 1.0, 1), (1, D(2024, 1, 3), None, 2.0, 0), (1, D(2024, 1, 4), "x", 4.0, 1),
            (2, D(2024, 1, 2), "y", 5.0, 1), (3, D(2024, 1, 4), "z", 6.0, 1)]
    df = obs(spark, rows)
    cols = ["entity_id", "period", "attr", "m", "not_churn", P.PERIOD_IDX]
    a = P.densify_by_tuple(df, fills(), ["attr"]).select(*cols)
    b = P.densify_on_grid(df, fills(), ["attr"], join_on_attrs=True).select(*cols)
    assert a.count() == b.count() == 4 + 4 + 3 + 1
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_split_and_warmups(spark):
    df = obs(spark, [(e, D(2024, 1, d), "a", 1.0, 1) for e in (1, 2) for d in range(e, 6)])
    pn = P.densify(df, fills())
    s = P.split_oot(pn)
    assert {str(r.period) for r in s.where("is_test").collect()} == {"2024-01-05"}
    w1 = P.warmup_entity(pn, 0).where(F.col("entity_id") == 2).count()
    w2 = P.warmup_entity(pn, 1).where(F.col("entity_id") == 2).count()
    assert (w1, w2) == (3, 2)
    assert P.warmup_global(pn, 2).agg(F.min("period")).first()[0] == D(2024, 1, 3)


def test_many_periods_join_without_broadcast(spark, monkeypatch):
    """A period table counted above the broadcast bound gives the same panel by a shuffled join."""
    from retentio import session
    df = obs(spark, [(1, D(2024, 1, d), "a", 1.0, 1) for d in (1, 2, 5, 9)] + [(2, D(2024, 1, 5), "b", 2.0, 1)])
    fills = {"m": 0.0, "not_churn": 0} if "m" in df.columns else {"not_churn": 0}
    want = sorted(map(tuple, P.densify(df, fills).collect()))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, P.densify(df, fills).collect())) == want


def test_hot_entity_panel_matches_brute_force(spark):
    """One entity holds a third of all rows (and many duplicates per day before
    aggregation): the panel stays exact and per-entity bounded."""
    import random
    rnd = random.Random(1)
    raw = []
    for e in range(1, 11):
        days = sorted(rnd.sample(range(1, 21), 6))
        raw += [(e, D(2024, 1, d), float(rnd.randint(0, 9))) for d in days]
    hot_days = [d for d in range(1, 21) if d % 3 == 0]
    raw += [(99, D(2024, 1, d), 1.0) for d in hot_days for _ in range(len(raw) // len(hot_days) // 2 + 1)]
    ev = spark.createDataFrame(raw, "entity_id long, period date, v double")
    agg = ev.groupBy("entity_id", "period").agg(F.sum("v").alias("m"), F.lit(1).alias("not_churn"))
    pn = P.densify(agg, fills()).select("entity_id", "period", "m").collect()
    periods = sorted({r[1] for r in raw})
    firsts = {}
    for e, d, _ in raw:
        firsts[e] = min(firsts.get(e, d), d)
    sums = {}
    for e, d, v in raw:
        sums[(e, d)] = sums.get((e, d), 0.0) + v
    exp = {(e, d): sums.get((e, d), 0.0) for e in firsts for d in periods if d >= firsts[e]}
    assert {(r.entity_id, r.period): r.m for r in pn} == exp


def test_indexed_split_equals_generic_split(spark, sf_small):
    from retentio.plans import slices as S
    for lab, newest in ((S.labelled_daily(spark, sf_small), "labelled"),
                        (P.offset_flag(S.panel_1p(spark, sf_small), "not_churn", "y", +1, how="inner"), "paired")):
        a = P.split_oot_indexed(lab, newest).select("entity_id", "period", "is_test")
        b = P.split_oot(lab).select("entity_id", "period", "is_test")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_repeated_observation_fails(spark):
    import datetime as dt

    import pytest

    from retentio.operators import panel as P
    rows = [(1, dt.date(2024, 1, d), 1) for d in (1, 2, 2, 3)]
    obs = spark.createDataFrame(rows, "entity_id long, period date, not_churn int")
    with pytest.raises(Exception, match="repeated observation"):
        P.densify(obs, {"not_churn": 0}).collect()


def test_carried_sums_and_flags_are_those_of_the_windows(spark):
    """Means and flags taken on the observations are those that windows over the panel give, and the panel is not sorted for them."""
    import random
    rng = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(12) if i not in (4, 8)]
    rows = [(e, d, rng.choice([None, -0.0, 0.1 * rng.randrange(9)]), float(rng.randrange(5)), rng.choice([0, 1, None]))
            for e in [*range(30), None] for d in rng.sample(days, rng.randrange(1, 8))]
    obs = spark.createDataFrame(rows, "entity_id long, period date, a double, b double, flag int")
    filled = {"a": 0.0, "b": 0.0, "flag": 0}

    def features(pn, n, how):
        df = P.offset_flag(P.trailing_mean(pn, ["a", "b"], n, step=7), "flag", "y", +1, step=7, how=how)
        return P.drop_helpers(P.offset_flag(df, "flag", "before", -1, step=7))

    for n, how in ((2, "filled"), (3, "filled"), (3, "inner"), (1, "inner")):
        plain = features(P.densify(obs, filled, step=7), n, how)
        near = features(P.densify(obs, filled, step=7, trail=(["a", "b"], n), flags=["flag"]), n, how)
        assert near.columns == plain.columns and near.dtypes == plain.dtypes
        key = lambda r: tuple(map(repr, r))
        assert sorted(map(key, near.collect())) == sorted(map(key, plain.collect()))
        text = near._jdf.queryExecution().optimizedPlan().toString()
        assert text.index("Generate explode") < text.index("windowspecdefinition(entity_id")


def test_a_weekly_slice_sorts_observations_only(spark, sf_small):
    from retentio.plans import slices as S
    for name in ("weekly_slice_1p", "weekly_slice_2p", "weekly_slice_3p"):
        text = S.WEEKLY_SLICES[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert text.index("Generate explode") < text.index("windowspecdefinition(entity_id")
