"""CSV source resolved by header name (S1/S2), small CSV sink (S3), views (S4), CSV to CSV end to end."""

import datetime as dt
import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from retentio.plans import slices as S
from retentio.plans import variants as VR
from retentio.sources.tables import (ACTIVITY_COLUMNS, MEASURES, bad_cells, ordered, read_activity_csv, read_audited_csv,
                                     register_views, sql_over, store_by_entity, write_ordered, write_small_csv)


def write_csv(rows: list[dict], columns=ACTIVITY_COLUMNS) -> str:
    d = tempfile.mkdtemp(prefix="retentio-csv-")
    with open(os.path.join(d, "driver.csv"), "w") as f:
        f.write(",".join(columns) + "\n")
        f.writelines(",".join(str(r.get(c, "")) for c in columns) + "\n" for r in rows)
    return d


def test_columns_are_found_by_name_whatever_their_order(spark):
    row = {"week": "2023-11-06", "driver_id": "342", "activated_date": "2021-05-01", "ftt_time": "2021-05-03 10:00:00",
           "ops_city_id": "7.0", "device_type": "1.0", "not_churn": "1.0", "vehicle_brand": "Toyota", "sum_sh": "22", "completed_trip": "11"}
    odd = {"week": "2023-11-13", "driver_id": "342.0", "activated_date": "not a date", "not_churn": "x", "sum_sh": "12 h", "ops_city_id": "1.5"}
    columns = list(ACTIVITY_COLUMNS)
    random.Random(1).shuffle(columns)
    path = write_csv([row, odd], [*columns, "unused"])
    a, b = read_activity_csv(spark, path).orderBy("week").collect()
    assert a.week == dt.datetime(2023, 11, 6) and a.ftt_time == dt.datetime(2021, 5, 3, 10)
    assert (a.driver_id, a.ops_city_id, a.device_type, a.not_churn, a.sum_sh, a.completed_trip) == (342, 7, 1, 1, 22.0, 11.0)
    assert a.vehicle_model is None and b.driver_id == 342 and b.not_churn is None and b.ops_city_id is None
    assert {r.column: r.n_bad for r in bad_cells(spark, path).collect()} == {"activated_date": 1, "not_churn": 1, "sum_sh": 1, "ops_city_id": 1}


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="total_ETA"):
        read_activity_csv(spark, write_csv([{}], [c for c in ACTIVITY_COLUMNS if c != "total_ETA"]))


def test_csv_to_csv(spark):
    """The reference's file in, its weekly rates out, through slice, fit and scores at a step of seven days."""
    rnd = random.Random(3)
    rows = []
    for driver in range(60):
        for week in range(8):
            if rnd.random() < 0.8:
                active = int(rnd.random() < 0.4 + 0.5 * (driver % 3 == 0))
                rows.append({"week": dt.date(2023, 11, 6) + dt.timedelta(7 * week), "driver_id": driver, "ops_city_id": f"{driver % 4}.0",
                             "device_type": 1, "vehicle_brand": "b", "segment": ["Full-time", "Part-time"][driver % 2], "not_churn": f"{active}.0",
                             **{m: rnd.choice(["", rnd.randint(0, 60)]) for m in MEASURES}})
    a = S.csv_activity(read_activity_csv(spark, write_csv(rows)))
    base = S.slice_of(a, S.SPECS["slice_1p"])
    assert base.where("completed_trip IS NULL OR segment IS NULL").count() == 0
    out = tempfile.mkdtemp(prefix="retentio-rates-")
    paths = VR.export_rates(a, out, "1p")
    for path in paths.values():
        got = spark.read.option("header", True).csv(path)
        assert got.columns == ["week", "churn_actual", "churn_predict"]
        lines = [line.split(",")[0] for f in sorted(glob.glob(path + "/*.csv")) for line in open(f).read().splitlines()[1:]]
        assert lines == sorted(lines) and len(lines) > 3
        active = base.where("not_churn = 1").groupBy("week").agg((100 * F.avg(1 - F.col("not_churn_1w"))).alias("churn"))
        want = {str(r.week): r.churn for r in active.collect()}
        assert {r.week: round(float(r.churn_actual or 0), 6) for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_small_csv_sink_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="retentio-sink-") + "/rates"
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 25.0, None)], "period date, churn_actual double, churn_predict double")
    write_small_csv(df, out)
    files = glob.glob(out + "/*.csv")
    assert len(files) == 1
    assert open(files[0]).read().splitlines()[0] == "period,churn_actual,churn_predict"


def test_views_by_name(spark, sf_small):
    register_views(spark, sf_small, ["nation", "region"])
    assert spark.sql("SELECT COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey").first().n > 0


def test_audited_scan_sets_bad_rows_aside(spark):
    good = {"week": "2023-11-06", "driver_id": "1", "sum_sh": "2.5", "ops_city_id": "3.0", "not_churn": "1"}
    rows = [good, {**good, "driver_id": "2", "sum_sh": "12 h"}, {**good, "driver_id": "3", "week": "soon", "sum_sh": "x"}, {**good, "driver_id": "4", "sum_sh": ""}]
    seen = read_audited_csv(spark, write_csv(rows))
    assert sorted(r.driver_id for r in seen.rows.collect()) == [1, 4] and seen.rows.columns == list(ACTIVITY_COLUMNS)
    assert seen.n_rows == 4 and seen.bad == {"week": 1, "sum_sh": 2}
    assert {(r.driver_id, r.sum_sh, tuple(sorted(r.bad_columns))) for r in seen.rejects.collect()} == {("2", "12 h", ("sum_sh",)), ("3", "x", ("sum_sh", "week"))}
    none = read_audited_csv(spark, write_csv([]))
    assert none.n_rows == 0 and none.rows.count() == none.rejects.count() == 0


def test_ordered_rows_have_gapless_places(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 1000).alias("a"), "id")
    got = ordered(df, [F.col("a").desc(), "id"]).collect()
    assert [r.rank_no for r in sorted(got, key=lambda r: (-r.a, r.id))] == list(range(1, 5001))
    assert ordered(df.limit(0), ["a"]).count() == 0


def test_files_are_written_in_order(spark):
    out = tempfile.mkdtemp(prefix="retentio-ordered-") + "/rows"
    write_ordered(spark.range(1000).select(F.xxhash64("id").alias("h")), out, ["h"], files=4, rank="rank_no")
    lines = [line.split(",") for f in sorted(glob.glob(out + "/*.csv")) for line in open(f).read().splitlines()[1:]]
    assert [int(r) for _, r in lines] == list(range(1, 1001)) and [int(h) for h, _ in lines] == sorted(int(h) for h, _ in lines)


def test_sql_text_over_frames(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, 5)], "id int, n int")
    got = sql_over(spark, "SELECT left_.id, v, COALESCE(n, :none) AS n FROM left_ LEFT JOIN right_ ON left_.id = right_.id", {"left_": a, "right_": b}, {"none": 0})
    assert {tuple(r) for r in got.collect()} == {(1, "x", 0), (2, "y", 5)}
    assert not spark.catalog.tableExists("left_")


def test_rows_stored_by_entity_need_no_exchange(spark, sf_small):
    from dataclasses import replace
    a = S.daily(spark, sf_small)
    stored = replace(a, rows=store_by_entity(a.rows, buckets=4))
    df = S.slice_of(stored, S.SPECS["slice_2p"])
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity_id" in plan(S.slice_of(a, S.SPECS["slice_2p"])) and "hashpartitioning(entity_id" not in plan(df)
    assert "SelectedBucketsCount: 1 out of 4" in plan(df.where("entity_id = 3"))
    assert df.exceptAll(S.slice_of(a, S.SPECS["slice_2p"])).count() == 0
