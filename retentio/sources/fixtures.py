"""Activity sources with the reference's input shape, derived from the driver
tables (see FIXTURES.md). Each is one partial-aggregated ``groupBy`` over a
pruned scan, so a hot user or customer is collapsed map-side before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import SEGMENT
from .tables import MEASURES, read_table

ENTITY = "entity_id"
PERIOD = "period"
PERIOD_NO = "period_no"

DAILY_ATTRS = ["ops_city_id", "device_type", "vehicle_brand", "vehicle_model"]
DAILY_MEASURES = ["sum_sh", "completed_trip", "total_dispatched_request", "accepted",
                  "cancelled", "total_fare", "total_ETA", "distance_travelled"]
QUARTERLY_ATTRS = ["c_nationkey", "c_mktsegment"]
QUARTERLY_MEASURES = ["n_orders", "total_price", "n_urgent", "n_high", "n_medium",
                      "n_not_specified", "n_low"]

# The reference's 23 measures, in its order.
WEEKLY_MEASURES = list(MEASURES)

# Fixed values of the fixture: event types counted as activity.
ACTIVE_EVENTS = ("click", "view", "purchase")


def _money(c: Column) -> Column:
    # DECIMAL(18,2) sums are exact, so the order of addition cannot change the result.
    return c.cast("decimal(18,2)")


def activity_daily(spark: SparkSession, sf_dir: str, with_segment: bool = True) -> DataFrame:
    """One row per (user, day) with activity: the reference's driver x week rows.

    Measures with no contributing event stay NULL (the reference's input has
    NULL measures that the zero fill removes). ``segment`` is the B5 rule on the
    observed ``sum_sh`` (the reference's source column; gap rows get the fill).
    """
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    et, v = F.col("event_type"), _money(F.col("value"))
    agg = ev.groupBy(F.col("user_id").alias(ENTITY), F.col("ts").cast("date").alias(PERIOD)).agg(
        # distinct hours of the day: a set of at most 24 values per group
        F.size(F.collect_set(F.hour("ts"))).alias("n_hours"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(et == "view").alias("n_view"),
        F.count_if(et == "purchase").alias("n_purchase"),
        F.count_if(et == "click").alias("n_click"),
        F.count_if(et == "error").alias("n_error"),
        F.sum(v).alias("fare"),
        F.sum(F.when(et.isin("error", "signup"), v)).alias("eta"),
        F.sum(F.when(et == "click", v)).alias("dist"),
        F.max(F.when(et.isin(*ACTIVE_EVENTS), 1).otherwise(0)).alias("not_churn"),
    )
    uid = F.col(ENTITY)
    out = agg.select(
        ENTITY, PERIOD,
        (uid % 5).cast("int").alias("ops_city_id"),
        (uid % 2).cast("int").alias("device_type"),
        F.concat(F.lit("brand_"), (uid % 3).cast("string")).alias("vehicle_brand"),
        F.when(uid % 4 != 0, F.concat(F.lit("model_"), (uid % 7).cast("string"))).alias("vehicle_model"),
        (F.col("n_hours") * 10).cast("double").alias("sum_sh"),
        (F.col("n_view") * 6 + F.col("n_purchase") * 22).cast("double").alias("completed_trip"),
        F.col("n_events").cast("double").alias("total_dispatched_request"),
        F.col("n_click").cast("double").alias("accepted"),
        F.col("n_error").cast("double").alias("cancelled"),
        (F.col("fare") * 10000).cast("double").alias("total_fare"),
        (F.col("eta") * 3).cast("double").alias("total_ETA"),
        (F.col("dist") * 3).cast("double").alias("distance_travelled"),
        F.col("not_churn").cast("int").alias("not_churn"),
    )
    if with_segment:
        out = out.withColumn("segment", SEGMENT.expr("sum_sh"))
    return out


def daily_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct days with any event: the periods of ``activity_daily``, read from
    the single pruned ``ts`` column (partial distinct, tiny shuffle)."""
    ev = read_table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias(PERIOD))
    return ev.where(F.col(PERIOD).isNotNull()).distinct()


def activity_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, quarter with orders); quarters numbered from 1995-Q1.

    A sparse panel: most customers order in few quarters, so densifying adds
    many gap rows. The customer attributes are joined after the aggregation
    (one row per customer and quarter), and the join strategy is left to AQE:
    ``customer`` grows with the data, so it is not hinted for broadcast.
    """
    od = F.col("o_orderdate")
    pr = F.col("o_orderpriority")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    agg = orders.groupBy(
        F.col("o_custkey").alias(ENTITY),
        ((F.year(od) - 1995) * 4 + F.quarter(od) - 1).cast("int").alias(PERIOD_NO),
    ).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(_money(F.col("o_totalprice"))).alias("price"),
        F.count_if(pr == "1-URGENT").alias("n_urgent"),
        F.count_if(pr == "2-HIGH").alias("n_high"),
        F.count_if(pr == "3-MEDIUM").alias("n_medium"),
        F.count_if(pr == "4-NOT SPECIFIED").alias("n_not_specified"),
        F.count_if(pr == "5-LOW").alias("n_low"),
        F.max(F.when(F.col("o_orderstatus") != "F", 1).otherwise(0)).alias("not_churn"),
    )
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(ENTITY), "c_nationkey", "c_mktsegment")
    return agg.join(cust, ENTITY, "left").select(
        ENTITY, PERIOD_NO, "c_nationkey", "c_mktsegment",
        F.col("n_orders").cast("double").alias("n_orders"),
        F.col("price").cast("double").alias("total_price"),
        *[F.col(c).cast("double").alias(c) for c in
          ("n_urgent", "n_high", "n_medium", "n_not_specified", "n_low")],
        F.col("not_churn").cast("int").alias("not_churn"),
    )


def activity_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, week with orders) with the reference's 23 measures (step = 7 days).

    Weeks start on Monday. Most customers order in few weeks, so the panel is sparse; attributes change
    with the customer only, and money columns of weeks without a matching order stay NULL.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    price, status, pr = _money(F.col("o_totalprice")), F.col("o_orderstatus"), F.col("o_orderpriority")
    n = F.count(F.lit(1))
    urgent, high = pr == "1-URGENT", pr == "2-HIGH"
    agg = o.groupBy(F.col("o_custkey").alias(ENTITY), F.trunc("o_orderdate", "week").alias(PERIOD)).agg(
        n.alias("n"), F.count_if(status == "F").alias("n_f"), F.count_if(status == "O").alias("n_o"), F.count_if(status == "P").alias("n_p"),
        F.count_if(urgent).alias("n_urgent"), F.count_if(high).alias("n_high"), F.count_if(pr == "5-LOW").alias("n_low"),
        F.sum(price).alias("p"), F.max(price).alias("p_max"), F.min(price).alias("p_min"),
        F.sum(F.when(status == "F", price)).alias("p_f"), F.sum(F.when(status == "O", price)).alias("p_o"),
        F.sum(F.when(urgent, price)).alias("p_urgent"), F.sum(F.when(high, price)).alias("p_high"))
    uid, c = ENTITY, F.col
    measures = {
        "sum_sh": c("n") * 15, "completed_trip": c("n") * 9 + c("n_f") * 30, "total_dispatched_request": c("n") + c("n_urgent"),
        "Valid_dispatch": c("n"), "accepted": c("n_f") + c("n_o"), "cancelled": c("n_p"), "rider_cancel": c("n_low"), "driver_cancel": c("n_high"),
        "total_fare": c("p"), "gmv_aftertax": c("p_f"), "Trips_without_surge": c("n") - c("n_urgent"), "Trips_with_surge": c("n_urgent"),
        "GB_without_surge": c("p_o"), "Surge_Organic_GB": c("p_urgent"), "Surge_Contri_GB": c("p_high"), "total_ETA": c("n_o") * 2,
        "total_ATA": c("n_f") * 3, "trip_time_hour": c("n") * 2 + c("n_low"), "en_route_hour": c("n_low"), "distance_travelled": c("n") * 70,
        "driver_trip_amount": c("p_max"), "weekly_amount": c("p") - c("p_min"), "loyalty_amount": c("p_min"),
    }
    return agg.select(
        ENTITY, PERIOD, (c(uid) % 5).cast("int").alias("ops_city_id"), (c(uid) % 2).cast("int").alias("device_type"),
        F.concat(F.lit("brand_"), (c(uid) % 3).cast("string")).alias("vehicle_brand"),
        F.when(c(uid) % 4 != 0, F.concat(F.lit("model_"), (c(uid) % 7).cast("string"))).alias("vehicle_model"),
        *[measures[m].cast("double").alias(m) for m in WEEKLY_MEASURES],
        F.when(c("n_o") > 0, 1).otherwise(0).cast("int").alias("not_churn"),
        F.when(c("n") > 1, SEGMENT.expr(c("n") * 15)).alias("segment"))
