"""Scans and sinks.

The reference reads one CSV with inferred types and coerces three columns to
timestamps; it writes a few dozen rows of weekly rates back to CSV. Here cells
are read as text under the header's names and typed by projections (no inference pass
over 100 TB, no binding by position), and the sink writes a handful of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written

# The input file's columns (text, whole numbers, measures).
TEXT_COLUMNS = ("week", "activated_date", "ftt_time", "vehicle_brand", "vehicle_model", "segment")
INTEGER_COLUMNS = {"driver_id": "long", "ops_city_id": "int", "device_type": "int", "not_churn": "int"}
MEASURES = (
    "sum_sh", "completed_trip", "total_dispatched_request", "Valid_dispatch",
    "accepted", "cancelled", "rider_cancel", "driver_cancel", "total_fare",
    "gmv_aftertax", "Trips_without_surge", "Trips_with_surge",
    "GB_without_surge", "Surge_Organic_GB", "Surge_Contri_GB", "total_ETA",
    "total_ATA", "trip_time_hour", "en_route_hour", "distance_travelled",
    "driver_trip_amount", "weekly_amount", "loyalty_amount")
ACTIVITY_COLUMNS = (*TEXT_COLUMNS, *INTEGER_COLUMNS, *MEASURES)

TIMESTAMP_COLUMNS = ("week", "activated_date", "ftt_time")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet); Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def coerce_timestamps(df: DataFrame, columns=TIMESTAMP_COLUMNS) -> DataFrame:
    """Turn text columns into timestamps; unparsable values become NULL."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in present})


def _text_rows(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, columns by the header's names; files whose header
    names or orders the columns differently from the first one are rejected."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [c for c in ACTIVITY_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing from the header of {path}: {missing}")
    return raw.select(*[F.col(f"`{c}`") for c in ACTIVITY_COLUMNS])


def _typed(c: str):
    """A cell as its column's type; whole numbers may be written as 1.0. NULL if it is none."""
    number = F.col(c).try_cast("double")
    if c in INTEGER_COLUMNS:
        return F.when(number == F.floor(number), F.coalesce(F.col(c).try_cast("long"), number.try_cast("long"))).cast(INTEGER_COLUMNS[c])
    return number if c in MEASURES else F.try_to_timestamp(F.col(c)) if c in TIMESTAMP_COLUMNS else F.col(c)


def read_activity_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S2: header CSV, columns resolved by name, numbers parsed, timestamps coerced."""
    return _text_rows(spark, path).select(*[_typed(c).alias(c) for c in ACTIVITY_COLUMNS])


class Audited(NamedTuple):
    """What one scan of a file gave: the accepted rows, the rejected ones (their cells as text and the names of the bad ones),
    the number of rows, and how many cells of each column its type cannot take."""

    rows: DataFrame
    rejects: DataFrame
    n_rows: int
    bad: dict[str, int]


def _is_bad(c: str):
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "") & _typed(c).isNull()


def read_audited_csv(spark: SparkSession, path: str) -> Audited:
    """S1 + S2 with rejects: a row with a cell that its column's type cannot take does not become zeros later, it is set aside.

    One scan: rows are typed and written to one table in two partitions (accepted, rejected) while ``observe`` counts rows and bad
    cells; what comes back reads its own partition only."""
    checked = [c for c in ACTIVITY_COLUMNS if c not in TEXT_COLUMNS or c in TIMESTAMP_COLUMNS]
    raw = _text_rows(spark, path)
    bad = F.filter(F.array(*[F.when(_is_bad(c), F.lit(c)) for c in checked]), lambda c: c.isNotNull())
    typed = raw.select(*[_typed(c).alias(c) for c in ACTIVITY_COLUMNS], bad.alias("bad_columns"), F.struct(*ACTIVITY_COLUMNS).alias("cells"))
    typed = typed.withColumn("rejected", F.size("bad_columns") > 0).withColumn("cells", F.when(F.col("rejected"), F.col("cells")))
    seen = Observation()
    counts = [F.count_if(F.array_contains("bad_columns", c)).alias(c) for c in checked]
    to = f"{ensure_checkpoint_dir(spark).rstrip('/')}/retentio-{uuid.uuid4().hex}"
    typed.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts).write.partitionBy("rejected").parquet(to)
    back = spark.read.schema(typed.schema).parquet(to)
    found = seen.get
    return Audited(back.where(~F.col("rejected")).select(*ACTIVITY_COLUMNS), back.where("rejected").select("cells.*", "bad_columns"),
                   found["n_rows"], {c: found[c] for c in checked if found[c]})


def bad_cells(spark: SparkSession, path: str) -> DataFrame:
    """(column, n_bad): cells of the file that hold text their column's type cannot take."""
    raw = _text_rows(spark, path)
    typed = [c for c in ACTIVITY_COLUMNS if c not in TEXT_COLUMNS or c in TIMESTAMP_COLUMNS]
    counts = raw.agg(*[F.count_if(_is_bad(c)).alias(c) for c in typed])
    return counts.unpivot([], typed, "column", "n_bad").where("n_bad > 0")


def write_small_csv(df: DataFrame, path: str) -> None:
    """S3: header CSV of a small report frame (weekly rates: one row per period).

    The frame is an aggregate keyed by period, so one output file is the
    reference's shape; ``coalesce(1)`` does not shuffle.
    """
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def ordered(df: DataFrame, order: Sequence, out: str = "rank_no") -> DataFrame:
    """O1: adds the row's place in the order, from 1, without gaps. The rows are range-partitioned and sorted where they land; a
    partition's first place is the number of rows before it, so no task sees more than its range. Ties need a tie-breaker in ``order``."""
    at, low = "_at", F.lit((1 << 33) - 1)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    firsts = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    first = F.get(F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>"), F.shiftright(at, 33).cast("int"))
    return dealt.select(*df.columns, (first + F.col(at).bitwiseAND(low) + 1).alias(out))


def write_ordered(df: DataFrame, path: str, order: Sequence, files: int = 1, rank: str | None = None) -> None:
    """O1 + S3: header CSV in the given order, within each file and from file to file (by name); with ``rank`` the place is a column too."""
    place = rank or "_place"
    out = ordered(df, order, place).repartitionByRange(files, place).sortWithinPartitions(place)
    (out if rank else out.drop(place)).write.mode("overwrite").option("header", True).csv(path)


def sql_over(spark: SparkSession, text: str, relations: Mapping[str, DataFrame], args: Mapping[str, object] | None = None) -> DataFrame:
    """SQL text over frames by name. The names are views while the text is resolved; ``:name`` markers take ``args``."""
    for name, df in relations.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=dict(args or {}))
    finally:
        for name in relations:
            spark.catalog.dropTempView(name)


def store_by_entity(df: DataFrame, entity: str = "entity_id", period: str = "period", buckets: int | None = None) -> DataFrame:
    """Store observations bucketed by entity and sorted by period, and give the stored table. Panels and windows per entity
    then need no exchange, and a look-up of one entity reads one bucket."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"retentio_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    (df.repartition(n, entity).write.format("parquet").option("path", path).bucketBy(n, entity).sortBy(entity, period).saveAsTable(name))
    return spark.table(name)


def register_views(spark: SparkSession, sf_dir: str, names) -> None:
    """Expose tables to ``spark.sql`` by name."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
