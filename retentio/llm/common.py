"""Helpers the operators of this subpackage share: table access, written intermediates, text rules."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.session import ensure_checkpoint_dir, set_for_query

# White space of every text contract here: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows without an id sort after every other id.
LAST_ID = 2**63 - 1

# Rows of one Arrow batch sent to Python. Texts are long, so batches are short.
ARROW_ROWS = 1000

# A side is broadcast only when counting it gave at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor re-reads the shared table instead of
    replaying the plan, and columnar files are smaller than a row checkpoint.
    What the driver's Python has freed before goes back to the system first.
    """
    give_back()
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/retentio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Short Arrow batches for the frames of this query; the next query's start puts the setting back."""
    set_for_query(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_HELD: dict[str, Callable[[], object]] = {}


def only(operator: str, drop: Callable[[], object]) -> None:
    """Called where a Python task starts: Spark reuses its workers, so what other operators remember in this one goes
    (``drop`` forgets this operator's tables), and a worker never holds more than one operator's."""
    for other in [k for k in _HELD if k != operator]:
        _HELD.pop(other)()
    _HELD[operator] = drop
    give_back()


def give_back() -> None:
    """What this Python process (a worker, or the driver's) has freed goes back to the system, for the JVM beside it: else
    Arrow's pool and the C library keep it (the latter knows ``malloc_trim`` with glibc only)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one took goes back before the next is read, and before a worker waits for its next task."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on ASCII text, at a fraction of the cost."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _th, _text)``: the id with nulls last, and a hash that tells
    rows with the same id but different texts apart. Only these columns go on,
    so extra columns, whatever their names, never clash."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_th"),
        F.col(text_col).alias("_text"),
    )


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _th, _row)``: the keys of :func:`keyed` beside the whole row as one struct."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )


def real_id(c: str = "_id") -> Column:
    return F.when(F.col(c) != LAST_ID, F.col(c))


def joined_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a written table: broadcast if it was counted small, else by shuffle."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


# Slices of the hash space whose row counts tell where one key is too frequent for a task.
HASH_SLICES = 65_536


def crowded_slices(rows: DataFrame, key: str) -> list[int]:
    """Slices of the hash ``key`` that hold more rows than half an even share of a task; there are
    at most twice as many of them as partitions."""
    counts = saved(rows.groupBy(F.pmod(key, F.lit(HASH_SLICES)).alias("s")).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    share = 2 * partitions(rows.sparkSession)
    return [r.s for r in counts.where(F.col("n") * share > F.lit(total)).select("s").collect()]


def with_span(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``first_id`` and ``last_id``, the smallest and largest ``_id`` of the row's key. ``rows`` is a written
    table; ``keys`` are 64-bit hashes.

    The hashes are range-partitioned and sorted by document, and a window streams over each key.
    Keys in a slice too crowded for one task (held by a third of the corpus, say) are
    pre-aggregated instead and joined back; both sides of that join are tables, so adaptive execution splits it.
    Keys in crowded slices that only one document holds drop out there."""
    crowded = F.pmod(keys[0], F.lit(HASH_SLICES)).isin(crowded_slices(rows, keys[0]))
    stream = Window.partitionBy(*keys).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = (rows.where(~crowded).repartitionByRange(partitions(rows.sparkSession), *keys)
              .withColumns({"first_id": F.first("_id").over(stream), "last_id": F.last("_id").over(stream)}))
    hot = rows.where(crowded)
    spans = saved(hot.groupBy(*keys).agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id")).where("first_id < last_id"))
    return spread.unionByName(hot.join(spans, keys).select(*spread.columns))
