"""Distributed running sums over a global order.

The reference sorts every row and takes ``cumsum``. A window ordered over the
whole frame would run in a single task, so running sums are computed in two
levels instead:

1. the input is first reduced to one row per distinct order value (callers pass
   a histogram, e.g. ``(split, score, n_pos, n_neg)``);
2. approximate quantiles of the order value cut it into ``n_buckets`` ranges
   per group key (a bounded aggregate);
3. bucket totals -> exclusive prefix offsets over at most ``n_buckets`` rows per
   key (tiny, broadcast);
4. a window partitioned by ``(keys, bucket)`` adds the local running sum to
   the bucket's offset.

No task ever holds more than one bucket; the result is exact (quantiles only
decide where buckets split, never what is summed). A frame counted at no more
than ``BROADCAST_ROWS`` rows skips the buckets: one window, same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS
from .scalars import attach


def running_sums(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
                 descending: bool = False, prefix: str = "cum_", n_buckets: int | None = None) -> DataFrame:
    """Add ``<prefix><col>`` = inclusive running sum of each col in ``order``.

    ``order`` must be unique within ``keys`` (one row per distinct value). The
    number of buckets follows the session's shuffle partitions.
    """
    if n_buckets is None:
        n_buckets = max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = list(keys)
    o = F.col(order) if not descending else -F.col(order)
    d = df.withColumn("_o", o.cast("double"))
    if df.count() <= BROADCAST_ROWS:  # the (persisted) histogram fits one task: same sums, a tenth of the jobs
        w = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumns({f"{prefix}{c}": F.sum(c).over(w) for c in cols}).drop("_o")
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qa = [F.percentile_approx("_o", probs, 10000).alias("_bounds")]
    bounds = d.groupBy(*keys).agg(*qa) if keys else d.agg(*qa)
    bounds = bounds.withColumn("_bounds", F.array_sort(F.array_distinct("_bounds")))
    d = attach(d, bounds, keys)
    d = d.withColumn("_b", F.size(F.filter("_bounds", lambda b: b < F.col("_o")))).drop("_bounds")
    btot = d.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = btot.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_off_{c}")
                                      for c in cols])
    d = d.join(F.broadcast(offs), [*keys, "_b"])
    wl = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"{prefix}{c}": F.col(f"_off_{c}") + F.sum(c).over(wl) for c in cols})
    return d.drop("_o", "_b", *[f"_off_{c}" for c in cols])
