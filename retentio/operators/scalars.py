"""Attach one-row aggregates as scalar subqueries (no cross join).

A global figure (newest period, value range, totals) is computed once as an
uncorrelated scalar subquery and inlined into the projection; its size is one
row by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Columns of ``one_row`` on every row of ``df``.

    With ``keys`` the small side is keyed (one row per key) and joined as a
    broadcast; without keys it must hold exactly one row and becomes a scalar
    subquery.
    """
    keys = list(keys)
    if keys:
        return df.join(F.broadcast(one_row), keys)
    cols = one_row.columns
    s = one_row.select(F.struct(*cols).alias("_s")).scalar()
    return df.withColumn("_s", s).withColumns({c: F.col("_s").getField(c) for c in cols}).drop("_s")
