"""Scalar expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Digits kept on log-based statistics so that results do not depend on the
# order in which partial sums were added (same rounding in the SQL oracle).
LOG_DIGITS = 9


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE, NULL when the denominator is 0 (ANSI-safe)."""
    n, d = col_of(num).cast("double"), col_of(den).cast("double")
    return F.when(d != 0, n / d)


def ieee_log_ratio(num: Column | str, den: Column | str) -> Column:
    """ln(num/den) with IEEE limits: +inf when den = 0 < num, -inf when num = 0.

    Spark's ANSI mode raises on x/0 and returns NULL for ln(0); the reference
    relies on numpy's inf/-inf, so the limits are spelled out.
    """
    n, d = col_of(num).cast("double"), col_of(den).cast("double")
    return (F.when((n > 0) & (d > 0), F.round(F.log(n / d), LOG_DIGITS))
            .when((n > 0) & (d == 0), F.lit(float("inf")))
            .when((n == 0) & (d > 0), F.lit(float("-inf"))))


def strict_threshold(score: Column | str, threshold: Column | float) -> Column:
    """1 when score > threshold else 0 (strict, as the reference)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(col_of(score) > t, F.lit(1)).otherwise(F.lit(0))


def linspace_thresholds(n: int = 11) -> list[float]:
    """The reference's sweep ``linspace(0, 1, 11)``: i * 0.1 for i < n-1, then 1.0.

    numpy computes ``arange(n) * step + start`` and forces the last value to
    ``stop``; 0.30000000000000004 etc. are kept on purpose.
    """
    step = 1.0 / (n - 1)
    vals = [i * step + 0.0 for i in range(n)]
    vals[-1] = 1.0
    return vals


def period_ordinal(dtype: T.DataType, c: Column) -> Column:
    """Numeric position of a period value: days since epoch for dates and
    timestamps, the value itself for integer period numbers."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(c.cast("date"))
    return c.cast("long")
