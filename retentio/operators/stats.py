"""Descriptive statistics and audits.

``describe`` gives pandas' count / mean / std / min / quartiles / max per
numeric column. Quartiles are exact and interpolate linearly between ranks ``floor(h)`` and
``floor(h) + 1`` with ``h = (n - 1) q``. They are found in three scans with small shuffles:
moments and approximate quantiles of all columns in one aggregate; the exact
number of rows between those bounds; and the values of the few stretches
that hold a needed rank. A stretch too long to list is cut again in the same way.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .binning import number, snapped

STAT_DIGITS = 9
# mean / std depend on the order of floating additions; kept to 6 decimals.
MOMENT_DIGITS = 6
QUARTILES = (0.25, 0.5, 0.75)
# Approximate quantiles that cut each column into stretches.
STRETCHES = 200
# Rows of a stretch that is listed value by value.
LISTED = 10_000


def null_audit(df: DataFrame) -> DataFrame:
    """Total NULL cells over all columns and the row count, one pass."""
    total = sum(F.count_if(F.col(c).isNull()) for c in df.columns)
    return df.agg(total.cast("bigint").alias("total_nulls"), F.count(F.lit(1)).alias("n_rows"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per value, in descending count order."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *cols)


def describe(df: DataFrame, columns: Iterable[str], qs: Sequence[float] = QUARTILES) -> DataFrame:
    """(measure, count, mean, std, min, p25, p50, p75, max) per column (long form)."""
    cols, spark = list(columns), df.sparkSession
    x = written(df.select(*[number(c).alias(c) for c in cols]))
    probs = [i / STRETCHES for i in range(1, STRETCHES)]
    one = x.agg(*[f.alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (
        ("n", F.count(c)), ("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("lo", F.min(c)), ("hi", F.max(c)),
        ("q", F.percentile_approx(c, probs, 10 * STRETCHES)))]).first()
    ends = {c: sorted({*one[f"q{i}"], one[f"lo{i}"], one[f"hi{i}"]}) for i, c in enumerate(cols) if one[f"n{i}"]}
    quantiles = exact_ranks(x, ends, {c: [(one[f"n{i}"] - 1) * q for q in qs] for i, c in enumerate(cols) if c in ends})
    rounded = lambda v, d: None if v is None or math.isnan(v) else round_half_up(v, d)
    rows = []
    for i, c in enumerate(cols):
        if c in ends:
            found = [rounded(v, STAT_DIGITS) for v in quantiles[c]]
            rows.append((c, one[f"n{i}"], rounded(one[f"mean{i}"], MOMENT_DIGITS), rounded(one[f"std{i}"], MOMENT_DIGITS),
                         one[f"lo{i}"], *found, one[f"hi{i}"]))
    names = [f"p{int(round(q * 100))}" for q in qs]
    schema = "measure string, count long, mean double, std double, min double, " + "".join(f"{n} double, " for n in names) + "max double"
    return spark.createDataFrame(rows, schema)


def round_half_up(v: float, digits: int) -> float:
    """SQL's ROUND of a double."""
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


class Cell:
    """Values of a column in ``(low, high]`` (no bound: None) and the ranks wanted of them, counted from the cell's first value."""

    def __init__(self, column: str, low: float | None, high: float | None, before: int, ranks: list[int]) -> None:
        self.column, self.low, self.high, self.before, self.ranks = column, low, high, before, ranks

    def of(self, c: Column) -> Column:
        inside = c.isNotNull()
        inside = inside if self.low is None else inside & (c > F.lit(self.low))
        return F.when(inside if self.high is None else inside & (c <= F.lit(self.high)), c)


def cut_points(values: Iterable[float]) -> list[float]:
    """The values and the doubles just below them: a value that many rows share gets a stretch of its own."""
    return sorted({e for v in values for e in (v, math.nextafter(v, -math.inf))})


def exact_ranks(x: DataFrame, ends: dict[str, list[float]], wanted: dict[str, list[float]]) -> dict[str, list[float]]:
    """The interpolated order statistics ``h`` (fractional ranks from 0) of each column.

    ``ends`` cut a column into right-closed stretches. Their exact row counts tell which stretch holds a rank. A stretch of one value
    tells it; one of at most ``LISTED`` rows is listed; a longer one is cut again by its own approximate quantiles, until none is left."""
    need = {c: sorted({r for h in hs for r in (math.floor(h), math.ceil(h))}) for c, hs in wanted.items()}
    found: dict[tuple[str, int], float] = {}
    cells, cuts, short = [Cell(c, None, None, 0, need[c]) for c in ends], [cut_points(ends[c]) for c in ends], []
    while cells:
        parts = [F.struct(snapped(cell.of(F.col(cell.column)), edges).alias("stop"), cell.of(F.col(cell.column)).alias("x")).alias(f"c{i}")
                 for i, (cell, edges) in enumerate(zip(cells, cuts))]
        counted = x.select(*parts).unpivot([], [f"c{i}" for i in range(len(cells))], "cell", "v").where("v.x IS NOT NULL")
        stretches: dict[int, list] = {}
        for r in counted.groupBy("cell", "v.stop").agg(F.count("*").alias("n"), F.min("v.x").alias("lo"), F.max("v.x").alias("hi")).collect():
            stretches.setdefault(int(r["cell"][1:]), []).append((r["stop"], r["n"], r["lo"], r["hi"]))
        longer = []
        for i, cell in enumerate(cells):
            before, low = cell.before, cell.low
            for stop, n, lo, hi in sorted(stretches.get(i, [])):
                ranks = [r for r in cell.ranks if before <= r < before + n]
                if lo == hi:
                    found.update({(cell.column, r): lo for r in ranks})
                elif ranks:
                    (short if n <= LISTED else longer).append(Cell(cell.column, low, stop, before, ranks))
                before, low = before + n, stop
        cells, cuts = longer, []
        if cells:
            probs = [i / STRETCHES for i in range(1, STRETCHES)]
            own = [cell.of(F.col(cell.column)) for cell in cells]
            again = x.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(own) for n, f in (
                ("q", lambda c: F.percentile_approx(c, probs, 10 * STRETCHES)), ("lo", F.min), ("hi", F.max))]).first()
            cuts = [cut_points([*again[f"q{i}"], again[f"lo{i}"], (again[f"lo{i}"] + again[f"hi{i}"]) / 2, again[f"hi{i}"]]) for i in range(len(cells))]
    if short:
        listed = x.select(*[cell.of(F.col(cell.column)).alias(f"c{i}") for i, cell in enumerate(short)]).unpivot([], [f"c{i}" for i in range(len(short))], "cell", "x")
        values: dict[int, list] = {}
        for r in listed.where("x IS NOT NULL").groupBy("cell", "x").agg(F.count("*").alias("n")).collect():
            values.setdefault(int(r["cell"][1:]), []).append((r["x"], r["n"]))
        for i, cell in enumerate(short):
            rows = sorted(values[i])
            upto = [cell.before + n for n in accumulate(n for _, n in rows)]
            found.update({(cell.column, r): rows[bisect_right(upto, r)][0] for r in cell.ranks})
    return {c: [found[c, math.floor(h)] + (h - math.floor(h)) * (found[c, math.ceil(h)] - found[c, math.floor(h)]) for h in hs] for c, hs in wanted.items()}
