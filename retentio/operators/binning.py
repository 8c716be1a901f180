"""Binning: rule bins (B1-B5) and equal-width cuts.

B6 reproduces ``pandas.cut(x, k)`` exactly: edges ``linspace(min, max, k+1)``
computed as ``min + i * ((max - min) / k)`` with the last edge forced to
``max``; the lowest edge lowered by 0.1 % of the range; a constant column is
widened by 0.1 % of its value on both sides first. Bins are right-closed, so
``bin = #{edges < x}``. ``width_bucket`` is left-closed and is not used.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES, RuleBins


def apply_rule(df: DataFrame, rule: RuleBins | str, out: str | None = None,
               source: str | None = None) -> DataFrame:
    """Add the rule's label column (a CASE WHEN chain, no UDF)."""
    if isinstance(rule, str):
        out = out or rule
        rule = RULES[rule]
    return df.withColumn(out, rule.expr(source or rule.source))


def edges_expr(mn: Column, mx: Column, k: Column) -> Column:
    """Array of k+1 right-closed bin edges, as pandas builds them."""
    const = mn == mx
    lo = F.when(const, F.when(mn != 0, mn - F.abs(mn) * F.lit(0.001)).otherwise(mn - F.lit(0.001))).otherwise(mn)
    hi = F.when(const, F.when(mx != 0, mx + F.abs(mx) * F.lit(0.001)).otherwise(mx + F.lit(0.001))).otherwise(mx)
    step = (hi - lo) / k.cast("double")
    adj = F.when(const, F.lit(0.0)).otherwise((mx - mn) * F.lit(0.001))
    return F.transform(
        F.sequence(F.lit(0), k),
        lambda i: F.when(i == k, hi).when(i == 0, lo - adj).otherwise(i.cast("double") * step + lo),
    )


def bin_of(x: Column, edges: Column) -> Column:
    """1-based right-closed bin of x among the edges; NULL and NaN have none."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.size(F.filter(edges, lambda e: e < x)).cast("int"))


def number(c: Column | str) -> Column:
    """The column as DOUBLE, NaN as NULL (pandas bins neither)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def edge_list(mn: float, mx: float, k: int) -> list[float]:
    """:func:`edges_expr` in the same double arithmetic, on the driver."""
    const = mn == mx
    lo, hi = (mn, mx) if not const else ((mn - abs(mn) * 0.001, mx + abs(mx) * 0.001) if mn != 0 else (mn - 0.001, mx + 0.001))
    step, adj = (hi - lo) / float(k), 0.0 if const else (mx - mn) * 0.001
    return [lo - adj, *(float(i) * step + lo for i in range(1, k)), hi]


def doubles(values: Iterable[float]) -> Column:
    """array<double> literal (folded once by the optimizer; the text form of a double is exact)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


# Cells of the grid that says where in the merged edges a value has to look.
CELLS = 64


def snapped(x: Column, edges: list[float]) -> Column:
    """The smallest of the sorted ``edges`` that is >= x. All values between two edges share every bin
    that is cut at these edges, so they can be counted as one value. A cell of
    an even grid narrows the search to the few edges in and next to it."""
    lo, hi = edges[0], edges[-1]
    width = (hi - lo) / CELLS or 1.0
    slack = 1e-9 * max(abs(lo), abs(hi), hi - lo)
    first = [max(0, sum(e < lo + c * width - slack for e in edges)) for c in range(CELLS)]
    last = [min(len(edges) - 1, sum(e < lo + (c + 1) * width + slack for e in edges)) for c in range(CELLS)]
    cell = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")))
    starts, counts = doubles(first), doubles(b - a + 1 for a, b in zip(first, last))
    near = F.slice(doubles(edges), F.element_at(starts, cell + 1).cast("int") + 1, F.element_at(counts, cell + 1).cast("int"))
    return F.when(x.isNotNull(), F.get(F.filter(near, lambda e: e >= x), 0))


def bin_edges(ranges: DataFrame, ks: Iterable[int], keys: Iterable[str] = ("var",)) -> DataFrame:
    """(keys..., k, edges) for every variable (of every group) and candidate bin count."""
    ks = [int(k) for k in ks]
    return (ranges.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
            .select(*keys, "k", edges_expr(F.col("mn"), F.col("mx"), F.col("k")).alias("edges")))


def equal_width(df: DataFrame, column: str, k: int = 50, out: str | None = None) -> DataFrame:
    """B6 on one column: adds ``<out>`` (bin 1..k) and its ``_lo``/``_hi`` edges.

    The edges are one global aggregate inlined as a scalar subquery. A NULL or
    NaN value has no bin.
    """
    out = out or f"{column}_fine_classing"
    x = number(column)
    rng = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    edges = rng.select(edges_expr(F.col("_mn"), F.col("_mx"), F.lit(k)).alias("_edges")).scalar()
    b = df.withColumn("_edges", edges).withColumn(out, bin_of(x, F.col("_edges")))
    return (b.withColumn(f"{out}_lo", F.get("_edges", F.col(out) - 1))
            .withColumn(f"{out}_hi", F.get("_edges", F.col(out))).drop("_edges"))
