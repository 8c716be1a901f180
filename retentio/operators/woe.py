"""Weight of Evidence and Information Value (V1-V7).

All statistics are derived from integer counts ``(n_obs, n_good)`` per level,
so a hot level costs one partial aggregate, not a big group. Per-variable
totals and IV sums are separate ``groupBy`` results keyed by the variable
(and bin count); they hold one row per (variable, k) -- bounded by the
analysis, not by the data -- and are joined back as broadcasts.

Semantics kept from the reference: WoE = ln(share of goods / share of bads)
with +inf / -inf for levels without bads / goods; IV = sum over levels of
(share good - share bad) * WoE, infinite if any level is; IV_adjusted = IV of
the levels having both goods and bads, with totals recomputed over them
(NULL when no such level exists).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import LOG_DIGITS, ieee_log_ratio, ratio
from ..session import keep_fanout, written
from .binning import bin_edges, bin_of, edge_list, number, snapped
from .scalars import attach

LABEL = "not_churn_1w"
WOE_COLUMNS = ["n_obs", "prop_good", "prop_n_obs", "n_good", "n_bad", "prop_n_good",
               "prop_n_bad", "WoE", "IV", "IV_adjusted"]


def level_counts(df: DataFrame, keys: Sequence[str], label: str = LABEL) -> DataFrame:
    """(keys..., n_obs, n_good): count and sum of the 0/1 label per level."""
    return df.groupBy(*keys).agg(F.count(F.col(label)).alias("n_obs"),
                                 F.sum(F.col(label)).cast("bigint").alias("n_good"))


def woe_from_counts(counts: DataFrame, group: Sequence[str], per_level: bool = True) -> DataFrame:
    """V1-V3 over a counts frame; ``group`` identifies one variable (and k).

    ``per_level=False`` returns only ``(group..., n_levels, IV, IV_adjusted)``.
    """
    group = list(group)
    mixed = (F.col("n_good") > 0) & (F.col("n_good") < F.col("n_obs"))
    c = counts.withColumn("n_bad", F.col("n_obs") - F.col("n_good"))
    agg = [F.sum("n_obs").alias("_N"), F.sum("n_good").alias("_G"), F.sum("n_bad").alias("_B"),
           F.sum(F.when(mixed, F.col("n_good"))).alias("_G2"),
           F.sum(F.when(mixed, F.col("n_bad"))).alias("_B2")]
    tot = c.groupBy(*group).agg(*agg) if group else c.agg(*agg)
    st = attach(c, tot, group)
    pg, pb = ratio("n_good", "_G"), ratio("n_bad", "_B")
    pg2, pb2 = ratio("n_good", "_G2"), ratio("n_bad", "_B2")
    st = st.withColumns({
        "prop_good": ratio("n_good", "n_obs"),
        "prop_n_obs": ratio("n_obs", "_N"),
        "prop_n_good": pg,
        "prop_n_bad": pb,
        "_ln": F.when((F.col("n_good") > 0) & (F.col("n_bad") > 0), F.log(pg / pb)),
        "_ln2": F.when(mixed, F.log(pg2 / pb2)),
        "WoE": ieee_log_ratio(pg, pb),
    })
    st = st.withColumns({
        "_iv": F.when(F.col("_ln").isNotNull(), (F.col("prop_n_good") - F.col("prop_n_bad")) * F.col("_ln"))
                .otherwise(F.lit(float("inf"))),
        "_iv2": F.when(mixed, (pg2 - pb2) * F.col("_ln2")),
    })
    iv_agg = [F.round(F.sum("_iv"), LOG_DIGITS).alias("IV"), F.round(F.sum("_iv2"), LOG_DIGITS).alias("IV_adjusted")]
    ivs = st.groupBy(*group).agg(*iv_agg) if group else st.agg(*iv_agg)
    if not per_level:
        return st.groupBy(*group).agg(F.count(F.lit(1)).alias("n_levels"), *iv_agg)
    out = attach(st, ivs, group)
    return out.drop("_N", "_G", "_B", "_G2", "_B2", "_ln", "_ln2", "_iv", "_iv2")


def woe_discrete(df: DataFrame, var: str, label: str = LABEL) -> DataFrame:
    """V1: WoE table of one categorical column (level column keeps its name). Rows without a level
    take no part, as in the reference's grouping."""
    return woe_from_counts(level_counts(df.where(F.col(var).isNotNull()), [var], label), []).select(var, *WOE_COLUMNS)


def woe_continuous(df: DataFrame, var: str, label: str = LABEL, k: int = 50) -> DataFrame:
    """V4: equal-width fine classing into k bins, then V1 (bins without rows are not emitted)."""
    counts = binned_counts(df, [var], [k], label)
    out = woe_from_counts(counts, ["var", "k"])
    return out.select(F.col("bin").alias(f"{var}_fine_classing"), F.col("bin_lo"), F.col("bin_hi"), *WOE_COLUMNS)


def interval_counts(df: DataFrame, columns: Iterable[str], ks: Iterable[int],
                    label: str = LABEL, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(by..., var, x, n_obs, n_good) per elementary interval, and (by..., var, mn, mx).

    The columns are written once, narrow, so that what made ``df`` runs once. One aggregate gives the range of every column (in every
    group). The edges of all candidate k of a column, of all groups merged
    and sorted, cut it into elementary intervals (at most the sum of k + 1 per group);
    each value is replaced by the upper end of its interval, so the partial
    aggregation collapses a task's rows to that many per variable whatever the
    number of distinct values. NULL and NaN values take no part.
    """
    cols, ks, by = list(columns), list(ks), list(by)
    spark = df.sparkSession
    df = written(df.select(*by, label, *[number(c).alias(c) for c in cols]))
    extremes = [f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    found = df.groupBy(*by).agg(*extremes).collect()
    ranges = [(*[r[g] for g in by], c, r[f"lo{i}"], r[f"hi{i}"]) for r in found for i, c in enumerate(cols) if r[f"lo{i}"] is not None]
    merged = {c: sorted({e for *_, v, lo, hi in ranges if v == c for k in ks for e in edge_list(lo, hi, k)}) for c in cols}
    merged = {c: edges for c, edges in merged.items() if edges}
    groups = "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in by)
    bounds = spark.createDataFrame(ranges, f"{groups}var string, mn double, mx double")
    if not ranges:
        return spark.createDataFrame([], f"{groups}var string, x double, n_obs long, n_good long"), bounds
    long = df.select(*by, label, *[snapped(F.col(c), merged[c]).alias(c) for c in merged]).unpivot(
        [*by, label], list(merged), "var", "x").where(F.col("x").isNotNull())
    return level_counts(long, [*by, "var", "x"], label), bounds


def binned_counts(df: DataFrame, columns: Iterable[str], ks: Iterable[int], label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """(by..., var, k, bin, bin_lo, bin_hi, n_obs, n_good) for every candidate k.

    The interval counts (a few hundred rows per variable) are rolled up to the bins of each k; an
    interval lies inside one bin of every k, so the bins are exact.
    """
    ks = list(ks)
    values, ranges = interval_counts(df, columns, ks, label, by)
    edges = bin_edges(ranges, ks, [*by, "var"])
    b = values.join(F.broadcast(edges), [*by, "var"]).withColumn("bin", bin_of(F.col("x"), F.col("edges")))
    b = b.withColumns({"bin_lo": F.get("edges", F.col("bin") - 1), "bin_hi": F.get("edges", F.col("bin"))})
    return b.groupBy(*by, "var", "k", "bin", "bin_lo", "bin_hi").agg(
        F.sum("n_obs").alias("n_obs"), F.sum("n_good").alias("n_good"))


def iv_by_class_count(df: DataFrame, columns: Iterable[str], label: str = LABEL,
                      lo: int = 3, hi: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., var, k, IV, IV_adjusted) for k in [lo, hi) -- all groups, variables and k at once."""
    counts = binned_counts(df, columns, range(lo, hi), label, by)
    return woe_from_counts(counts, [*by, "var", "k"], per_level=False).select(*by, "var", "k", "IV", "IV_adjusted")


def best_class_count(df: DataFrame, columns: Iterable[str], label: str = LABEL,
                     lo: int = 3, hi: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """V5: per (group and) variable the k with the largest IV_adjusted (smallest k on ties)."""
    iv = iv_by_class_count(df, columns, label, lo, hi, by)
    w = Window.partitionBy(*by, "var").orderBy(F.col("IV_adjusted").desc_nulls_last(), F.col("k").asc())
    return (iv.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(*by, "var", F.col("k").alias("best_k"), "IV", "IV_adjusted"))


def iv_rank_continuous(df: DataFrame, columns: Iterable[str], label: str = LABEL,
                       lo: int = 3, hi: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """V7: (by..., CONTINUOUS_COL, BEST_CUT, IV, IV_ADJUSTED); sort IV_ADJUSTED desc, IV asc, BEST_CUT asc."""
    b = best_class_count(df, columns, label, lo, hi, by)
    return b.select(*by, F.col("var").alias("CONTINUOUS_COL"), F.col("best_k").alias("BEST_CUT"),
                    F.col("IV"), F.col("IV_adjusted").alias("IV_ADJUSTED"))


def iv_rank_discrete(df: DataFrame, columns: Iterable[str], label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """V6: (by..., DISCRETE_COL, DISTINCT, IV, IV_ADJUSTED) over categorical candidates.

    Levels are compared as strings after one unpivot; one groupBy gives all
    counts, one more gives the per-variable IV.
    """
    cols, by = list(columns), list(by)
    long = df.select(*by, label, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [*by, label], cols, "var", "level").where(F.col("level").isNotNull())
    counts = keep_fanout(level_counts(long, [*by, "var", "level"], label))
    w = woe_from_counts(counts, [*by, "var"], per_level=False)
    return w.select(*by, F.col("var").alias("DISCRETE_COL"), F.col("n_levels").alias("DISTINCT"), "IV",
                    F.col("IV_adjusted").alias("IV_ADJUSTED"))


def rank_order(df: DataFrame, name_col: str, tie_col: str, by: Sequence[str] = ()) -> DataFrame:
    """O2: the reference's display order plus a name tie-break, as ``rank_no`` (one row per variable, in each group)."""
    order = [F.col("IV_ADJUSTED").desc_nulls_last(), F.col("IV").asc(), F.col(tie_col).asc(), F.col(name_col).asc()]
    w = Window.partitionBy(*by) if by else Window
    return df.withColumn("rank_no", F.row_number().over(w.orderBy(*order))).orderBy(*by, "rank_no")
