"""Dummy encoding with a pinned training vocabulary.

The vocabulary -- sorted levels of each selected column in the training
frame, the last level of each column dropped as the baseline -- is a small
DataFrame (a design matrix never has more than a few hundred columns). The
encoded data stays distributed and sparse: long form ``(keys..., feature)`` for
the rows' active dummies, their positions as an array, or a sparse ML vector. Levels are found by
a hash look-up per column. A level that the training
frame never had encodes to all zeros (the reference drops such columns).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sort_key(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    if isinstance(t, (T.NumericType, T.BooleanType)):
        return F.col(c).cast("double")
    return F.lit(None).cast("double")


def vocabulary(train: DataFrame, columns: Sequence[str], drop_last: bool = True) -> DataFrame:
    """(variable, level, feature, position): levels seen in train, sorted, baseline dropped.

    Levels sort by value (numbers numerically, strings by code point), as the
    reference's dummies do; ``feature`` is ``<column>:<level>``.
    """
    cols = list(columns)
    # one scan: every column becomes (level text, numeric sort key, column order), unpivoted together
    packed = train.select(*[F.struct(F.col(c).cast("string").alias("level"), _sort_key(train, c).alias("_num"),
                                     F.lit(i).alias("_ci")).alias(c) for i, c in enumerate(cols)])
    lv = (packed.unpivot([], cols, "variable", "_v").select("variable", "_v.*")
          .where(F.col("level").isNotNull()).distinct())
    wc = Window.partitionBy("variable").orderBy(F.col("_num").asc_nulls_last(), F.col("level"))
    lv = lv.withColumns({"_r": F.row_number().over(wc), "_n": F.count(F.lit(1)).over(Window.partitionBy("variable"))})
    if drop_last:
        lv = lv.where(F.col("_r") < F.col("_n"))
    # a column's first position: how many dummies the columns before it have (one row per column)
    sizes = lv.groupBy("_ci").agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.orderBy("_ci").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_ci", F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias("_start"))
    return lv.join(F.broadcast(starts), "_ci").select(
        "variable", "level", F.concat_ws(":", "variable", "level").alias("feature"),
        (F.col("_start") + F.col("_r") - 1).cast("int").alias("position"))


def collect_vocabulary(vocab: DataFrame) -> list[tuple[str, str, str]]:
    """(variable, level, feature) in position order: the columns of a design
    matrix, which a model's coefficient vector holds on the driver anyway."""
    return [(r["variable"], r["level"], r["feature"]) for r in vocab.orderBy("position").collect()]


def encode_long(df: DataFrame, vocab: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """E1/E2 sparse form: (keys..., feature) for every dummy equal to 1.

    Rows are unpivoted to (column, level) and matched against the vocabulary;
    adaptive execution picks the join by the vocabulary's size. Unseen levels
    and baselines produce no row.
    """
    cols = list(columns)
    long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(keys), cols, "variable", "level")
    return long.join(vocab.select("variable", "level", "feature"), ["variable", "level"]).select(
        *keys, "feature")


def vocabularies(train: DataFrame, columns: dict[int, Sequence[str]], by: str) -> dict[int, list[tuple[str, str, str]]]:
    """:func:`collect_vocabulary` of each group of ``train`` (its value of ``by``), with the columns of its model; one scan for all."""
    cols = sorted({c for some in columns.values() for c in some})
    if not cols:
        return {g: [] for g in columns}
    packed = train.select(by, *[F.struct(F.col(c).cast("string").alias("level"), _sort_key(train, c).alias("num")).alias(f"_{c}") for c in cols])
    long = packed.unpivot([by], [f"_{c}" for c in cols], "variable", "v").select(by, F.expr("substring(variable, 2)").alias("variable"), "v.*")
    levels: dict[tuple, list] = {}
    for r in long.where(F.col("level").isNotNull()).distinct().collect():
        levels.setdefault((r[by], r["variable"]), []).append((r["num"] is None, r["num"] or 0.0, r["level"]))
    return {g: [(c, level, f"{c}:{level}") for c in some for _, _, level in sorted(levels.get((g, c), []))[:-1]] for g, some in columns.items()}


def with_positions(df: DataFrame, vocab_list: Sequence[tuple[str, str, str]], out: str = "positions") -> DataFrame:
    """Adds ``array<int>``, the positions of the row's dummies that are 1, ascending. Baselines, unseen levels and NULL have none.

    Levels are looked up in a hash map per column, so neither the generated code nor the work per row grows with the vocabulary."""
    levels: dict[str, list[tuple[int, str]]] = {}
    for i, (c, level, _) in enumerate(vocab_list):
        levels.setdefault(c, []).append((i, level))
    if not levels:
        return df.withColumn(out, F.array().cast("array<int>"))
    if any([i for i, _ in known] != list(range(known[0][0], known[0][0] + len(known))) for known in levels.values()):
        raise ValueError("the vocabulary holds a column in several places")
    texts, numbers = [f"_level{n}" for n in range(len(levels))], [f"_number{n}" for n in range(len(levels))]
    model = StringIndexerModel.from_arrays_of_labels([[x for _, x in known] for known in levels.values()], texts, numbers, handleInvalid="keep")
    x = model.transform(df.withColumns({t: F.col(c).cast("string") for t, c in zip(texts, levels)}))
    at = F.array(*[F.when(F.col(n) < len(known), (F.col(n) + known[0][0]).cast("int")) for n, known in zip(numbers, levels.values())])
    return x.withColumn(out, F.filter(at, lambda i: i.isNotNull())).drop(*texts, *numbers)


def with_vector(df: DataFrame, vocab_list: Sequence[tuple[str, str, str]], out: str = "_features") -> DataFrame:
    """E1/E2 as a sparse ML vector."""
    if not vocab_list:
        return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    x = with_positions(df, vocab_list, "_positions").withColumn("_positions", F.col("_positions").cast("array<string>"))
    places = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(vocab_list))], "_positions", out, binary=True)
    return places.transform(x).drop("_positions")
