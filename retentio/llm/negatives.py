"""Hard-negative mining by angular triangle filtering.

Components become ``floor(scale * x)``; a row's score is its integer inner product with the anchor. An anchor's positives are its
best rows of the same label; for each of them the best rows of other labels are wanted whose score lies between
``LOW`` and ``HIGH`` percent of the positive's.

Every row stores its length and its angles to a few reference directions (the leading singular vectors of all rows). By the triangle
inequality on the sphere the angle between anchor and row is at least ``|alpha - theta|`` and at most ``alpha + theta`` (folded at
pi) for each direction; the tightest of these give an interval of the cosine, and times both lengths, rounded outwards, an interval that holds
the integer score. Rows are cut into ranges by label and nearest direction; an anchor is multiplied out, exactly, with the blocks of those ranges whose interval, by the
spread of their angles, meets what is wanted (the positives found so far, or one of the anchor's windows, above the negatives found so far).

Plan: one summary row per range (labels, longest length, spread of each angle; as many as there are partitions) tells which ranges a block of
anchors can concern. A task gets the anchors of a group that concern a range and the blocks of the range (:mod:`retentio.llm.products`; no
join), keeps what is best while the blocks go by, and only the best rows per cell go on. For the negatives the ranges are met in rounds of 1, 4, 16, ...,
taken from all labels in turn; after a round an anchor knows a score that the last row of each window cannot be below. Labels are no key, so a label that a third of all rows
carry is spread like any other. Beyond the summary the driver holds the directions.

Defined cases: rows without an id, with a null label, a null vector, or a null or non-finite component take no part; an
empty vector is a zero vector and shorter vectors count as padded with zeros; rows that repeat an id count once (the smallest label, then vector);
ties go to the smaller id; fewer candidates give fewer rows; negative positive scores have empty windows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import partitions, saved
from retentio.llm.products import (NARROW, TILE, Best, dealt, first_columns, kind, longest, lowest, many_groups, many_ranges, narrow, products, rounds,
                                   spots, threshold, unpack)
from retentio.llm.topk import matrix, rotation

SCALE = 256
EVERY = 100                     # anchors: ids divisible by this
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90              # percent of the positive's score
DIRECTIONS = 8
ORDER = ("label", "near", "vec_id")
BLOCK, ANCHORS = 2048, 512
ANGLE_SLACK = 1e-6              # radians; arccos is good to about 2e-8
PACKED = ("range int, n int, first long, low_label long, high_label long, longest double, low array<double>, high array<double>, "
          "ids binary, labels binary, data binary, lengths binary, angles binary, positives binary, scores binary")
NAMES = [x.split()[0] for x in PACKED.split(", ")]
SENT = ("range int, part int, spread binary, ids binary, labels binary, data binary, lengths binary, angles binary, positives binary, scores binary, "
        "floors binary")
FOUND = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """``(vec_id, label, v array<long>)`` of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & sound)
    pair = F.struct(F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(pair).alias("x"))
    return rows.select("vec_id", "x.label", "x.v")


def measured(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Adds the length, the angles to the directions (columns of ``directions``) and the nearest of them."""
    d = len(directions)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2), d).astype(float)
            length = np.linalg.norm(x, axis=1)
            cosines = (x @ directions) / np.where(length > 0, length, 1)[:, None]
            angles = np.arccos(np.clip(cosines, -1, 1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), angles.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), lists, pa.array(angles.argmin(axis=1).astype(np.int32))],
                                             ["vec_id", "label", "v", "length", "angles", "near"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<long>, length double, angles array<double>, near int")


def blocks(rows: DataFrame, d: int, size: int, parts: int, inside: tuple[str, ...]) -> DataFrame:
    """Blocks of at most ``size`` rows in the order ``inside`` ranges by label and nearest direction (schema ``PACKED``).
    Rows may carry ``positives array<struct<vec_id, score>>``, at most ``POSITIVES`` each."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data = matrix(batch.column(2), d)
            at, ids, labels, length = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
            angles = batch.column(5).flatten().to_numpy().reshape(len(ids), -1)
            given = batch.column(6).to_pylist()
            positives, scores = np.full((len(ids), POSITIVES), -1, np.int64), np.zeros((len(ids), POSITIVES))
            kept = np.zeros((len(ids), POSITIVES), bool)
            for i, some in enumerate(given):
                for j, p in enumerate(some or ()):
                    positives[i, j], scores[i, j], kept[i, j] = p["vec_id"], p["score"], True
            scores[~kept] = np.nan
            for lo in range(0, len(ids), size):
                part = slice(lo, lo + size)
                row = [int(at[lo]), len(ids[part]), int(ids[lo]), int(labels[part].min()), int(labels[part].max()), float(length[part].max()),
                       angles[part].min(axis=0).tolist(), angles[part].max(axis=0).tolist(),
                       *(np.ascontiguousarray(x[part]).tobytes() for x in (ids, labels)), narrow(data[part]),
                       *(np.ascontiguousarray(x[part]).tobytes() for x in (length, angles, positives, scores))]
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row))], schema=ARROW)

    even = rows.repartitionByRange(parts, *ORDER).sortWithinPartitions(*inside)
    none = F.lit(None).cast("array<struct<vec_id: long, score: double>>")
    given = F.col("positives") if "positives" in rows.columns else none
    return even.select(F.spark_partition_id().alias("range"), "vec_id", "v", "label", "length", "angles", given.alias("positives")).mapInArrow(pack, PACKED)


def arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


ARROW = arrow(PACKED)


class Anchors:
    """Packed blocks of anchors as arrays."""

    def __init__(self, rows: list[dict], d: int) -> None:
        def joined(name: str, t: type, width: int) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[name], t).reshape(-1, width) for r in rows])

        self.ids, self.labels, self.length = (joined(*x, 1)[:, 0] for x in (("ids", np.int64), ("labels", np.int64), ("lengths", float)))
        self.data = np.concatenate([unpack(r["ids"], r["data"], d)[1] for r in rows])
        self.angles, self.positives = joined("angles", float, DIRECTIONS), joined("positives", np.int64, POSITIVES)
        self.scores = joined("scores", float, POSITIVES)
        self.floors = joined("floors", float, POSITIVES) if rows[0].get("floors") is not None else np.full(self.scores.shape, -np.inf)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest integer score that each positive admits (1 and 0 where there is none or its score is negative)."""
        p = np.where(self.scores >= 0, self.scores, 0).astype(np.int64)  # a missing positive is NaN
        low, high = p // 100 * LOW - -(p % 100 * LOW) // 100, p // 100 * HIGH + p % 100 * HIGH // 100
        return np.where(self.scores >= 0, low, 1), np.where(self.scores >= 0, high, 0)

    def bounds(self, spread: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each anchor's scores with the rows of a range."""
        top, low, high = np.split(np.frombuffer(spread), [1, 1 + DIRECTIONS])
        lower, upper = intervals(self.length, self.angles, self.angles, top, low[None, :], high[None, :])
        # Shorter vectors move the product towards 0.
        return np.minimum(lower[:, 0], -1.0), np.maximum(upper[:, 0], 1.0)


def intervals(a_length, a_low, a_high, x_length, x_low, x_high) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the integer scores of all pairs. Angles are given as ranges ``(low, high)`` of shape ``(rows, directions)``, equal for single rows."""
    least = np.zeros((len(a_length), len(x_length)))
    most = np.full(least.shape, np.pi)
    for r in range(a_low.shape[1]):
        al, ah, xl, xh = a_low[:, r, None], a_high[:, r, None], x_low[None, :, r], x_high[None, :, r]
        np.maximum(least, np.maximum(al - xh, xl - ah), out=least)
        low, high = al + xl, ah + xh
        # The fold at pi: an interval of sums that spans pi reaches the far side.
        np.minimum(most, np.where(low > np.pi, 2 * np.pi - low, np.where(high < np.pi, high, np.pi)), out=most)
    least, most = np.clip(least - ANGLE_SLACK, 0, np.pi), np.clip(most + ANGLE_SLACK, 0, np.pi)
    size = a_length[:, None] * x_length[None, :]
    slack = 1 + 1e-9 * size
    return np.floor(np.cos(most) * size - slack), np.ceil(np.cos(least) * size + slack)


def tiles(rows: np.ndarray):
    return (rows[lo:lo + TILE] for lo in range(0, len(rows), TILE))


def positives_of(a: Anchors, spread: bytes, met) -> tuple[np.ndarray, ...]:
    """``(anchor_id, vec_id, score)``: the best rows of the anchor's label in the blocks ``met`` (``(ids, labels, vectors)``, ascending ids)."""
    t = kind(longest(a.data) * np.frombuffer(spread)[0])
    _, upper = a.bounds(spread)
    data, best, above = a.data.astype(t), Best(len(a.ids), POSITIVES, t), np.full(len(a.ids), lowest(t))
    for x_ids, x_labels, x in met:
        labels, x = np.unique(x_labels), x.astype(t)
        own = np.minimum(np.searchsorted(x_ids, a.ids), len(x_ids) - 1)
        itself = x_ids[own] == a.ids
        for rows in tiles(np.flatnonzero(np.isin(a.labels, labels) & (upper > above))):
            scores = products(data[rows], x, t)
            fit = scores > above[rows, None]
            if len(labels) > 1:
                fit &= a.labels[rows, None] == x_labels[None, :]
            mine = np.flatnonzero(itself[rows])
            fit[mine, own[rows[mine]]] = False
            crowded = np.flatnonzero(fit.sum(axis=1) > 4 * POSITIVES)
            if len(crowded):
                fit[crowded] = first_columns(scores[crowded], fit[crowded], POSITIVES)
            i, j = spots(fit)
            best.add(rows[i], x_ids[j], scores[i, j])
            if best.count > best.many:
                # Later ids are larger, so a score equal to the last does not displace it.
                changed = best.merge()
                above[changed] = best.scores[changed, -1]
    lists, ids, scores = best.found()
    return a.ids[lists], ids, scores


def negatives_of(a: Anchors, spread: bytes, met) -> tuple[np.ndarray, ...]:
    """Columns of ``FOUND``: the best rows of other labels in each window, of the blocks ``met`` (``(ids, labels, vectors)``, ascending ids),
    as far as they reach the window's floor."""
    t = kind(longest(a.data) * np.frombuffer(spread)[0])
    lower, upper = a.bounds(spread)
    low, high = a.windows()
    # One list for each positive; scores above ``above`` and up to ``high`` are wanted.
    above = np.maximum(threshold(a.floors, t), (low - 1).astype(t))
    above[low > high], high = np.iinfo(np.int64).max if t is np.int64 else np.inf, high.astype(t)
    data, best, every = a.data.astype(t), Best(above.size, NEGATIVES, t), np.arange(POSITIVES)
    for x_ids, x_labels, x in met:
        only, x = x_labels[0] if (x_labels == x_labels[0]).all() else None, x.astype(t)
        least, most = above.min(axis=1), high.max(axis=1)
        wanted = (least < most) & (upper > least) & (lower <= most)
        if only is not None:
            wanted &= a.labels != only
        for rows in tiles(np.flatnonzero(wanted)):
            scores = products(data[rows], x, t)
            fit = scores > least[rows, None]
            fit &= scores <= most[rows, None]
            i, j = spots(fit)
            crowded = np.bincount(i, minlength=len(rows)) > 4 * NEGATIVES
            if crowded.any():
                some, few = np.flatnonzero(crowded), ~crowded[i]
                i, j = i[few], j[few]
                part, other = scores[some], a.labels[rows[some], None] != x_labels[None, :]
                for m in every:
                    fits = (part > above[rows[some], m, None]) & (part <= high[rows[some], m, None]) & other
                    at, column = spots(first_columns(part, fits, NEGATIVES))
                    best.add(rows[some[at]] * POSITIVES + m, x_ids[column], part[at, column])
            if only is None:
                other = a.labels[rows[i]] != x_labels[j]
                i, j = i[other], j[other]
            score = scores[i, j]
            which, m = spots((score[:, None] > above[rows[i]]) & (score[:, None] <= high[rows[i]]))
            best.add(rows[i[which]] * POSITIVES + m, x_ids[j[which]], score[which])
            if best.count > best.many:
                # Later ids are larger, so a score equal to the last does not displace it.
                changed = best.merge()
                above.reshape(-1)[changed] = np.maximum(above.reshape(-1)[changed], best.scores[changed, -1])
                least = above.min(axis=1)
    lists, ids, scores = best.found()
    i, m = np.divmod(lists, POSITIVES)
    return a.ids[i], a.positives[i, m], ids, a.scores[i, m].astype(np.int64), scores


def summaries(packed: DataFrame) -> list[dict]:
    """One row per range: its labels, longest length and spread of angles."""
    about = packed.groupBy("range").agg(
        F.min("low_label").alias("low_label"), F.max("high_label").alias("high_label"), F.max("longest").alias("longest"),
        *[F.min(F.col("low")[r]).alias(f"l{r}") for r in range(DIRECTIONS)], *[F.max(F.col("high")[r]).alias(f"h{r}") for r in range(DIRECTIONS)])
    return [r.asDict() for r in about.orderBy("range").collect()]


def met(anchors: DataFrame, packed: DataFrame, d: int, ranges: list[dict], groups: int, concerns, score, schema: str) -> DataFrame:
    """What ``score(anchors, spread, blocks)`` gives for the anchors of each group and each of the ``ranges`` that ``concerns`` their block. Anchor blocks may
    carry ``known array<struct<anchor_id, positive_id, floor>>``."""
    names, sent = [x.split()[0] for x in schema.split(", ")], arrow(SENT)

    def route(batches):
        for batch in batches:
            for row in batch.to_pylist():
                floors = {(r["anchor_id"], r["positive_id"]): r["floor"] for r in row["known"] or ()}
                whole = Anchors([row], d)
                if floors:
                    whole.floors = np.array([[floors.get((i, p), -np.inf) for p in ps] for i, ps in zip(whole.ids.tolist(), whole.positives.tolist())])
                for r in ranges:
                    if concerns(whole, row, r):
                        spread = np.array([r["longest"], *(r[f"l{i}"] for i in range(DIRECTIONS)), *(r[f"h{i}"] for i in range(DIRECTIONS))])
                        given = {**row, "part": row["range"], "range": r["range"], "spread": spread.tobytes(), "floors": whole.floors.tobytes()}
                        yield pa.RecordBatch.from_pylist([{n: given[n] for n in sent.names}], schema=sent)

    def run(asked, blocks):
        found = score(Anchors(asked, d), asked[0]["spread"], ((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), unpack(r["ids"], r["data"], d)[1]) for r in blocks))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

    if "known" not in anchors.columns:
        anchors = anchors.withColumn("known", F.lit(None).cast("array<struct<anchor_id: long, positive_id: long, floor: double>>"))
    routed = anchors.select(*NAMES, "known").mapInArrow(route, SENT)
    return dealt(anchors.sparkSession, routed, packed.select("range", "first", "ids", "labels", "data"), [r["range"] for r in ranges], groups, run, schema)


def range_bounds(row: dict, r: dict) -> tuple[float, float]:
    """Bounds of the scores between an anchor block and a whole range, by their spreads of angles."""
    spread = [np.array([x]) for x in (row["low"], row["high"], [r[f"l{i}"] for i in range(len(row["low"]))], [r[f"h{i}"] for i in range(len(row["low"]))])]
    lower, upper = intervals(np.array([row["longest"]]), spread[0], spread[1], np.array([r["longest"]]), spread[2], spread[3])
    # Shorter vectors move the product towards 0.
    return min(float(lower[0, 0]), -1.0), max(float(upper[0, 0]), 1.0)


def same_labels(a: Anchors, row: dict, r: dict) -> bool:
    return row["low_label"] <= r["high_label"] and r["low_label"] <= row["high_label"]


def in_windows(a: Anchors, row: dict, r: dict) -> bool:
    low, high = a.windows()
    lower, upper = range_bounds(row, r)
    return bool(((low <= high) & (upper >= np.maximum(low, a.floors)) & (lower <= high)).any())


def in_turn(ranges: list[dict]) -> list[dict]:
    """Any stretch of the result has ranges from all over the list."""
    return [r for _, r in sorted(enumerate(ranges), key=lambda x: (x[0] * 0.6180339887498949 % 1, x[0]))]


def best_so_far(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    spark = vectors.sparkSession
    raw = saved(quantised(vectors, id_col, vec_col, label_col, scale))
    d = max(DIRECTIONS, raw.agg(F.max(F.size("v")).alias("d")).first().d or 1)
    rows = saved(measured(raw, rotation(raw, d)[:, :DIRECTIONS]))
    packed = saved(blocks(rows, d, BLOCK, many_ranges(spark, rows.count(), BLOCK, every), ("vec_id",)))
    ranges = summaries(packed)

    def packed_anchors(chosen: DataFrame) -> tuple[DataFrame, int]:
        parts = max(1, min(partitions(spark), -(-chosen.count() // ANCHORS)))
        out = saved(blocks(chosen, d, ANCHORS, parts, ORDER).withColumn("block", F.monotonically_increasing_id()))
        return out, many_groups(spark, len(ranges), out.count(), ANCHORS)

    def members(batches):
        for batch in batches:
            for ids, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), block))], ["anchor_id", "block"])

    chosen = rows.where(F.col("vec_id") % every == 0)
    anchors, groups = packed_anchors(chosen)
    # Block rows are about a third of a megabyte, so few of them make a batch.
    before = spark.conf.get(NARROW)
    spark.conf.set(NARROW, "8")
    try:
        found = saved(met(anchors, packed, d, ranges, groups, same_labels, positives_of, "anchor_id long, vec_id long, score long"))
    finally:
        spark.conf.set(NARROW, before)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    top = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= POSITIVES)
    given = top.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", F.col("score").cast("double").alias("score")))).alias("positives"))
    anchors, groups = packed_anchors(saved(chosen.join(given, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")))

    spark.conf.set(NARROW, "8")
    try:
        places = saved(anchors.select("ids", "block").mapInArrow(members, "anchor_id long, block long"))
        best, asked = saved(spark.createDataFrame([], FOUND + ", rank int")), anchors
        for group in rounds(in_turn(ranges)):
            found = met(asked, packed, d, group, groups, in_windows, negatives_of, FOUND)
            best = saved(best_so_far(found.unionByName(best.drop("rank"))))
            last = best.where(F.col("rank") == NEGATIVES).select("anchor_id", "positive_id", F.col("negative_score").cast("double").alias("floor"))
            floors = saved(last.join(places, "anchor_id").groupBy("block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "floor")).alias("known")))
            asked = anchors.join(floors, "block", "left")
    finally:
        spark.conf.set(NARROW, before)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
