"""Exact top-k search by integer inner product over norm-sorted blocks.

Components become ``floor(1024 * x)``. Vectors are put in order of descending length by a range partitioning and packed
into blocks; queries are packed into blocks too. An orthogonal rotation from the singular vectors of the whole table
(its d x d Gram matrix) moves most of every inner product into the leading coordinates.

The ranges are met in rounds, the longest vectors first, each round four times as many as the one before. After a round a query
knows a score that its k-th best cannot be below. By Cauchy-Schwarz
no vector shorter than that score over the query's length can be among its best, so a query goes on only to
the ranges that reach that length. Inside a range the leading rotated coordinates are summed and the rest is bounded
by the product of the residual lengths, as long as that rules queries out; the queries whose bound reaches their score are multiplied out with
the block, exactly: in single precision while no sum can reach 2^24, else in double precision, else in integers.

Plan: blocks are rows of bounded size; a task gets the queries of a group that concern a range and the blocks of the range
(:mod:`retentio.llm.products`; no join), keeps each query's best k while the blocks go by, and the best k of each cell go on to a per-query top k, a
written table after each round. The rounds grow with the logarithm of the ranges. The driver holds the Gram matrix and one
length per range (as many as there are partitions).

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part; shorter vectors count
as padded with zeros; rows that repeat an id count once (the smallest vector, if they differ); ties go to the smaller id;
fewer than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import partitions, saved
from retentio.llm.products import (NARROW, TILE, Best, dealt, first_columns, kind, longest, lowest, many_groups, many_ranges, narrow, products, rounds,
                                   spots, threshold, unpack)

K = 10
SCALE = 1024
EVERY = 100          # queries: ids divisible by this
BLOCK, QUERIES = 2048, 512
LEAD = 0.25          # share of the rotated coordinates that is summed first
RARELY = 31          # tiles that go without the leading bound after one that it left most queries of
PACKED = "range int, n int, longest double, first long, ids binary, data binary"


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v array<long>, length)`` of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(x) > 0) & sound)
    ints = F.transform(x, lambda c: F.floor(c * SCALE))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(ints).alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``d`` columns."""
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None, :] < counts[:, None]] = flat
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Singular vectors of all rows, by descending singular value, from a distributed Gram matrix."""

    def gram(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["at", "s"])

    sums = rows.select("v").mapInArrow(gram, "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    out = np.zeros(d * d)
    for r in sums.collect():
        out[r["at"]] = r["s"]
    _, basis = np.linalg.eigh(out.reshape(d, d))
    return basis[:, ::-1]


def blocks(rows: DataFrame, d: int, size: int, parts: int) -> DataFrame:
    """Blocks of at most ``size`` rows, in order of id inside ranges of descending length (schema ``PACKED``)."""

    def pack(batches):
        for batch in batches:
            data = matrix(batch.column(2), d)
            ids, at, length = (batch.column(i).to_numpy() for i in (1, 0, 3))
            for lo in range(0, len(ids), size):
                part = slice(lo, lo + size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(at[lo])], pa.int32()), pa.array([len(ids[part])], pa.int32()), pa.array([float(length[part].max())]),
                     pa.array([int(ids[lo])], pa.int64()), pa.array([ids[part].astype(np.int64).tobytes()], pa.binary()), pa.array([narrow(data[part])], pa.binary())],
                    [x.split()[0] for x in PACKED.split(", ")])

    even = rows.repartitionByRange(parts, F.col("length").desc(), F.col("vec_id")).sortWithinPartitions("vec_id")
    return even.select(F.spark_partition_id().alias("range"), "vec_id", "v", "length").mapInArrow(pack, PACKED)


def best_of(q_ids, q, floor, met, reach: float, basis: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query_id, vec_id, score)``: each query's best ``k`` of the blocks ``met`` (``(ids, vectors)``, ascending ids, vectors no longer than ``reach``),
    as far as they reach its floor."""
    lead, top = max(1, int(q.shape[1] * LEAD)), longest(q) * reach
    t = kind(top)
    rough, slack = (np.float32, 1 + 1e-5 * top) if t is np.float32 else (np.float64, 1 + 1e-9 * top)

    def leading(x):
        rotated = x.astype(float) @ basis
        return np.column_stack([rotated[:, :lead], np.linalg.norm(rotated[:, lead:], axis=1)]).astype(rough)

    q, q_lead, best, above, without = q.astype(t), leading(q), Best(len(q), k, t), threshold(floor, t), 0
    for x_ids, x in met:
        x_lead, x = leading(x), x.astype(t)
        own = np.minimum(np.searchsorted(x_ids, q_ids), len(x_ids) - 1)
        itself = x_ids[own] == q_ids
        for lo in range(0, len(q), TILE):
            rows = np.arange(lo, min(lo + TILE, len(q)))
            if without:
                without -= 1
            else:
                near = (q_lead[rows] @ x_lead.T).max(axis=1) + slack > above[rows]
                without = RARELY if 2 * near.sum() > len(rows) else 0
                rows = rows[near]
                if not len(rows):
                    continue
            scores = products(q[rows], x, t)
            mine = np.flatnonzero(itself[rows])
            scores[mine, own[rows[mine]]] = lowest(t)
            hot = np.flatnonzero(scores.max(axis=1) > above[rows])
            if not len(hot):
                continue
            rows, scores = rows[hot], scores[hot]
            fit = scores > above[rows, None]
            crowded = np.flatnonzero(fit.sum(axis=1) > 4 * k)
            if len(crowded):
                fit[crowded] = first_columns(scores[crowded], fit[crowded], k)
            i, j = spots(fit)
            best.add(rows[i], x_ids[j], scores[i, j])
            if best.count > best.many:
                # Later ids are larger, so a score equal to the k-th does not displace it.
                changed = best.merge()
                above[changed] = np.maximum(above[changed], best.scores[changed, -1])
    lists, ids, scores = best.found()
    return q_ids[lists], ids, scores


def best_so_far(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def routed(asked: DataFrame, floors: DataFrame | None, to: list[tuple[int, float]], d: int) -> DataFrame:
    """``(range, part, reach, q_ids, q_data, floor)``: the queries of each block that may have one of their best in a range of ``to`` (its number
    and longest vector). ``floors``: ``(block, known array<struct<query_id, floor>>)``."""

    def run(batches):
        for batch in batches:
            for ids, data, part, known in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, q = unpack(ids, data, d)
                given = {r["query_id"]: r["floor"] for r in known or ()}
                floor = np.array([given.get(i, -np.inf) for i in q_ids.tolist()])
                need = np.where(floor > 0, floor / np.maximum(np.linalg.norm(q.astype(float), axis=1), 1e-9), 0.0) * (1 - 1e-9)
                for number, longest in to:
                    goes = need <= longest
                    if goes.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([number], pa.int32()), pa.array([part], pa.int32()), pa.array([longest]), pa.array([q_ids[goes].tobytes()], pa.binary()),
                             pa.array([q[goes].tobytes()], pa.binary()), pa.array([floor[goes].tobytes()], pa.binary())],
                            ["range", "part", "reach", "q_ids", "q_data", "floor"])

    rows = asked.withColumn("known", F.lit(None).cast("array<struct<query_id: long, floor: double>>")) if floors is None else asked.join(floors, "block", "left")
    return rows.select("ids", "data", "part", "known").mapInArrow(run, "range int, part int, reach double, q_ids binary, q_data binary, floor binary")


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best rows other than itself."""
    spark = vectors.sparkSession
    rows = saved(quantised(vectors, id_col, vec_col))
    d = rows.agg(F.max(F.size("v")).alias("d")).first().d or 1
    basis = rotation(rows, d)
    packed = saved(blocks(rows, d, BLOCK, many_ranges(spark, rows.count(), BLOCK, every)))
    chosen = rows.where(F.col("vec_id") % every == 0)
    asked = blocks(chosen, d, QUERIES, max(1, min(partitions(spark), -(-chosen.count() // QUERIES))))
    asked = saved(asked.select("ids", "data", F.col("range").alias("part"), F.monotonically_increasing_id().alias("block")))
    reach = {r.range: r.longest for r in packed.groupBy("range").agg(F.max("longest").alias("longest")).collect()}
    groups = many_groups(spark, len(reach), asked.count(), QUERIES)

    def members(batches):
        for batch in batches:
            for ids, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), block))], ["query_id", "block"])

    def score(asked, met):
        q_ids, q = (np.concatenate(x) for x in zip(*(unpack(r["q_ids"], r["q_data"], d) for r in asked)))
        floor = np.concatenate([np.frombuffer(r["floor"]) for r in asked])
        found = best_of(q_ids, q, floor, (unpack(r["ids"], r["data"], d) for r in met), asked[0]["reach"], basis, k)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    # Block rows are about a quarter of a megabyte, so few of them make a batch.
    before = spark.conf.get(NARROW)
    spark.conf.set(NARROW, "8")
    try:
        places = saved(asked.select("ids", "block").mapInArrow(members, "query_id long, block long"))
        best, floors = saved(spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")), None
        for group in rounds(sorted(reach, key=lambda r: (-reach[r], r))):
            sent = routed(asked, floors, [(r, reach[r]) for r in group], d)
            found = dealt(spark, sent, packed.select("range", "first", "ids", "data"), group, groups, score, "query_id long, vec_id long, score long")
            best = saved(best_so_far(found.unionByName(best.drop("rank")), k))
            whole = best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
            floors = saved(whole.join(places, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("known")))
    finally:
        spark.conf.set(NARROW, before)
    return best
