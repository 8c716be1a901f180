"""What the searches over integer vectors share: blocks of vectors as bytes, exact products, and the dealing of queries and blocks to tasks.

A search meets groups of query blocks with ranges of vectors. A (range, group) pair is a cell, and one task's: its rows are the group's queries that
concern the range and the blocks of the range, each once, so a vector is sent once per group and a query once per range, whatever
the number of pairs of blocks. There is no join, so no table of blocks is ever broadcast, however small its file is: vectors that repeat
compress a hundredfold, and Spark takes a table to be as large as its file.
A task holds the queries of its cell (at most about ``HELD`` of them) and streams the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import partitions

TILE = 512           # queries multiplied out at a time
HELD = 65_536        # queries of a cell
EXACT32, EXACT = 2**24, 2**53    # integers below are exact as single and double floats
NARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def narrow(x: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def unpack(ids: bytes, data: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, f"i{len(data) // max(1, len(i) * d)}" if len(i) else np.int64).reshape(-1, d)


def longest(x: np.ndarray) -> float:
    return float(np.sqrt(np.square(x.astype(float)).sum(axis=1).max(initial=0)))


def kind(top: float) -> type:
    """The fastest type in which products of vectors, the product of whose lengths is at most ``top``, are exact: no partial sum is above it (Cauchy-Schwarz)."""
    return np.float32 if 1.001 * top < EXACT32 else np.float64 if 1.001 * top < EXACT else np.int64


def lowest(t: type) -> float | int:
    """Stands for no score."""
    return -np.iinfo(t).max if t is np.int64 else -np.inf


def threshold(floor: np.ndarray, t: type) -> np.ndarray:
    """Scores that reach the integers ``floor`` (as doubles) are above this."""
    if t is not np.int64:
        return (floor - 1).astype(t)
    sound = np.where(np.isfinite(floor), floor, 0.0)
    return np.where(np.isfinite(floor), np.clip(sound - 1 - 1e-9 * np.abs(sound), -9e18, 9e18).astype(np.int64), lowest(t))


def products(q: np.ndarray, x: np.ndarray, t: type) -> np.ndarray:
    """Exact inner products of all rows of ``q`` and ``x``, as ``t`` (both are of that type already unless it is integer)."""
    if t is not np.int64:
        return q @ x.T
    if longest(q) * longest(x) < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)  # an error where a score is beyond 64 bits


def spots(fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what holds, in order, as ``np.nonzero`` has them. Where little holds, eight places are looked at at once."""
    flat = np.ascontiguousarray(fit).reshape(-1)
    eights = np.flatnonzero(flat.view(np.uint64)) if flat.size and flat.size % 8 == 0 else None
    if eights is not None and len(eights) * 32 < flat.size:
        at = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
        at = at[flat[at]]
    else:
        at = np.flatnonzero(flat)
    return np.divmod(at, max(1, fit.shape[1]))


def first_columns(scores: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Which columns that ``fit`` hold each row's ``k`` best scores; ties go to the first columns."""
    if scores.shape[1] <= k:
        return fit
    scores = np.where(fit, scores, lowest(scores.dtype.type))
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    above = scores > least
    equal = (scores == least) & fit
    return above | (equal & (equal.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))


class Best:
    """The best ``k`` found so far in each of ``n`` lists, by descending score, then ascending id. Found are kept aside until they are many."""

    def __init__(self, n: int, k: int, t: type) -> None:
        self.k, self.none = k, lowest(t)
        self.ids, self.scores = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), self.none, t)
        self.aside: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many, self.count = max(4096, 2 * n), 0

    def add(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.aside.append((lists, ids, scores))
        self.count += len(lists)

    def merge(self) -> np.ndarray:
        """Let what is aside take its places; the lists that changed."""
        lists, ids, scores = (np.concatenate(x) for x in zip(*self.aside))
        self.aside, self.count = [], 0
        changed = np.unique(lists)
        lists = np.concatenate([lists, np.repeat(changed, self.k)])
        ids, scores = np.concatenate([ids, self.ids[changed].ravel()]), np.concatenate([scores, self.scores[changed].ravel()])
        order = np.lexsort((ids, -scores, lists))
        starts = np.searchsorted(lists[order], changed)
        kept = order[starts[:, None] + np.arange(self.k)]
        self.ids[changed], self.scores[changed] = ids[kept], scores[kept]
        return changed

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(lists, ids, scores)``"""
        if self.aside:
            self.merge()
        at = spots(self.scores != self.none)
        return at[0], self.ids[at], self.scores[at].astype(np.int64)


def rounds(ranges: list) -> list[list]:
    """The ranges in order, in groups of 1, 4, 16, ..."""
    out, at, size = [], 0, 1
    while at < len(ranges):
        out.append(ranges[at:at + size])
        at, size = at + size, size * 4
    return out


def many_ranges(spark: SparkSession, rows: int, size: int, every: int) -> int:
    """Ranges to cut vectors into, a share ``1 / every`` of which are queries. Cells are as many as partitions at least; with
    ``sqrt(every * cells)`` ranges, the queries sent to each range and the vectors sent to each group are about as much."""
    return max(1, min(partitions(spark), -(-rows // size), math.ceil(math.sqrt(max(1, every) * partitions(spark)))))


def many_groups(spark: SparkSession, ranges: int, blocks: int, size: int) -> int:
    """Groups to deal blocks of ``size`` queries into."""
    return max(1, min(blocks, max(-(-partitions(spark) // max(1, ranges)), -(-blocks * size // HELD))))


def dealt(spark: SparkSession, queries: DataFrame, blocks: DataFrame, ranges: list[int], groups: int, run: Callable, schema: str) -> DataFrame:
    """``run(queries, blocks)`` of each cell. ``queries`` (schema ``range int, part int, ...``) go to the cell of their range and group;
    ``blocks`` (``range int, first long, ...``), of which ``ranges`` are taken, to all groups of theirs, in order of ``first``. ``run`` gets the cell's query rows and an iterator over its
    block rows, as dictionaries, and yields record batches."""
    here = F.array(*[F.lit(g) for g in range(groups)])
    q = queries.select((F.col("range") * groups + F.pmod("part", F.lit(groups))).alias("cell"), F.struct(*[c for c in queries.columns if c not in ("range", "part")]).alias("q"))
    x = (blocks.where(F.col("range").isin(ranges)).select(F.explode(here).alias("group"), *blocks.columns)
         .select((F.col("range") * groups + F.col("group")).alias("cell"), "first", F.struct(*[c for c in blocks.columns if c not in ("range", "first")]).alias("x")))
    rows = q.withColumn("first", F.lit(None).cast("long")).unionByName(x, allowMissingColumns=True)
    n = max(1, min(partitions(spark), len(ranges) * groups))
    # Cells have consecutive numbers, so they are dealt evenly; a cell's queries come before its blocks.
    order = F.col("first").asc_nulls_first()
    even = rows.repartitionById(n, "cell").sortWithinPartitions("cell", order).select("cell", "q", "x")

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            cell, asked = row["cell"], []
            while row is not None and row["cell"] == cell and row["q"] is not None:
                asked.append(row["q"])
                row = next(rows, None)

            def met() -> Iterator[dict]:
                nonlocal row
                while row is not None and row["cell"] == cell:
                    yield row["x"]
                    row = next(rows, None)

            blocks = met()
            if asked:
                yield from run(asked, blocks)
            for _ in blocks:  # what is left of the cell
                pass

    return even.mapInArrow(cells, schema)
