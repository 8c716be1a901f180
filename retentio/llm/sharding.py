"""Contiguous sharding with the smallest possible largest shard, built-in functions only.

Rows with equal texts are one atomic group; groups stand in the order of their smallest id. The
ordered group sizes are cut into ``shards`` contiguous runs so that the largest run is as small as any
contiguous cut allows: a binary search finds the smallest capacity for which greedy filling
succeeds, and the cuts are made there. Where greedy filling at that capacity would leave the
last shards light, each cut is moved to the even share as far as the capacity permits, so sizes
stay near equal even when one group is larger than a share.

Plan: group sizes are aggregated (a text held by a third of all rows is one row after the
map side), range-partitioned in order, and summed into prefix positions. Greedy filling only asks "which
is the last group end at or before x?". The driver keeps a sorted summary of group ends,
at most ``BLOCKS`` per looked-at stretch, and answers from it as long as the answer does not depend on ends it has not
seen; otherwise one scan refines the stretches in question. Each round narrows them
``BLOCKS``-fold, so a few scans of one column suffice at any input size.

Defined cases: a null text has no bytes, counts 1 and stands with the empty texts; a null id comes last;
repeated rows stand together; equal ids in different groups are ordered by the group key; more shards than
groups leaves shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import LAST_ID, partitions, real_id, saved

# Blocks that one refinement scan cuts each stretch of positions into.
BLOCKS = 4096


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, size, crc, grp)``: a row's size in UTF-8 bytes plus 1, its checksum and the key of its text."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("crc"),
        F.unhex(F.md5(data)).alias("grp"),
    )


def running_totals(df: DataFrame, order: list[str], value: str, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows up to and with this one in the order of ``order``.

    The rows are dealt into ranges, totalled by range, and summed inside each range on top of what the ranges
    before hold; only the totals (one row a range) meet in one task."""
    dealt = saved(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
              .select("_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn(into, F.sum(value).over(inside)).join(F.broadcast(before), "_range")
    return out.withColumn(into, F.col(into) + F.col("_before")).drop("_range", "_before")


class Ends:
    """Group ends (prefix positions) as far as known. ``dark`` holds the open stretches that
    have ends not seen yet."""

    def __init__(self, ends: DataFrame, total: int) -> None:
        self.table, self.total = ends, total
        self.known, self.dark = [0, total], [(0, total)]

    def refine(self, stretches: list[tuple[int, int]]) -> None:
        """One scan: cut the stretches into blocks and note first and last end of each."""
        case = None
        for k, (lo, hi) in enumerate(stretches):
            step = max(1, -(-(hi - lo) // BLOCKS))
            inside = (F.col("end") > lo) & (F.col("end") < hi)
            block = F.struct(F.lit(k).alias("k"), F.floor((F.col("end") - lo) / step).alias("b"))
            case = F.when(inside, block) if case is None else case.when(inside, block)
        blocks = (
            self.table.select("end", case.alias("at")).where("at IS NOT NULL")
            .groupBy("at").agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n")).collect()
        )
        gone = set(stretches)
        self.dark = sorted([d for d in self.dark if d not in gone] + [(b.lo, b.hi) for b in blocks if b.n > 2])
        self.known = sorted({*self.known, *(b.lo for b in blocks), *(b.hi for b in blocks)})

    def unseen(self, x: int) -> tuple[int, int] | None:
        """The dark stretch around ``x``, if there is one."""
        i = bisect_right(self.dark, (x, self.total + 1)) - 1
        return self.dark[i] if i >= 0 and self.dark[i][0] < x < self.dark[i][1] else None

    def floor(self, x: int) -> int:
        return self.known[bisect_right(self.known, x) - 1]

    def fits(self, capacity: int, shards: int, hopeful: bool) -> bool:
        """Greedy filling from known ends. ``hopeful``: an unseen stretch is taken to have an end at every
        position, so False is certain; otherwise it has none, so True is certain."""
        at = 0
        for _ in range(shards):
            x = min(at + capacity, self.total)
            at = x if hopeful and self.unseen(x) else max(at, self.floor(x))
        return at >= self.total

    def smallest(self, low: int, shards: int, hopeful: bool) -> int:
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if self.fits(mid, shards, hopeful):
                high = mid
            else:
                low = mid + 1
        return low

    def capacity(self, shards: int) -> int:
        """The smallest feasible capacity, refining the stretches it depends on until both views agree."""
        low = -(-self.total // shards)
        while True:
            low = self.smallest(low, shards, hopeful=True)
            high = self.smallest(low, shards, hopeful=False)
            if low == high:
                return low
            doubtful: set[tuple[int, int]] = set()
            least, most = 0, 0
            for _ in range(shards):
                least, most = self.floor(min(least + low, self.total)), min(most + high, self.total)
                i = max(0, bisect_left(self.dark, (least, least)) - 1)
                while i < len(self.dark) and self.dark[i][0] < most:
                    if self.dark[i][1] > least:
                        doubtful.add(self.dark[i])
                    i += 1
            self.refine(self.joined(sorted(doubtful)))

    def joined(self, stretches: list[tuple[int, int]], at_most: int = 64) -> list[tuple[int, int]]:
        """At most so many stretches: neighbours over small gaps are looked at as one."""
        while len(stretches) > at_most:
            gap = sorted(b[0] - a[1] for a, b in zip(stretches, stretches[1:]))[len(stretches) // 2]
            out = [stretches[0]]
            for lo, hi in stretches[1:]:
                if lo - out[-1][1] <= gap:
                    out[-1] = (out[-1][0], hi)
                else:
                    out.append((lo, hi))
            stretches = out
        self.dark = sorted([d for d in self.dark if not any(lo <= d[0] and d[1] <= hi for lo, hi in stretches)] + stretches)
        return stretches

    def exact(self, x: int, up: bool = False) -> int:
        """The last end at or before ``x`` (``up``: the first at or after it)."""
        while stretch := self.unseen(x):
            self.refine([stretch])
        return self.known[bisect_left(self.known, x)] if up else self.floor(x)

    def cuts(self, shards: int) -> list[int]:
        """The ends of all shards but the last: the even share, or as near to it as the capacity lets it be."""
        if not self.total:
            return [0] * (shards - 1)
        capacity = self.capacity(shards)
        least = [self.total]  # the smallest end of shard j from which the rest still fits
        for _ in range(shards - 1):
            least.append(self.exact(max(0, least[-1] - capacity), up=True))
        out, at = [], 0
        for j in range(1, shards):
            even = max(self.exact(self.total * j // shards), least[shards - j])
            at = max(at, self.exact(min(even, at + capacity)))
            out.append(at)
        return out


def shard_of(end: Column, cuts: list[int]) -> Column:
    """The number of cuts before this group end."""
    return sum((F.when(end > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless in its shard)."""
    rows = saved(sized(docs, id_col, text_col))
    groups = rows.groupBy("grp").agg(F.min("_id").alias("first_id"), F.sum("size").alias("bytes"))
    placed = saved(running_totals(groups, ["first_id", "grp"], "bytes", "end").select("grp", "end"))
    total = placed.agg(F.coalesce(F.max("end"), F.lit(0)).alias("t")).first().t
    cuts = Ends(placed.select("end"), total).cuts(shards)
    # Both sides come from tables, so a group with very many rows is split by the adaptive join.
    with_shard = rows.join(placed.select("grp", shard_of(F.col("end"), cuts).alias("shard")), "grp")
    return with_slots(with_shard).select(real_id().alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: the rank by id inside the shard, by ranges so that no task holds a shard."""
    one = rows.select("_id", "size", "crc", "shard").withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(one, ["shard", "_id", "crc"], "one", "rank")
    ranked = saved(ranked)
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))
