"""Periodic runs in texts by online dyadic square catching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and a length of at
least ``max(MIN_LENGTH, EXPONENT * q)`` that no neighbouring word extends keeping the period.

A machine (:class:`SquareCatchers`) takes the words as they are appended. On level ``k`` the text is a row of blocks of ``2^k`` words;
each completed block gets a catcher, which watches for the block's next occurrences at distances from ``2^k`` up to
``2^(k+1) - 1``. Two neighbouring blocks caught at one distance ``d`` agree with the words ``d`` further on over ``2^(k+1) > d`` words: a square
of period ``d``. Its suffix comparison then runs back to the first disagreement and forward with every appended word, and
squares of one period that touch merge into one run. Any run holds such a pair of blocks: the words that
agree with those ``q`` further on number at least ``3 * 2^k``, which is room for two whole blocks. Squares inside a run of a
shorter period, found on a level below, are repetitions of its root and are not followed.

Blocks are told apart by hashes (equal blocks have equal ones); every comparison that decides a run is made on the words.
A level is advanced when one of its blocks completes, so the work is O(log n) vectorised steps a word, however the
text is cut into appended parts; memory is a few numbers a word.

Plan: one Arrow pass; no shuffle. A very long text is one machine's, in time near-linear in its words.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows are taken each for itself; a null id stays null;
ties for the longest run go to the smallest start, then the smallest period; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import small_batches, words
from retentio.llm.tokens import mix, split

MIN_LENGTH, EXPONENT = 6, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def needed(period: int) -> int:
    return max(MIN_LENGTH, EXPONENT * period)


class SquareCatchers:
    """Online: :meth:`append` word numbers, in parts of any size; :meth:`runs` tells the runs of all words so far."""

    def __init__(self) -> None:
        self.words = np.zeros(0, np.int64)
        self.n = 0
        self.first: list[int] = []                  # by level: the first block whose catchers are still watching
        self.seen: list[int] = []                   # by level: the length at its last advance
        self.open: dict[int, list[int]] = {}        # by period: the last stretch [lo, hi) that agrees with the words a period further on
        self.found: dict[tuple[int, int], list[int]] = {}   # runs by (period, start): [end]

    def append(self, words: np.ndarray) -> None:
        """Take further words; advance the open comparisons and the levels of which a block was completed."""
        if not len(words):
            return
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            grown = np.zeros(max(self.n, 2 * len(self.words)) if before else self.n, np.int64)
            grown[:before] = self.words[:before]
            self.words = grown
        self.words[before:self.n] = words
        for period, stretch in self.open.items():
            if stretch[1] == before - period:
                self.extend(period, stretch)
        self.advance([k for k in self.levels() if self.n >> k > self.seen[k] >> k])

    def levels(self) -> range:
        """Levels on which a run may have its period already."""
        while needed(1 << len(self.first)) <= self.n:
            self.first.append(0)
            self.seen.append(0)
        return range(len(self.first))

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of all runs, by start, then period. More words may be appended afterwards."""
        self.advance(list(self.levels()))
        shortest: dict[tuple[int, int], int] = {}
        for (period, start), (end,) in self.found.items():
            if end - start >= needed(period):
                shortest[start, end] = min(period, shortest.get((start, end), period))
        return sorted((start, end - start, period) for (start, end), period in shortest.items())

    def advance(self, levels: list[int]) -> None:
        """Let the catchers of these levels look at the words up to the last one."""
        if not levels:
            return
        start = min(self.first[k] << k for k in levels)
        hashes = mix(self.words[start:self.n].astype(np.uint64) + _STEP)  # of the 2^k words from each place on
        for k in range(levels[-1] + 1):
            if k in levels:
                self.catch(k, hashes[(self.first[k] << k) - start:])
                self.first[k] = max(self.first[k], ((self.n + 1) >> k) - 3)
                self.seen[k] = self.n
            half = 1 << k
            hashes = mix(hashes[:-half] * _STEP + hashes[half:]) if len(hashes) > half else hashes[:0]

    def catch(self, k: int, hashes: np.ndarray) -> None:
        """New squares of level ``k``; ``hashes`` start at its first watching block."""
        size = 1 << k
        blocks = min(len(hashes) // size, -(-(len(hashes) - size) // size)) if len(hashes) > size else 0
        if blocks < 2:
            return
        caught = np.zeros(blocks * size, bool)
        ahead = hashes[size:size + blocks * size]
        caught[:len(ahead)] = ahead == np.repeat(hashes[:blocks * size:size], size)[:len(ahead)]
        caught = caught.reshape(blocks, size)
        at = np.flatnonzero(caught[:-1] & caught[1:])
        if not len(at):
            return
        place, period = ((at >> k) + self.first[k]) << k, (at & (size - 1)) + size
        if self.found:  # squares inside a run of a shorter period
            known = sorted((s, e[0]) for (q, s), e in self.found.items() if q < size and e[0] - s >= needed(q))
            if known:
                starts, ends = np.array([s for s, _ in known]), np.maximum.accumulate([e for _, e in known])
                before = np.searchsorted(starts, place, side="right") - 1
                inside = (before >= 0) & (ends[before] >= place + 2 * size + period)
                place, period = place[~inside], period[~inside]
        for i, d in zip(place.tolist(), period.tolist()):
            stretch = self.open.get(d)
            if stretch is None or i + 2 * size > stretch[1]:
                low = i - self.agree_back(i, d)
                self.open[d] = [low, i + 2 * size]
                self.extend(d, self.open[d])

    def extend(self, period: int, stretch: list[int]) -> None:
        """Carry a comparison on to the first disagreement or the last word; a stretch that is long enough is a run."""
        lo, hi = stretch
        stretch[1] = hi + self.agree(hi, period)
        if stretch[1] + period - lo >= needed(period):
            self.found[period, lo] = [stretch[1] + period]

    def agree(self, at: int, d: int) -> int:
        """How many words from ``at`` on equal those ``d`` further on."""
        total, step, stop = 0, 16, self.n - d
        while at + total < stop:
            lo = at + total
            part = self.words[lo:min(lo + step, stop)] != self.words[lo + d:min(lo + step, stop) + d]
            if part.any():
                return total + int(part.argmax())
            total, step = total + len(part), step * 2
        return total

    def agree_back(self, at: int, d: int) -> int:
        """How many words before ``at`` equal those ``d`` further on."""
        total, step = 0, 16
        while at > total:
            hi = at - total
            lo = max(0, hi - step)
            part = self.words[lo:hi] != self.words[lo + d:hi + d]
            if part.any():
                return total + int(part[::-1].argmax())
            total, step = total + len(part), step * 2
        return total


def numbered(words_: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, within one text."""
    numbers = dict.fromkeys(words_)
    for i, w in enumerate(numbers):
        numbers[w] = i
    return np.fromiter(map(numbers.__getitem__, words_), np.int64, len(words_))


def runs_of(words_: list[bytes]) -> list[tuple[int, int, int]]:
    catchers = SquareCatchers()
    catchers.append(numbered(words_))
    return catchers.runs()


def without_repeats(words_: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words_
    gone = np.zeros(len(words_) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words_[i] for i in kept.tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, runs array<struct<start, length, period>>, collapsed)`` per row: the runs by start, then period, and the
    text without the repeats, its words joined by one space."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(1).to_pylist():
                words_ = split(text)
                found = runs_of(words_)
                runs.append([dict(zip(("start", "length", "period"), x)) for x in found])
                texts.append(b" ".join(without_repeats(words_, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def with_planted_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_col)``, in which a tenth of the documents (crc32 ``h`` of the decimal id, ``h % 10 = 0``) repeat a part of themselves: with
    ``g = h div 10`` and ``n`` words, each word ``i`` from ``a = g % n`` on becomes word ``a + (i - a) % p``,
    ``p`` being ``1 + (n - a) div (3 + g % 8)``. Rows without an id or without words stay as they are."""
    def word(i: Column) -> Column:
        return F.element_at(F.col("_w"), F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))) + 1)

    h = F.crc32(F.col(id_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.coalesce(h % 10 == 0, F.lit(False)).alias("_planted"),
                       F.expr(f"crc32(cast(`{id_col}` as string)) div 10").alias("_g"))
    g = F.col("_g")
    rows = rows.withColumn("_w", F.when(F.col("_planted"), words(F.col("_text"))))
    some = F.col("_planted") & (F.size("_w") > 0)
    rows = rows.withColumn("_a", F.when(some, F.pmod(g, F.size("_w").cast("long")).cast("int")))
    rows = rows.withColumn("_p", F.when(some, 1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), word), " ")
    return rows.select(F.col("_doc").alias(id_col), F.when(some, tail).otherwise(F.col("_text")).alias(text_col))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"]))
                                     .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
                                     .otherwise(F.signum(x["period"] - y["period"])).cast("int")), 1)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("_best", F.when(F.size("runs") > 0, best))
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"), F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
