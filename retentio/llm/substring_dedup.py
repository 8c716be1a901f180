"""Removal of passages of ``WINDOW`` words that an earlier document holds as well.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``WINDOW`` consecutive words. A word goes when a window
over it also starts in a document with a smaller id; windows are judged on the input.

Anchors. Hashing every window would move as many rows as there are words. Instead shorter windows are
hashed only at positions whose remainder by ``PERIOD`` lies in a difference cover: every difference
of two remainders is the difference of two cover members, so wherever two documents share ``WINDOW`` words there is an
offset below ``PERIOD`` at which both have an anchor, with the same words. Six in 31 positions are hashed, and two documents
that share no anchor share no window. Around anchors found in several documents the match is then extended: all
full windows over the anchor get a 128-bit hash, and the smallest id of each hash decides.

Plan: exact copies are decided on digests of the texts first. Anchor rows and window rows are each dealt once by hash; a hash slice
that is too full for one task takes the pre-aggregated path of :func:`retentio.llm.common.with_span`. Only texts with shared anchors
move to where their windows are hashed; no pairs of documents are formed.

Defined cases: a null text has no words; texts shorter than a window keep everything; null ids count as the largest id;
rows with equal ids are one document, so they never remove from each other; exact copies lose all
words of all windows but in the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import LAST_ID, joined_small, real_id, saved, small_batches, with_span
from retentio.llm.tokens import mix, split, word_hashes

WINDOW = 50
# A perfect difference set; each remainder 1..30 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
# A position carries 24 bits of the text's hash, which tell rows with equal ids apart.
POSITION_BITS = 39
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(odd: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << 16
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    back = pow(odd, -1, 1 << 64)
    up[1:], down[1:] = odd, back
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = [_powers(x) for x in _ODD]


def rolling(hashes: np.ndarray, width: int, lane: int) -> np.ndarray:
    """Hash of every run of ``width`` words: sum of word hash times odd power, by prefix sums in pieces."""
    up, down = _POWERS[lane]
    if lane:
        hashes = mix(hashes ^ np.uint64(_ODD[1]))
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step, out = len(up) - width, []
    for lo in range(0, n, step):
        part = hashes[lo:lo + step + width - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=total[1:])
        k = len(part) - width + 1
        out.append((total[width:] - total[:-width]) * down[:k])
    return mix(np.concatenate(out))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    salt = F.shiftleft(F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << 24) - 1)), POSITION_BITS)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), salt.alias("_salt"), F.col(text_col).alias("_text"))


def packed_rows(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns], names)


def anchors(rows: DataFrame) -> DataFrame:
    """``(h1, _id, at)`` of every anchor."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches):
        for batch in batches:
            h, ids, at = [], [], []
            for i, salt, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = split(text)
                if len(words) < WINDOW:
                    continue
                found = rolling(word_hashes(words), ANCHOR, 0)
                where = np.flatnonzero(cover[np.arange(len(found)) % PERIOD])
                h.append(found[where].view(np.int64))
                at.append(where + salt)
                ids.append(np.full(len(where), i, np.int64))
            yield packed_rows([h, ids, at], ["h1", "_id", "at"])

    return rows.mapInArrow(run, "h1 long, _id long, at long")


def windows(texts: DataFrame) -> DataFrame:
    """``(h1, h2, _id, at)`` of every full window over a shared anchor, from ``(_id, _salt, _text, spots)``."""

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, salt, text, spots in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = word_hashes(split(text))
                # A window over an anchor starts up to PERIOD - 1 words before it.
                last = len(hashes) - WINDOW
                edge = np.zeros(last + 2, np.int64)
                spots = np.asarray(spots, np.int64) - salt
                np.add.at(edge, np.clip(spots - (PERIOD - 1), 0, last + 1), 1)
                np.add.at(edge, np.clip(spots + 1, 0, last + 1), -1)
                where = np.flatnonzero(np.cumsum(edge)[:-1])
                for lane in (0, 1):
                    out[lane].append(rolling(hashes, WINDOW, lane)[where].view(np.int64))
                out[2].append(np.full(len(where), i, np.int64))
                out[3].append(where + salt)
            yield packed_rows(out, ["h1", "h2", "_id", "at"])

    return texts.mapInArrow(run, "h1 long, h2 long, _id long, at long")


def spots(rows: DataFrame) -> DataFrame:
    """Positions gathered per document row: ``(_id, _salt, spots)``; as many as the text has words at most."""
    salt = F.shiftleft(F.shiftright("at", POSITION_BITS), POSITION_BITS)
    return rows.groupBy("_id", salt.alias("_salt")).agg(F.collect_list("at").alias("spots"))


def later_copies(rows: DataFrame) -> DataFrame:
    """``(_id, _salt)`` of the documents whose whole text a smaller id holds, by 128-bit digests of the texts."""
    digests_ = rows.select("_id", "_salt", F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit("text"), F.col("_text")).alias("h2"))
    return saved(with_span(saved(digests_), ["h1", "h2"]).where("_id > first_id").select("_id", "_salt").distinct())


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``(_id, _salt, runs)``: the starts of the windows that an earlier document holds, as runs ``(start, stop)``."""
    found = with_span(saved(anchors(rows)), ["h1"])
    shared = saved(spots(found.where("first_id < last_id").select("_id", "at")))
    texts = joined_small(rows, saved(shared.select("_id", "_salt")), ["_id", "_salt"], "left_semi")
    texts = texts.join(shared, ["_id", "_salt"]).dropDuplicates(["_id", "_salt"]).select("_id", "_salt", "_text", "spots")
    later = with_span(saved(windows(texts)), ["h1", "h2"]).where("_id > first_id").select("_id", "at")
    w = Window.partitionBy("_id").orderBy("at")
    runs = (later.withColumn("island", F.col("at") - F.row_number().over(w))
            .groupBy("_id", "island").agg(F.min("at").alias("start"), F.max("at").alias("stop")))
    salt = F.shiftleft(F.shiftright("start", POSITION_BITS), POSITION_BITS)
    return runs.groupBy("_id", salt.alias("_salt")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("start") - salt).alias("start"), (F.col("stop") - salt).alias("stop")))).alias("runs"))


def marked_rows(rows: DataFrame) -> DataFrame:
    """``(_id, _text, copy, start, stop)`` per row: whether it copies an earlier text, else its repeated runs.

    Every window of a copy starts in the earlier document too, so copies need no windows; and as they have the
    windows of their first text, none is missed without them. Texts without marks stay where they are while the marked ones are counted few."""
    copies = later_copies(rows)
    runs = saved(repeated_windows(joined_small(rows, copies, ["_id", "_salt"], "left_anti")))
    marks = saved(runs.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True))
    keys = ["_id", "_salt"]
    touched = marks.select(*keys)
    moved = joined_small(rows, touched, keys, "left_semi").join(marks, keys)
    still = joined_small(rows, touched, keys, "left_anti").withColumns({"copy": F.lit(False), "runs": F.lit(None).cast(marks.schema["runs"].dataType)})
    return moved.unionByName(still.select(*moved.columns)).select("_id", "_text", "copy", "runs.start", "runs.stop")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``id_col``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by
    one space) and the removed word ranges ``array<struct<start, stop>>``, ``stop`` excluded."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, n_words, n_removed, texts, ranges = batch.column(0), [], [], [], []
            for text, copy, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:])):
                words = split(text)
                gone: list[dict] = []
                if copy and len(words) >= WINDOW:
                    gone.append({"start": 0, "stop": len(words)})
                for lo, hi in zip(starts or (), stops or ()):
                    if gone and lo <= gone[-1]["stop"]:
                        gone[-1]["stop"] = hi + WINDOW
                    else:
                        gone.append({"start": lo, "stop": hi + WINDOW})
                kept, at = [], 0
                for g in gone:
                    kept += words[at:g["start"]]
                    at = g["stop"]
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode())
                ranges.append(gone)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(texts, pa.string()), pa.array(ranges, kind)], ["_id", "n_words", "n_removed", "kept_text", "removed"])

    schema = "_id long, n_words long, n_removed long, kept_text string, removed array<struct<start: long, stop: long>>"
    out = marked_rows(rows_of(docs, id_col, text_col)).mapInArrow(run, schema)
    return out.select(real_id().alias(id_col), "n_words", "n_removed", "kept_text", "removed")


def digests(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

