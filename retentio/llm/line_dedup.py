"""Corpus-wide line dedup, built-in functions only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
A-Z lower-cased. A key of at least ``min_chars`` code points found in two or
more documents keeps its lines in the smallest id that holds it and loses them
everywhere else.

Plan: each document is split once into ``(128-bit key hash, id, position)``
rows. The hashes are range-partitioned and sorted by document (which line of the document comes first does not
matter, as all of them share its fate); a window streams over each hash and its first row names the document that keeps
the line. Hashes whose slice of the hash space is too large for one task (a
line that a third of the corpus shares) take the same decision by a pre-aggregated
minimum, joined back on a key that adaptive execution splits. What comes
back per document is a run-length coded bitmap of the dropped lines, never text.

Defined cases: a null or empty text is one empty line; a null id counts as the
largest id; rows with equal ids are one document (a line repeated across them
stays), and rows equal in id and text get the same bitmap; ties cannot occur
(the smallest id wins); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import WHITE, ascii_lower, keyed, packed, real_id, saved, with_span

MIN_CHARS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """``(h1, h2, _id, _th, pos)`` of every line long enough to be compared."""
    line = F.btrim(F.col("line"), F.lit(WHITE))
    return (
        rows.select("_id", "_th", F.posexplode(lines_of(F.col("_text"))).alias("pos", "line"))
        .select("_id", "_th", "pos", line.alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("_id", "_th", "pos", ascii_lower(F.col("line")).alias("key"))
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "_id", "_th", "pos")
    )


def dropped_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(_id, _th, pos)`` of the lines that go."""
    return with_span(saved(line_rows(rows, min_chars)), ["h1", "h2"]).where("_id > first_id").select("_id", "_th", "pos")


def drop_runs(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document that loses lines: ``(_id, _th, n_dropped, runs)``,
    ``runs`` being the run-length coded bitmap ``array<struct<start,len>>`` of its dropped lines."""
    w = Window.partitionBy("_id", "_th").orderBy("pos")
    return (
        dropped_lines(rows, min_chars).distinct()
        .withColumn("island", F.col("pos") - F.row_number().over(w))
        .groupBy("_id", "_th", "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
        .groupBy("_id", "_th").agg(F.sum("len").alias("n_dropped"),
                                   F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs"))
    )


def kept_text(text: Column, runs: Column) -> Column:
    """The lines between the runs, joined by a line feed."""
    lines = lines_of(text)
    end = lambda r: r["start"] + r["len"]
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(F.get(runs, i - 1)))
    gaps = F.transform(runs, lambda r, i: F.slice(lines, before(i) + 1, r["start"] - before(i)))
    last = end(F.element_at(runs, -1))
    kept = F.concat(F.flatten(gaps), F.slice(lines, last + 1, F.size(lines)))
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per input row: ``id_col``, ``n_lines``, ``n_dropped``, ``drop_runs`` and the ``kept_text``."""
    rows = keyed(docs, id_col, text_col)
    marked = rows.join(drop_runs(rows, min_chars), ["_id", "_th"], "left")
    return marked.select(
        real_id().alias(id_col),
        F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.col("runs").alias("drop_runs"),
        kept_text(F.col("_text"), F.col("runs")).alias("kept_text"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           min_chars: int = MIN_CHARS, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with all its columns and the kept lines as its text (unchanged where nothing goes).

    With ``drop_emptied``, a row that loses lines and keeps none of at least ``min_chars`` code points goes as a
    whole: all it said is in earlier documents. Rows that lose no line always stay."""
    marked = packed(docs, id_col, text_col).join(drop_runs(keyed(docs, id_col, text_col), min_chars), ["_id", "_th"], "left")
    old = F.col("_row")[text_col]
    marked = marked.withColumn("left", F.when(F.col("runs").isNull(), old).otherwise(kept_text(old, F.col("runs"))))
    if drop_emptied:
        says = F.exists(lines_of(F.col("left")), lambda x: F.char_length(F.btrim(x, F.lit(WHITE))) >= min_chars)
        marked = marked.where(F.col("runs").isNull() | says)
    return marked.select(*[(F.col("left") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
