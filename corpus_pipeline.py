"""Corpus pipeline: raw documents to token ids, in five stages.

Every stage works on all that the one before kept; its result is written as Parquet and read again. All but the
last return the columns of ``documents``. Some stages are not expressible in SQL (learnt scores, the tokenizer), so there is
no ``ORACLE_SQL``; ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from retentio.llm.common import saved, table
from retentio.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go (operator 5)."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; so do documents of which no line long enough to be
    compared is left, as they are copies; the others stay, with what is left (operator 2)."""
    out = line_dedup.without_repeated_lines(docs, drop_emptied=True)
    n_chars = F.when(F.col("text").isNotNull(), F.char_length("text")).cast("long")
    return out.withColumn("n_chars", n_chars)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (operator 10)."""
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 8)."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and what they decode to (operator 9)."""
    # The executors' heaps have grown in the stages before, so the machines take less memory than alone.
    return bpe.coded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True, share=0.4)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread, the last one is returned."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
