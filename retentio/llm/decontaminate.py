"""Benchmark decontamination by containment, built-in functions only.

Texts are lower-cased and cut into words ``[^\\x20\\x09-\\x0D]+``; a set holds
the distinct five-word shingles. A document is contaminated by an item when it
holds at least 75 % of the item's shingles.

Short items hide inside long documents, so whole-document signatures would
hardly ever agree. Instead the items are partitioned by size, and the sketch of
an item is its smallest shingle hashes (a bottom-k MinHash), as many as its size class
needs: a document that misses at most a quarter of ``n`` shingles must hold one of any
``n - ceil(0.75 n) + 1``. That makes the search exact at any document length. Hits are
then verified by exact containment on the shingles themselves.

Plan: the shingle hashes of a document are computed inside one generated loop
(split, explode of positions, hash of five words) and probed against the item sketch; only hits
leave the task. The sketch is broadcast when its counted rows are within
``BROADCAST_ROWS``, else joined by shuffle.

Defined cases: null, empty and blank texts hold nothing and match nothing; a text of one to
four words is one shingle, which only an equally short document can hold; null ids
are kept as null; repeated documents and items give one row per id pair
(the highest containment); empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import BROADCAST_ROWS, joined_small, keyed, packed, real_id, saved, words

WIDTH = 5
PERCENT = 75


def _cut(rows: DataFrame) -> DataFrame:
    """Adds ``w`` (words) and ``last`` (position of the last shingle, counted from 0)."""
    cut = rows.withColumn("w", words(F.lower("_text"))).where(F.size("w") > 0)
    return cut.withColumn("last", F.greatest(F.size("w") - WIDTH, F.lit(0)))


def _shingles(w: str = "w", last: str = "last"):
    return F.transform(F.sequence(F.lit(0), F.col(last)), lambda i: F.array_join(F.slice(F.col(w), i + 1, WIDTH), " "))


def _hash_at(i):
    """Hash of the (up to five) words from position ``i`` on; a missing word leaves the hash as it is."""
    return F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WIDTH)])


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, i_th, shingles, n, need, size_class)`` per item with words."""
    cut = _cut(keyed(items, id_col, text_col))
    sets = cut.select(F.col("_id").alias("item"), F.col("_th").alias("i_th"), "w", "last",
                      F.array_distinct(_shingles()).alias("shingles"))
    n = F.size("shingles").cast("long")
    return sets.distinct().withColumns({"n": n, "need": F.ceil(n * PERCENT / 100).cast("long"),
                             "size_class": F.floor(F.log2(n)).cast("int")})


def sketches(sets: DataFrame) -> DataFrame:
    """``(h, item, i_th, need)``: the smallest hashes of each item. ``n - need + 1`` of them
    are enough; a size class takes what its largest member needs."""
    hashes = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("last")), _hash_at)))
    top = F.least(F.col("n"), F.pow(F.lit(2), F.col("size_class") + 1).cast("long") - 1)
    k = F.greatest(F.col("n") - F.col("need") + 1, F.least(F.col("n"), top - F.ceil(top * PERCENT / 100) + 1))
    return sets.select("item", "i_th", "need", F.explode(F.slice(hashes, 1, k.cast("int"))).alias("h"))


def candidates(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """Distinct ``(_id, _th, item, i_th)`` where a document holds a sketch hash and is large enough."""
    probe = (
        _cut(rows).select("_id", "_th", "w", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
        .select("_id", "_th", "last", _hash_at(F.col("i")).alias("h"))
    )
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    return probe.join(sketch, "h").where("last + 1 >= need").select("_id", "_th", "item", "i_th").distinct()


def contaminations(rows: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified ``(_id, _th, item, n, shared)``, one row per document row and item."""
    sets = saved(item_sets(items, item_id, item_text))
    found = saved(candidates(rows, saved(sketches(sets))))
    texts = _cut(rows.join(found.select("_id", "_th").distinct(), ["_id", "_th"]).dropDuplicates(["_id", "_th"]))
    docs = texts.select("_id", "_th", F.array_distinct(_shingles()).alias("have"))
    pairs = found.join(sets.select("item", "i_th", "shingles", "n", "need"), ["item", "i_th"])
    return (
        docs.join(pairs, ["_id", "_th"])
        .withColumn("shared", F.size(F.array_intersect("shingles", "have")).cast("long"))
        .where("shared >= need").select("_id", "_th", "item", "n", "shared")
    )


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id_col, item_id, n_shingles, n_shared, containment)`` per contaminated document and item."""
    best = F.max(F.struct((F.col("shared") / F.col("n")).alias("c"), "n", "shared")).alias("b")
    hits = contaminations(keyed(docs, id_col, text_col), items, item_id, item_text).groupBy("_id", "item").agg(best)
    return hits.select(real_id().alias(id_col), real_id("item").alias(item_id), F.col("b.n").alias("n_shingles"),
                       F.col("b.shared").alias("n_shared"), F.col("b.c").alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = contaminations(keyed(docs, id_col, text_col), items).select("_id", "_th").distinct()
    clean = joined_small(packed(docs, id_col, text_col), saved(bad), ["_id", "_th"], "left_anti")
    return clean.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
