"""Near-duplicate documents by one-permutation MinHash, star-shaped candidates and exact confirmation.

A document's set holds the distinct five-word shingles of its text with A-Z lower-cased (a shorter text is one shingle).
Two documents are linked when their sets' similarity is at least 75 %; groups are what links connect.

1. Equal sets are one class, represented by its smallest id; copies never meet as pairs.
2. Each class gets a signature by one permutation with optimal densification (:mod:`retentio.llm.minhash`), cut
   into ``BANDS`` bands of ``ROWS`` values. A pair at the threshold misses every band with a probability near 2 in a million.
3. A bucket (classes that agree on a band) yields a star, not a clique: its hub, the member that meets most others
   anywhere, is paired with each other member, and these pairs are confirmed on the full sets.
4. Confirmed links give components. A bucket whose members already belong together is done. In the others, members of
   different components may still be linked with each other past the hub. Such pairs are ruled out inside the bucket, without being
   emitted, where an exact bound shows that they cannot be linked: set sizes, the triangle inequality over
   the similarities to the hub (1 - similarity is a metric), and the parity maps of the sets. What the bounds
   leave over is confirmed on the full sets too, so stars lose no link that a bucket holds.

Plan: buckets are counted before they are joined, minima are pre-aggregated, hot keys meet only in joins of two tables, which
adaptive execution splits; buckets of more than ``CHUNK`` members are dealt as pairs of chunks of sizes that may be linked. Sets are built
again only for classes that share a bucket. Components come from large-star / small-star rounds over written tables.

Defined cases: texts without words (null, empty, blank) have an empty set and are linked with nothing; rows without an id are documents of
their own, told apart by text, and never name a group; rows that share an id are one document (in :func:`one_of_each`, rows that share id and text); equal similarity needs no tie rule, as components are sets; an
empty table gives an empty result.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import LAST_ID, WHITE, joined_small, keyed, only, packed, saved, small_batches, tidied
from retentio.llm.minhash import band_keys, parity_map
from retentio.llm.tokens import forget_words, mix, shingle_set

# Linked: 100 * |A and B| >= 75 * |A or B|.
PERCENT = 75
# Members of a bucket that one task looks at; larger buckets are dealt as pairs of chunks.
CHUNK = 512
# Ratio of set sizes within a size class; more than the 4 / 3 by which linked sets may differ.
SPAN = 1.34
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, n, s1, s2, bands, map)``: set size, 128-bit set hash, band keys and parity map of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        only("words", forget_words)
        for batch in tidied(batches):
            n, s1, s2, bands, maps = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                s1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix(s ^ _SECOND).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_keys(s))
                maps.append(parity_map(s).tobytes())
            offsets = np.cumsum([0, *map(len, bands)], dtype=np.int32)
            keys = pa.ListArray.from_arrays(offsets, np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                                              keys, pa.array(maps, pa.binary())], ["_id", "n", "s1", "s2", "bands", "map"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, n long, s1 long, s2 long, bands array<long>, map binary")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of a link ``(a, b)``; the component is its smallest node.

    Rounds of large-star and small-star: every node points its neighbours at the smallest one it sees. The
    number of rounds grows with the logarithm of the longest path. Each round is a written table."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = saved(joined_small(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = joined_small(large, low, ["u"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = saved(rest.unionByName(low.withColumnRenamed("m", "v")).distinct())
        mark = F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")
        done = small.agg(F.count("*").alias("n"), mark).first() == edges.agg(F.count("*").alias("n"), mark).first()
        edges = small
        if done:
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, shingles binary)`` of the documents in ``wanted``."""

    def run(batches):
        only("words", forget_words)
        for batch in tidied(batches):
            sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["_id", "shingles"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), F.col(text_col).alias("_text"))
    return joined_small(rows, wanted, ["_id"], "left_semi").mapInArrow(run, "_id long, shingles binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, shared, total)`` of each pair, on the full sets; the best one where an id has several sets."""

    def run(batches):
        for batch in batches:
            shared, total = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                total.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])

    left, right = (sets.select(F.col("_id").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b")
    out = both.mapInArrow(run, "a long, b long, shared long, total long")
    best = F.max(F.struct((F.col("shared") / F.col("total")).alias("j"), "shared", "total")).alias("x")
    return saved(out.groupBy("a", "b").agg(best).select("a", "b", "x.shared", "x.total"))


def linked() -> Column:
    return F.col("shared") * 100 >= F.col("total") * PERCENT


def sizes_allow(n: str, m: str) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def still_possible(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of members of one bucket (``_bucket``) that lie in different components and that
    no exact bound rules out. ``rows``: ``_bucket, _side, rep, n, map, component, far``."""

    def pairs_of(side, rep, n, maps, component, far):
        order = np.argsort(n, kind="stable")
        side, rep, n, maps, component, far = side[order], rep[order], n[order], maps[order], component[order], far[order]
        for i in range(len(rep)):
            # Sizes in order: partners up to n / 0.75.
            stop = np.searchsorted(n, n[i] * 100 // PERCENT, side="right")
            j = np.arange(i + 1, stop)
            j = j[(component[j] != component[i]) & ((side[j] != side[i]) | (side[j] == 2)) & ~(np.abs(far[j] - far[i]) > 1 - PERCENT / 100 + 1e-9)]
            if len(j):
                # Linked sets differ in at most (n + m) * (100 - p) / (100 + p) elements, and maps in no more bits.
                differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
                for k in j[differ * (100 + PERCENT) <= (n[j] + n[i]) * (100 - PERCENT)]:
                    yield min(rep[i], rep[k]), max(rep[i], rep[k])

    def run(batches):
        held, bucket = [], None

        def flush():
            cols = [np.concatenate(c) for c in zip(*held)]
            found = set(pairs_of(*cols))
            held.clear()
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            maps = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(keys), -1)
            cols = [batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), maps, batch.column(5).to_numpy(), batch.column(6).to_numpy()]
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and keys[lo] != bucket:
                        yield flush()
                    bucket = keys[lo]
                    held.append([c[lo:hi] for c in cols])
        if held:
            yield flush()

    ordered = rows.repartition("_bucket").sortWithinPartitions("_bucket")
    return ordered.select("_bucket", "_side", "rep", "n", "map", "component", "far").mapInArrow(run, "a long, b long")


def chunked(members: DataFrame) -> DataFrame:
    """Adds ``_bucket`` and ``_side``. A bucket of at most ``CHUNK`` members is one task's (side 2: all against all).

    A larger one is cut by set size first: linked sets lie in the same size class or in neighbouring ones (a class
    spans a factor of ``SPAN``, more than sizes may differ), so a member meets chunks of its own class and of the two beside it, and nothing
    else. In a pair of chunks side 0 meets side 1."""
    whole = members.where(F.col("size") <= CHUNK).withColumns({"_bucket": F.xxhash64("key"), "_side": F.lit(2)})
    large = members.where(F.col("size") > CHUNK).withColumn("_class", F.floor(F.ln(F.col("n").cast("double")) / F.lit(log(SPAN))).cast("int"))
    chunks = saved(large.groupBy("key", "_class").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks")))
    own = F.pmod(F.xxhash64("rep"), F.col("_chunks")).cast("int")
    large = joined_small(large, chunks, ["key", "_class"]).withColumn("_own", own)

    def beside(shift: int) -> DataFrame:
        """Each member beside every chunk of the class ``shift`` away."""
        there = chunks.select("key", (F.col("_class") - shift).alias("_class"), F.col("_chunks").alias("_there"))
        return joined_small(large, there, ["key", "_class"]).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_there") - 1)))

    same = beside(0).withColumns({
        "_bucket": F.xxhash64("key", F.lit(0), "_class", F.least("_own", "_other"), F.greatest("_own", "_other")),
        "_side": F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int"))})
    lower = beside(1).withColumns({"_bucket": F.xxhash64("key", F.lit(1), "_class", "_own", "_other"), "_side": F.lit(0)})
    upper = beside(-1).withColumns({"_bucket": F.xxhash64("key", F.lit(1), F.col("_class") - 1, "_other", "_own"), "_side": F.lit(1)})
    cols = whole.columns
    return whole.unionByName(same.select(*cols)).unionByName(lower.select(*cols)).unionByName(upper.select(*cols))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows ``(_id, n, s1, s2)`` and the classes ``(s1, s2, component)``."""
    rows = saved(signed(docs, id_col, text_col))
    nodes = saved(rows.where("n > 0").groupBy("s1", "s2").agg(
        F.min(F.struct("_id", "n", "bands", "map")).alias("x")).select("s1", "s2", F.col("x._id").alias("rep"), "x.n", "x.bands", "x.map"))

    keys = nodes.select("rep", F.explode("bands").alias("key"))
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = saved(keys.join(shared, "key").select("key", "size", "rep").distinct())
    reach = members.groupBy("rep").agg(F.sum("size").alias("reach"))
    about = saved(nodes.select("rep", "n", "map").join(reach, "rep"))
    sets = saved(sets_of(docs, saved(about.select(F.col("rep").alias("_id")).distinct()), id_col, text_col))

    ranked = members.join(about.select("rep", "n", "reach"), "rep")
    hubs = saved(ranked.groupBy("key").agg(F.max(F.struct("reach", (-F.col("rep")).alias("low"), "n")).alias("h"))
                 .select("key", (-F.col("h.low")).alias("hub"), F.col("h.n").alias("hub_n")))
    spokes = saved(ranked.select("key", "size", "rep", "n").join(hubs, "key"))
    star = spokes.where((F.col("rep") != F.col("hub")) & sizes_allow("n", "hub_n"))
    star = confirmed(saved(star.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()), sets)
    links = star.where(linked()).select("a", "b")
    first = saved(components(links))

    # Buckets that hold more than one component, with each member's distance from the hub (unknown: not a bound).
    placed = spokes.join(first.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = saved(placed)
    open_ = saved(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    ends = [F.col("a"), F.col("b")]
    far = (1 - F.col("shared") / F.col("total")).alias("far")
    known = star.select(ends[0].alias("rep"), ends[1].alias("hub"), far).unionByName(star.select(ends[1].alias("rep"), ends[0].alias("hub"), far))
    rest = placed.join(open_, "key", "left_semi").join(saved(known), ["rep", "hub"], "left").join(about.select("rep", "map"), "rep")
    rest = rest.withColumn("far", F.when(F.col("rep") == F.col("hub"), 0.0).otherwise(F.coalesce("far", F.lit(float("nan")))))
    more = still_possible(chunked(rest)).distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(saved(more), sets).where(linked()).select("a", "b"))

    last = components(links).withColumnRenamed("node", "rep")
    return rows.select("_id", "n", "s1", "s2"), saved(
        nodes.select("s1", "s2", "rep").join(saved(last), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` per input row; the smallest id of each group is kept.

    Rows without an id are documents of their own, told apart by their texts: they link others, but never
    give a group its id. A group of such rows alone has a null ``component_id``, and one of its texts is kept."""
    if docs.where(F.col(id_col).isNull()).isEmpty():
        rows, known = classes(docs, id_col, text_col)
        out = rows.join(known, ["s1", "s2"], "left").withColumn("component", F.coalesce("component", "_id"))
        return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                          (F.col("_id") == F.col("component")).alias("kept"))
    # The node of a row is its id or, without one, a hash of its text.
    nameless = F.xxhash64(F.lit("no id"), F.col(text_col))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), nameless).alias("node"), F.col(id_col).isNull().alias("nameless"), F.col(text_col).alias("_text"))
    without = saved(ids.where("nameless").select("node", "nameless").distinct())
    rows, known = classes(ids.select("node", "_text"), "node", "_text")
    placed = joined_small(rows.join(known, ["s1", "s2"], "left"), without.withColumnRenamed("node", "_id"), ["_id"], "left")
    out = saved(placed.withColumns({"component": F.coalesce("component", "_id"), "real": F.when(F.col("nameless").isNull(), F.col("_id"))}))
    named = out.groupBy("component").agg(F.min("real").alias("component_id"), F.min("_id").alias("first"))
    out = out.join(saved(named), "component")
    kept = F.when(F.col("real").isNotNull(), F.col("real") == F.col("component_id")).otherwise(F.col("component_id").isNull() & (F.col("_id") == F.col("first")))
    return out.select(F.col("real").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, one row of each group of near-duplicates: one with the smallest id.

    Rows are told apart by id and text: where an id is null or repeated, each of its texts is a document of its own
    (its node is a hash; the nodes of other documents are their ids), and of rows equal in both one stays."""
    ids, whole = keyed(docs, id_col, text_col), packed(docs, id_col, text_col)
    several = ids.groupBy("_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("_id") == LAST_ID))
    several = saved(several.select("_id", F.lit(True).alias("_several")))
    unique = several.isEmpty()
    if not unique:
        ids, whole = (joined_small(x, several, ["_id"], "left") for x in (ids, whole))
    node = F.col("_id") if unique else F.when(F.col("_several"), F.xxhash64("_id", "_th")).otherwise(F.col("_id"))
    ids = ids.withColumn("node", node)

    rows, known = classes(ids.select("node", "_text"), "node", "_text")
    grouped = saved(rows.join(known, ["s1", "s2"]).select(F.col("_id").alias("node"), "component").distinct())
    groups = saved(grouped.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"))
    members = saved(grouped.join(groups, "component"))
    keys = saved(joined_small(ids.select("node", "_id", "_th"), members, ["node"]).distinct())
    first = saved(keys.groupBy("component").agg(F.min(F.struct("_id", "_th")).alias("x")).select("component", "x._id", "x._th"))
    gone = saved(keys.join(first, ["component", "_id", "_th"], "left_anti").select("_id", "_th").distinct())

    def kept(x: DataFrame) -> DataFrame:
        return joined_small(x, gone, ["_id", "_th"], "left_anti").select("_id", "_th", "_row")

    if unique:
        left = kept(whole)
    else:  # texts without words are no copies of each other
        words_ = F.coalesce(F.length(F.btrim(F.col("_row")[text_col], F.lit(WHITE))) > 0, F.lit(False))
        alike = F.coalesce("_several", F.lit(False)) & words_
        once = kept(whole.where(alike)).groupBy("_id", "_th").agg(F.first("_row").alias("_row"))
        left = kept(whole.where(~alike)).unionByName(once)
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
