"""Line dedup, passage dedup, near-duplicates, decontamination and sharding against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retentio.llm import common, decontaminate, line_dedup, near_dedup, sharding, substring_dedup
from retentio.llm.minhash import MAP_BITS, band_keys, parity_map
from retentio.llm.tokens import shingle_set

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collected(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def rank(i):
    return (i is None, i or 0)


def synthetic(seed=5, n=120):
    """Documents that share passages, lines and near copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioustr") for _ in range(rnd.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rnd.randint(40, 90))) for _ in range(6)]
    base = [word() for _ in range(150)]
    docs = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            words = [w if rnd.random() > 0.02 * (i % 7) else word() for w in base]
            docs.append((i, " ".join(words)))
        else:
            parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(3)]
            if kind == 1:
                parts.insert(1, rnd.choice(passages))
            docs.append((i, "\n".join(parts)))
    docs += [(n + 1, docs[0][1]), (n + 2, docs[1][1])]
    rnd.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(synthetic(), "doc_id long, text string")


# ---------------------------------------------------------------- lines

def lines_by_force(docs):
    white = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[line.strip(white).translate(LOWER)].add(rank(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(white).translate(LOWER)) >= 10 and min(held[k]) < rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("which", ["odd_docs", "mixed", "no_docs"])
def test_line_dedup(which, request):
    docs = request.getfixturevalue(which)
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(map(tuple, got)) == lines_by_force(collected(docs))


def test_line_bitmaps_and_whole_rows(odd_docs):
    out = line_dedup.without_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns
    assert Counter(r.text or "" for r in out.collect()) == Counter(t for _, _, _, t in lines_by_force(collected(odd_docs)).elements())
    runs = {r.doc_id: r.drop_runs for r in line_dedup.dedup_lines(odd_docs).collect()}
    assert [tuple(x) for x in runs[2]] == [(0, 1)] and runs[1] is None


def test_hot_line_takes_the_other_path(spark, monkeypatch):
    docs = [(i, f"the line that everybody holds\nown line of document {i}") for i in range(400)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect())) == lines_by_force(docs)
    rows = common.saved(line_dedup.line_rows(common.keyed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"), 10))
    assert common.crowded_slices(rows, "h1")


# ---------------------------------------------------------------- passages

def passages_by_force(docs, width=50):
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            s = tuple(w[k:k + width])
            first[s] = min(first.get(s, rank(i)), rank(i))
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < rank(i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


def test_cover_is_a_difference_cover():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))


@pytest.mark.parametrize("which", ["odd_docs", "mixed", "no_docs"])
def test_passage_dedup(which, request):
    docs = request.getfixturevalue(which)
    got = substring_dedup.dedup_passages(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == passages_by_force(collected(docs))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=0, max_size=120), st.integers(1, 60))
def test_rolling_hash_depends_on_the_window_alone(values, width):
    h = np.array(values, np.uint64)
    out = substring_dedup.rolling(h, width, 0)
    assert len(out) == max(0, len(h) - width + 1)
    for k in range(len(out)):
        assert out[k] == substring_dedup.rolling(h[k:k + width].copy(), width, 0)[0]


# ---------------------------------------------------------------- near-duplicates

def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups_by_force(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if docs[a][0] == docs[b][0] and docs[a][0] is not None or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[root(k)] = min(low.get(root(k), rank(i)), rank(i))
    out = []
    for k, (i, _) in enumerate(docs):
        c = low[root(k)]
        out.append((i, len(sets[k]), None if c[0] else c[1], c == rank(i)))
    return Counter(out)


@pytest.mark.parametrize("which", ["odd_docs", "mixed", "no_docs"])
def test_near_duplicates(which, request):
    docs = request.getfixturevalue(which)
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == groups_by_force(collected(docs))


def test_links_past_the_hub(spark, monkeypatch):
    """A chain of edits: neighbours are similar, the ends and most hubs are not; big buckets are dealt as chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK", 5)
    words = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(40):
        words = words[5:] + [f"n{i}_{k}" for k in range(5)]
        docs.append((100 - i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == groups_by_force(docs)
    assert len({r.component_id for r in got}) == 1


def test_rows_without_an_id_link_but_are_not_one_document(spark):
    text = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcd"}
    rows = [(1, text["a"]), (2, text["b"]), (None, text["a"] + " end"), (None, text["b"] + " end"), (None, text["c"]), (None, text["c"]),
            (None, text["c"] + " end"), (None, None), (2**63 - 1, text["d"]), (None, "few words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(1, 1, True), (2, 2, True), (2**63 - 1, 2**63 - 1, True)}
    nameless = Counter((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None)
    kept_c = [r for r in got if r.doc_id is None and r.component_id is None and r.n_shingles > 10 and r.kept]
    assert nameless[57, 1, False] == nameless[57, 2, False] == 1 and nameless[0, None, True] == 1 and nameless[1, None, True] == 1
    assert len({r.n_shingles for r in kept_c}) == 1 and sum(nameless.values()) == 7


def test_chunks_meet_only_where_sizes_allow_a_link(spark, monkeypatch):
    """A crowded bucket of unlike sizes: every pair that sizes allow shares one chunk pair, and few others do."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    sizes = [5 + i * 2 for i in range(500)]
    members = spark.createDataFrame([(7, 500, i, n) for i, n in enumerate(sizes)], "key long, size long, rep long, n long")
    seen = {}
    for r in near_dedup.chunked(members).collect():
        seen.setdefault(r._bucket, []).append((r.rep, r._side))
    met = Counter(tuple(sorted((a, b))) for rows in seen.values() for (a, x), (b, y) in itertools.combinations(rows, 2) if x != y or x == 2)
    possible = {(a, b) for a, b in itertools.combinations(range(500), 2) if 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b])}
    assert possible <= set(met) and set(met.values()) == {1}
    assert len(met) < 3 * len(possible) and sum(map(len, seen.values())) < 500 * 500 / 16


def test_one_of_each_keeps_rows_whole(odd_docs):
    out = near_dedup.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, 8, None}


def test_one_of_each_tells_null_and_repeated_ids_apart(spark):
    text = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"}
    rows = [(1, text["a"]), (None, text["a"] + " end"), (None, text["b"]), (2, text["c"]), (3, text["c"] + " end"), (3, text["d"]),
            (None, text["e"]), (None, text["e"]), (None, text["e"] + " end"), (4, text["f"]), (4, text["f"]), (5, None), (5, None), (None, " "), (None, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dedup.one_of_each(frame).collect()]
    e = [r for r in got if r[1] and r[1].startswith("e0")]
    assert len(e) == 1 and e[0][0] is None
    assert Counter(r for r in got if r not in e) == Counter(
        [(1, text["a"]), (None, text["b"]), (2, text["c"]), (3, text["d"]), (4, text["f"]), (5, None), (5, None), (None, " "), (None, " ")])


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True), st.data())
def test_parity_maps_bound_the_difference(values, data):
    cut = data.draw(st.integers(0, len(values)))
    a, b = np.unique(np.array(values, np.uint64)), np.unique(np.array(values[cut:] or values, np.uint64))
    bits = int(np.bitwise_count(parity_map(a) ^ parity_map(b)).sum())
    assert len(parity_map(a)) * 8 == MAP_BITS and bits <= len(np.setxor1d(a, b))


def test_signature_agreement_estimates_similarity():
    words = [f"a{i}" for i in range(400)]
    a, b = shingle_set(" ".join(words)), shingle_set(" ".join(words[:-40] + [f"b{i}" for i in range(40)]))
    assert len(set(band_keys(a)) & set(band_keys(b))) > 5
    assert not set(band_keys(a)) & set(band_keys(shingle_set(" ".join(f"c{i}" for i in range(400)))))


# ---------------------------------------------------------------- decontamination

def test_decontamination(spark, mixed):
    rnd = random.Random(2)
    docs = collected(mixed)
    texts = [t.split() for _, t in docs if len(t.split()) > 60]
    items = [(k, " ".join(texts[k][5:5 + rnd.randint(6, 40)]).upper()) for k in range(12)]
    # damaged items around the threshold, and the odd ones
    items += [(20 + k, " ".join(w if i % 17 else "changed" for i, w in enumerate(texts[k][:40]))) for k in range(6)]
    items += [(30, None), (31, ""), (32, "one two three"), (33, " ".join(texts[0][5:30])), (33, " ".join(texts[0][5:30])), (None, " ".join(texts[1][2:30]))]
    docs += [(900, "one two three"), (901, "zero one two three four"), (902, None), (903, " ".join(texts[0] * 30))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    sets = lambda t: {tuple(x) for x in shingles((t or "").lower())}
    want = set()
    for d, t in docs:
        have = sets(t)
        for i, u in items:
            s = sets(u)
            if s and 100 * len(s & have) >= 75 * len(s):
                want.add((d, i, len(s), len(s & have)))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == want
    assert got.count() == len(want) and any(w[3] < w[2] for w in want)


def test_contaminated_documents_go(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    out = decontaminate.without_contaminated(odd_docs, items)
    assert out.columns == odd_docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([2, 2, 3, 4, 5, 6, 7, None])
    assert decontaminate.find_contamination(no_docs, items).count() == 0
    assert decontaminate.find_contamination(odd_docs, items.limit(0)).count() == 0


# ---------------------------------------------------------------- sharding

def least_capacity(sizes, shards):
    lo, hi = max(sizes, default=0), sum(sizes)
    while lo < hi:
        mid, used, room = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("which", ["odd_docs", "mixed", "no_docs", "hot"])
def test_sharding(which, request, spark):
    if which == "hot":
        docs = spark.createDataFrame([(i, "the same text" * 9 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(900)], "doc_id long, text string")
    else:
        docs = request.getfixturevalue(which)
    rows = collected(docs)
    got = sharding.shard_documents(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    groups = {}
    for i, t in rows:
        key = (t or "").encode()
        first, size = groups.get(key, (rank(i), 0))
        groups[key] = (min(first, rank(i)), size + len(key) + 1)
    ordered = sorted((first, hashlib.md5(key).digest(), size) for key, (first, size) in groups.items())
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values(), default=0) <= least_capacity([s for *_, s in ordered], 8)
    by_crc = defaultdict(set)
    for r in got:
        by_crc[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in by_crc.values())
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200), st.integers(1, 9))
def test_capacity_search_refines_to_the_exact_answer(sizes, shards):
    """The driver's search over block summaries, with the Spark scan replaced by a list."""
    ends = list(itertools.accumulate(sizes))

    class Listed(sharding.Ends):
        def refine(self, stretches):
            for lo, hi in stretches:
                step = max(1, -(-(hi - lo) // 4))
                blocks = defaultdict(list)
                for e in ends:
                    if lo < e < hi:
                        blocks[(e - lo) // step].append(e)
                self.dark = sorted([d for d in self.dark if d != (lo, hi)] + [(min(b), max(b)) for b in blocks.values() if len(b) > 2])
                self.known = sorted({*self.known, *(f(b) for b in blocks.values() for f in (min, max))})

    search = Listed(None, ends[-1])
    assert search.capacity(shards) == least_capacity(sizes, shards)
    cuts = [0, *Listed(None, ends[-1]).cuts(shards), ends[-1]]
    assert set(cuts) <= {0, *ends}
    assert max(b - a for a, b in itertools.pairwise(cuts)) <= least_capacity(sizes, shards)
