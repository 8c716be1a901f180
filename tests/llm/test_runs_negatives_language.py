"""Periodic runs, hard negatives and language identification against brute force, enumeration and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retentio.llm import language, negatives, runs

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---------------------------------------------------------------- periodic runs

def runs_by_force(words):
    out, n = {}, len(words)
    for d in range(1, n // 4 + 1):
        lo = 0
        while lo + d < n:
            hi = lo
            while hi + d < n and words[hi] == words[hi + d]:
                hi += 1
            if hi > lo and hi + d - lo >= max(6, 4 * d):
                out.setdefault((lo, hi + d), d)
            lo = hi + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


pieces = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=13), st.integers(1, 9)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from("ab"), max_size=90), pieces.map(lambda x: [c for u, n in x for c in u * n][:200])), st.data())
def test_runs_equal_brute_force_however_the_words_arrive(words, data):
    want = runs_by_force(words)
    assert runs.runs_of([w.encode() for w in words]) == want
    machine, numbers = runs.SquareCatchers(), np.array([ord(w) for w in words], np.int64)
    at = 0
    while at < len(numbers):
        step = data.draw(st.sampled_from([1, 1, 2, 5, 40]))
        machine.append(numbers[at:at + step])
        at += step
        if at % 7 == 0:
            assert machine.runs() == runs_by_force(words[:at])
    assert machine.runs() == want


def test_long_runs_of_long_periods():
    rng = np.random.default_rng(3)
    machine = runs.SquareCatchers()
    machine.append(np.concatenate([rng.integers(0, 50, 1000), np.tile(rng.integers(0, 500, 9001), 5), np.zeros(70_000, np.int64)]))
    got = machine.runs()
    assert (46005, 70_000, 1) in [(s, n, q) for s, n, q in got] or any(q == 1 and n >= 70_000 for _, n, q in got)
    assert any(q == 9001 and n >= 45_005 for _, n, q in got)
    assert len([1 for _, n, q in got if q > 50]) == 1


def planted(doc, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def summary_by_force(doc, text):
    words = planted(doc, text)
    found = runs_by_force(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc, len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "repetitive"])
def test_run_summaries(which, request, spark):
    if which == "repetitive":
        rnd = random.Random(5)
        rows = [(i, " ".join(rnd.choice("abcdé") + rnd.choice(["", ".", "x"]) for _ in range(rnd.randint(0, 250)))) for i in range(60)]
        rows += [(100 + i, " la la\tla la la la la la fin\n" * i) for i in range(5)] + [(7, "o " * 9), (None, "o " * 9), (None, "o " * 9)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(which)
    got = runs.summary(runs.periodic_runs(runs.with_planted_tails(docs)))
    assert Counter(map(tuple, got.collect())) == Counter(summary_by_force(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


# ---------------------------------------------------------------- hard negatives

def mined_by_force(rows, every):
    v = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        row = (label, [int(np.floor(256 * float(np.float32(c)))) for c in x])
        v[i] = min(v.get(i, row), row)
    score = lambda a, b: sum(p * q for p, q in zip(v[a][1], v[b][1]))
    out = []
    for a in v:
        if a % every:
            continue
        ranked = sorted(((-score(a, b), b) for b in v if b != a))
        for p, positive in [x for x in ranked if v[x[1]][0] == v[a][0]][:5]:
            fits = [x for x in ranked if v[x[1]][0] != v[a][0] and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(a, positive, k, b, -p, -s) for k, (s, b) in enumerate(fits, 1)]
    return Counter(out)


def embedding_rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.3).tolist(), int(rng.integers(0, 4)) if i % 3 else 1) for i in range(600)]
    rows += [(i, rows[0][1], 2) for i in range(600, 660)]                               # copies: ties
    rows += [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")], 1), (703, [float("inf")], 1), (704, [1.0], None), (None, [1.0], 1),
             (720, [], 1), (740, [0.5, -0.5], 1), (760, [0.0] * 12, 3), (0, rows[1][1], 1), (0, rows[0][1], rows[0][2])]
    return rows


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rows = embedding_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, score string, range int")
    got = negatives.mine(frame, every=20)
    assert Counter(map(tuple, got.collect())) == mined_by_force(rows, 20)
    assert negatives.mine(frame.limit(0)).count() == 0
    assert negatives.mine(frame.where("vec_id = 0")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 8))
def test_intervals_hold_every_score(seed, spread):
    rng = np.random.default_rng(seed)
    x, refs = np.floor(rng.normal(size=(40, 5)) * spread * 20), np.linalg.qr(rng.normal(size=(5, 5)))[0][:, :3]
    x[0] = 0
    length = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip(x @ refs / np.where(length > 0, length, 1)[:, None], -1, 1))
    lower, upper = negatives.intervals(length, angles, angles, length, angles, angles)
    assert ((lower <= x @ x.T) & (x @ x.T <= upper)).all()
    lower, upper = negatives.range_bounds({"longest": length[:20].max(), "low": angles[:20].min(0).tolist(), "high": angles[:20].max(0).tolist()},
                                          {"longest": length[20:].max(), **{f"l{i}": v for i, v in enumerate(angles[20:].min(0))}, **{f"h{i}": v for i, v in enumerate(angles[20:].max(0))}})
    part = x[:20] @ x[20:].T
    assert lower <= part.min() and part.max() <= upper


def test_narrow_clusters_are_ruled_out_by_their_angles():
    """Rows near a direction other than the anchor's are ruled out without a product."""
    rng = np.random.default_rng(2)
    x = np.concatenate([[100, 0, 0] + rng.normal(size=(50, 3)), [0, 100, 0] + rng.normal(size=(50, 3))])
    refs = np.eye(3)[:, :2]
    length = np.linalg.norm(x, axis=1)
    angles = np.arccos(x @ refs / length[:, None])
    _, upper = negatives.intervals(length, angles, angles, length, angles, angles)
    assert (upper[:50, 50:] < 0.3 * 100 * 100).all() and (upper[:50, :50] > 0.9 * 100 * 100).all()


# ---------------------------------------------------------------- language identification

TINY = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4, b"aba": 5, b"c": 6, b"bc": 7, b" abc": 8, b"ca": 9, b"7": 10, b"A": 11}


def cuts(word, tokens):
    if not word:
        yield []
    for i, t in enumerate(tokens, 1):
        if word.startswith(t):
            for rest in cuts(word[len(t):], tokens):
                yield [i, *rest]


@pytest.mark.parametrize("span", [2, 5, 12])
def test_sums_and_expectations_equal_enumeration(monkeypatch, span):
    monkeypatch.setattr(language, "SPAN", span)
    pieces_, tokens = language.Pieces(TINY), [t for t in TINY if t not in (b"7", b"A")]
    assert pieces_.size == len(tokens)
    p = np.random.default_rng(0).random((pieces_.size + 1, 2))
    p[0] = 0
    p /= p.sum(axis=0)
    words = [b"a", b"ab", b"abc", b"ba", b"aab", b"cab", b"abab", b"bbbbbbbbb", b"abcabcab", b"abcabcabcabca", b"ab"]
    got, often = language.log_sums(pieces_, words, p), np.arange(1, len(words) + 1)
    for k in range(2):
        want, uses = [], np.zeros(pieces_.size + 1)
        for w, n in zip(words, often):
            ways = list(cuts(b" " + w, tokens))
            share = np.array([np.prod(p[c, k]) for c in ways])
            want.append(np.log(share.sum()))
            for c, s in zip(ways, share / share.sum()):
                np.add.at(uses, c, s * n)
        assert np.allclose(got[:, k], want)
        assert np.allclose(language.expected(pieces_, words, often, p[:, k]), uses)


def test_very_long_words_do_not_vanish():
    pieces_ = language.Pieces(TINY)
    p = np.full((pieces_.size + 1, 1), 1e-9)
    sums = language.log_sums(pieces_, [b"c" * 3000, b"c"], p)[:, 0]
    assert np.isclose(sums[0], 3001 * np.log(1e-9)) and np.isclose(sums[1], 2 * np.log(1e-9))
    assert np.isclose(language.expected(pieces_, [b"c" * 1000], np.array([3]), p[:, 0]).sum(), 3003)


SYLLABLES = {"en": ["the", "ing", "tion", "wh", "th", "er"], "fr": ["eau", "é", "qu", "oi", "ç", "er"], "de": ["sch", "ung", "ö", "keit", "ei", "er"], "el": ["και", "των", "ος", "μα"]}


def language_rows(n=300):
    rnd = random.Random(4)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 40))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def test_languages_of_held_out_documents(spark, no_docs):
    rows = language_rows()
    odd = [(900, None, "en"), (901, "", "fr"), (902, "12 + 3!", "de"), (903, "Wing thething", None), (None, "schung keitung", "en"),
           (5, rows[5][1], rows[5][2]), (904, "x" * 5000, "en"), (905, "漢字 " * 50, "en")]
    frame = spark.createDataFrame([(*r, 0.5, 1) for r in rows + odd], "doc_id long, text string, lang string, score double, id int")
    got = language.identify(frame, VOCABULARY).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i, *_ in rows + odd if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: la for i, _, la in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert {(by_id[i].lang_pred, by_id[i].score) for i in (900, 901, 902)} == {("und", 0.0)}
    assert by_id[903].lang_pred == "en" and by_id[None].lang_pred == "de"
    assert all(abs(sum(r.posterior.values()) - 1) < 1e-9 and r.score == max(r.posterior.values()) for r in got if r.lang_pred != "und")
    assert language.identify(frame.limit(0), VOCABULARY).count() == 0


def test_scores_do_not_depend_on_what_a_worker_remembers(monkeypatch):
    pieces_, rnd = language.pieces_of(open(VOCABULARY, "rb").read()), random.Random(6)
    p = np.random.default_rng(1).random((pieces_.size + 1, 3))
    p[0] = 0
    model = language.Model(["a", "b", "c"], p / p.sum(axis=0), np.zeros(3))
    texts = [" ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 80))) for _ in range(60)] + [None, "1 2", "Ab-c D"]
    want = list(language.Scorer(model, pieces_).texts(texts))
    monkeypatch.setattr(language, "MAX_WORDS", 90)
    monkeypatch.setattr(language, "PART", 40)
    small, got = language.Scorer(model, pieces_), []
    for lo in range(0, len(texts), 7):
        got += small.texts(texts[lo:lo + 7])
    assert all((a is None) == (b is None) and (a is None or np.allclose(a, b)) for a, b in zip(got, want)) and want[-3] is want[-2] is None
    assert np.allclose(want[-1], language.log_sums(pieces_, [b"ab", b"c", b"d"], model.p).sum(axis=0))


def test_held_out_labels_are_not_learnt_from(spark):
    """The languages of held-out rows, and of rows without an id, change nothing."""
    rows = language_rows(60)
    def predicted(change):
        some = [(i, t, "xx" if change and (i is None or zlib.crc32(str(i).encode()) % 5 == 0) else la) for i, t, la in [*rows, (None, "the wing", "en")]]
        return sorted((r.doc_id or -1, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(some, "doc_id long, text string, lang string"), VOCABULARY).collect())
    assert predicted(False) == predicted(True)


def test_nothing_to_learn_from(spark):
    got = language.identify(spark.createDataFrame([(1, "the wing", None), (2, None, "en")], "doc_id long, text string, lang string"), VOCABULARY).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
