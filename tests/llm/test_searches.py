"""Searches over integer vectors: exact products of any size, ties, and tables of blocks that are never broadcast."""

from collections import Counter

import numpy as np
import pytest

from retentio.llm import negatives, products, topk


def broadcast_types(df):
    """Types of the columns that the plan of ``df`` broadcasts."""
    out, plan = set(), df._jdf.queryExecution().executedPlan()
    todo = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("BroadcastExchange"):
            out |= {node.output().apply(i).dataType().catalogString() for i in range(node.output().size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def saving(monkeypatch, module):
    """The plans of what ``module`` saves."""
    plans, whole = [], module.saved

    def saved(df):
        plans.append(broadcast_types(df))
        return whole(df)

    monkeypatch.setattr(module, "saved", saved)
    return plans


@pytest.fixture
def repeated(spark):
    """300 vectors, each eight times: its blocks compress well."""
    rng = np.random.default_rng(6)
    base = (rng.normal(size=(300, 16)) / 4).astype(np.float32).tolist()
    return spark.createDataFrame([(i, base[i % 300], i % 3) for i in range(2400)], "vec_id long, embedding array<float>, label int")


def test_topk_broadcasts_no_blocks(repeated, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    plans = saving(monkeypatch, topk)
    got = topk.search(repeated).collect()
    v = {r.vec_id: np.floor(np.array(r.embedding) * 1024).astype(np.int64) for r in repeated.collect()}
    ids, x = np.array(list(v)), np.stack(list(v.values()))
    want = Counter()
    for q in (i for i in v if i % 100 == 0):
        s = x @ v[q]
        want.update((q, n, int(ids[j]), int(s[j])) for n, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != q][:10], 1))
    assert Counter(map(tuple, got)) == want
    assert len(plans) > 6 and not any("binary" in x for types in plans for x in types)


@pytest.mark.parametrize("scale, kind", [(4, np.float32), (2000, np.float64), (1 << 27, np.int64)])
@pytest.mark.parametrize("decay", [1.0, 0.5])
def test_best_of_blocks_is_exact(scale, kind, decay):
    """Ties, floors and all types, with a bound that rules out much (coordinates that fall off) or nothing."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(900, 8)) * decay ** np.arange(8) * 3).astype(np.int64) * scale
    x[300:500] = x[100]                                  # a crowd of copies
    ids = np.sort(rng.permutation(5000)[:900])
    q_ids = np.concatenate([ids[::7], [5001, 5002]])
    q = np.concatenate([x[::7], x[100:101], x[3:4] * 0])
    reach = products.longest(x)
    assert products.kind(products.longest(q) * reach) is kind
    s = (q.astype(object) @ x.T.astype(object)).astype(np.int64)
    basis = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    met = [(ids[lo:lo + 64], x[lo:lo + 64]) for lo in range(0, 900, 64)]
    for floors in (np.full(len(q), -np.inf), np.sort(s, axis=1)[:, -3].astype(float)):
        got = set(zip(*(c.tolist() for c in topk.best_of(q_ids, q, floors, met, reach, basis, 10))))
        whole, reached = set(), set()
        for i, own in enumerate(q_ids.tolist()):
            some = [j for j in np.lexsort((ids, -s[i])) if ids[j] != own][:10]
            whole |= {(own, int(ids[j]), int(s[i, j])) for j in some}
            reached |= {(own, int(ids[j]), int(s[i, j])) for j in some if s[i, j] >= floors[i]}
        assert reached <= got <= whole


def test_scores_beyond_64_bits_are_an_error():
    x = np.full((2, 4), 1 << 40, np.int64)
    with pytest.raises(OverflowError):
        products.products(x, x, np.int64)


def test_blocks_of_vectors_keep_their_integers():
    for top in (1, 32767, 32768, 2**31 - 1, 2**31, 2**63 - 1):
        x = np.array([[top, -top, 0], [1, 2, 3]], np.int64)
        _, back = products.unpack(np.arange(2).tobytes(), products.narrow(x), 3)
        assert (back == x).all()


def mined(ids, labels, x, every):
    """Rows of the mining, from all products."""
    out = Counter()
    for a in np.flatnonzero(ids % every == 0):
        s = (x.astype(object) @ x[a].astype(object)).astype(np.int64)
        ranked = [j for j in np.lexsort((ids, -s)) if j != a]
        for p in [j for j in ranked if labels[j] == labels[a]][:5]:
            fits = [j for j in ranked if labels[j] != labels[a] and 30 * int(s[p]) <= 100 * int(s[j]) <= 90 * int(s[p])][:10]
            out.update((int(ids[a]), int(ids[p]), n, int(ids[j]), int(s[p]), int(s[j])) for n, j in enumerate(fits, 1))
    return out


def test_mining_broadcasts_no_blocks(repeated, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    plans = saving(monkeypatch, negatives)
    got = negatives.mine(repeated).collect()
    rows = repeated.collect()
    x = np.floor(np.array([r.embedding for r in rows]) * 256).astype(np.int64)
    assert Counter(map(tuple, got)) == mined(np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), x, 100)
    assert len(plans) > 6 and not any("binary" in x for types in plans for x in types)


@pytest.mark.parametrize("scale, kind", [(4, np.float32), (2000, np.float64), (1 << 26, np.int64)])
@pytest.mark.parametrize("many", [2, 40])
def test_mining_a_cell_is_exact(scale, kind, many):
    """Ties, crowds, few and many labels, and floors from other cells."""
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(700, negatives.DIRECTIONS)) * 3 + 1).astype(np.int64) * scale
    x[200:400] = x[100]
    ids, labels = np.sort(rng.permutation(5000)[:700]), rng.integers(0, many, 700)
    length = np.sqrt(np.square(x.astype(float)).sum(axis=1))
    angles = np.arccos(x.astype(float) / np.where(length > 0, length, 1)[:, None])
    spread = np.array([length.max(), *angles.min(axis=0), *angles.max(axis=0)]).tobytes()
    s = (x.astype(object) @ x.T.astype(object)).astype(np.int64)
    met = [(ids[lo:lo + 64], labels[lo:lo + 64], x[lo:lo + 64]) for lo in range(0, 700, 64)]
    own = np.arange(0, 700, 7)
    positives, scores = np.full((len(own), 5), -1), np.full((len(own), 5), np.nan)
    windows = {}
    for n, a in enumerate(own):
        best = [j for j in np.lexsort((ids, -s[a])) if labels[j] == labels[a] and j != a][:5]
        positives[n, :len(best)], scores[n, :len(best)] = ids[best], s[a, best]
        for p in best:
            windows[n, int(ids[p])] = [j for j in np.lexsort((ids, -s[a])) if labels[j] != labels[a]
                                       and 30 * int(s[a, p]) <= 100 * int(s[a, j]) <= 90 * int(s[a, p])][:10]
    anchor = {"ids": ids[own].tobytes(), "labels": labels[own].tobytes(), "data": products.narrow(x[own]), "lengths": length[own].tobytes(),
              "angles": angles[own].tobytes(), "positives": positives.tobytes(), "scores": scores.tobytes()}
    a = negatives.Anchors([anchor], x.shape[1])
    assert products.kind(products.longest(a.data) * length.max()) is kind
    got = set(zip(*(c.tolist() for c in negatives.positives_of(a, spread, met))))
    assert got == {(int(ids[own[n]]), int(i), int(v)) for n in range(len(own)) for i, v in zip(positives[n], scores[n]) if i >= 0}
    for at in (None, 4):  # without floors, and with the score of the fifth of each window
        floor = np.full(scores.shape, -np.inf)
        for (n, p), fits in windows.items():
            if at is not None and len(fits) > at:
                floor[n, positives[n] == p] = s[own[n], fits[at]]
        a.floors = floor
        whole = {(int(ids[own[n]]), p, int(ids[j]), int(s[own[n], np.searchsorted(ids, p)]), int(s[own[n], j])): floor[n, positives[n] == p][0]
                 for (n, p), fits in windows.items() for j in fits}
        got = set(zip(*(c.tolist() for c in negatives.negatives_of(a, spread, met))))
        assert {r for r, f in whole.items() if r[4] >= f} <= got <= set(whole)


def test_spots_are_what_nonzero_has():
    rng = np.random.default_rng(11)
    for shape in ((0, 5), (5, 0), (1, 1), (7, 9), (16, 24), (64, 128)):
        for share in (0, 0.001, 0.05, 0.9, 1):
            fit = rng.random(shape) < share
            assert all((a == b).all() for a, b in zip(products.spots(fit), np.nonzero(fit), strict=True))
            assert all((a == b).all() for a, b in zip(products.spots(fit.T), np.nonzero(fit.T), strict=True))
