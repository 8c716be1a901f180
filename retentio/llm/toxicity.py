"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of ASCII letters and of characters beyond ASCII, lower-cased) and their first four and six bytes. The terms of a bounded, documented sample of
labelled documents (``PER_CLASS`` of each class, chosen by a hash of the id) are all indexed. A term's weight is its idf,
counted over the whole corpus, times how strongly the sample ties it to the label: a soft factor, so no term is left out.
A document's nearest examples are found exactly: examples stand in blocks, postings are stored per term and block
beside their largest weight, and blocks are scored in the order of their upper bounds until none can hold a nearer example;
only postings of scored blocks are read. Terms that many examples hold are columns of a matrix instead of lists: their share of all
inner products of a batch of documents is one matrix product, and the bounds are tighter for knowing it. The neighbours vote with their cosine as weight, and a
logistic curve fitted on left-one-out votes turns votes into calibrated scores. The nearest examples are
returned as evidence. Scores depend on the text alone.

Plan: one scan counts in how many documents each indexed term stands, a second one scores (and, in
:func:`without_toxic`, filters) the rows where they are; nothing is shuffled but those counts. What reaches the driver is
bounded by the sample: its texts' terms and the document frequencies of these.

Defined cases: null, empty and word-free texts get the calibrated rate of word-free examples; labels that are null or not 0/1,
or whose document is missing, are not learnt from; of several texts with one labelled id the one with the smallest hash is the example;
repeated rows score alike; without labelled examples of both classes all scores are the share of class 1 (0 if there are none);
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import give_back, only, saved, small_batches, tidied

PER_CLASS = 512         # labelled examples taken of each class
PREFIXES = (4, 6)       # first letters of a word that are terms beside the word
HALF = (20.0, 0.02)     # chi-squared at which a term has half its idf as weight: at least, and per example
FLOOR = 0.02            # share of the idf that a term without any tie to the label keeps
NEIGHBOURS = 25
SHRINK = 0.1            # weight of the prior in a vote
BLOCK = 64              # examples per block of the index
COMMON = 1 / 32         # share of the examples from which a term is a column instead of a list
TOGETHER = 256          # documents whose common terms are multiplied out together
PIVOTS = 24             # examples around which alike ones are put into the same blocks
MAX_WORDS = 150_000     # words whose terms a worker remembers
MAX_SCORES = 5_000      # texts whose scores a worker remembers
THRESHOLD = 0.3
LETTER = re.compile(r"[^\W\d_]")
# ASCII other than letters ends a word; all other characters are part of one.
ENDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text in UTF-8; none if it holds no letter."""
    return text.lower().encode().translate(ENDS).split() if text and LETTER.search(text) else []


def word_terms(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for t in word_terms(word):
            out[t] += n
    return out


class TermIds(dict):
    """word -> numbers of its indexed terms."""

    def __init__(self, terms: list[bytes]) -> None:
        super().__init__()
        self.whole = {t: i for i, t in enumerate(terms) if t[-1:] != b"*"}
        self.first = [(n, {t[:-1]: i for i, t in enumerate(terms) if t[-1:] == b"*" and len(t) == n + 1}) for n in PREFIXES]

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = [self.whole[word]] if word in self.whole else []
        for n, known in self.first:
            if len(word) > n and (i := known.get(word[:n])) is not None:
                found.append(i)
        out = self[word] = tuple(found)
        return out

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The indexed terms of a text, in order, and how often each stands in it."""
        words = Counter(words_of(text))
        ids = list(map(self.__getitem__, words))
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        often = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, ids), np.int64, len(ids)))
        terms, at = np.unique(flat, return_inverse=True)
        return terms, np.bincount(at, weights=often, minlength=len(terms))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, list[int]]:
    """``(doc, label)`` of the examples, and the number of learnable labels of each class."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(label_col).cast("int").alias("label"))
    known = saved(known)
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc"), "doc").limit(PER_CLASS) for y in (0, 1)]
    return saved(some[0].unionByName(some[1])), [totals.get(0, 0), totals.get(1, 0)]


def examples_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> list:
    """``(doc, label, terms, counts)`` of the sample, at most ``2 * PER_CLASS`` rows."""

    def run(batches):
        for batch in batches:
            found = [sorted(term_counts(t).items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[t for t, _ in x] for x in found], pa.list_(pa.binary())),
                 pa.array([[n for _, n in x] for x in found], pa.list_(pa.int64()))], ["doc", "label", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc")
    one = rows.groupBy("doc", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("doc", "label", "x.text").mapInArrow(run, "doc long, label int, terms array<binary>, counts array<long>").collect()


def frequencies(docs: DataFrame, terms: list[bytes], text_col: str) -> tuple[np.ndarray, int]:
    """In how many rows each term stands, and the number of rows."""

    def run(batches):
        only("toxicity", Index.built.clear)
        ids, df = TermIds(terms), np.zeros(len(terms) + 1, np.int64)
        for batch in tidied(batches):
            for text in batch.column(0).to_pylist():
                df[ids.of(text)[0]] += 1
            df[-1] += batch.num_rows
        del ids
        give_back()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long")
    found = counts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def evidence_weights(rows: list, numbers: dict[bytes, int]) -> np.ndarray:
    """Share of its idf that each term keeps: near 1 where presence depends on the label, ``FLOOR`` where it does not."""
    seen, size = np.zeros((2, len(numbers))), np.zeros(2)
    for r in rows:
        seen[r["label"], [numbers[bytes(t)] for t in r["terms"]]] += 1
        size[r["label"]] += 1
    n = size.sum()
    spread = seen.sum(axis=0) * (n - seen.sum(axis=0)) * size.prod()
    chi2 = n * (seen[1] * size[0] - seen[0] * size[1]) ** 2 / np.where(spread > 0, spread, np.inf)
    return FLOOR + (1 - FLOOR) * chi2 / (chi2 + max(HALF[0], HALF[1] * n))


def grouped(rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """An order of the vectors in which alike ones stand together: each goes to the nearest of ``PIVOTS`` vectors, every one of
    which was the farthest from those before it. Blocks of alike examples have near bounds."""
    at = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    term, weight = (np.concatenate([x[k] for x in rows]) for k in (0, 1))
    best, own = np.full(len(rows), -1.0), np.zeros(len(rows), np.int64)
    for n in range(min(PIVOTS, len(rows))):
        t, w = rows[int(best.argmin()) if n else 0]
        dense = np.zeros(n_terms)
        dense[t] = w
        total = np.concatenate([[0.0], np.cumsum(weight * dense[term])])
        alike = total[at[1:]] - total[at[:-1]]
        own[alike > best] = n
        best = np.maximum(best, alike)
    return np.lexsort((np.arange(len(rows)), own))


class Index:
    """Unit vectors of the examples: postings by term and block with the largest weight of each such slice, and a matrix of the
    common terms. Only the vectors travel to the workers, each of which builds the index once."""

    built: dict[str, dict] = {}

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        who = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        term, weight = (np.concatenate([x[k] for x in rows]) if rows else np.zeros(0) for k in (0, 1))
        self.__setstate__((uuid.uuid4().hex, len(rows), n_terms, who.astype(np.int32), term.astype(np.int32), weight.astype(float)))

    def __getstate__(self) -> tuple:
        return self.key, self.size, self.n_terms, *self.given

    def __setstate__(self, state: tuple) -> None:
        if state[0] not in Index.built:
            Index.built.clear()
            self.key, self.size, self.n_terms, *self.given = state
            self.slice(*self.given)
            Index.built[self.key] = self.__dict__
        self.__dict__ = Index.built[state[0]]

    def slice(self, who: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.blocks = max(1, -(-self.size // BLOCK))
        held = np.bincount(term, minlength=self.n_terms)
        common = np.flatnonzero(held >= max(2, COMMON * self.size))
        self.column = np.full(self.n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        wide = self.column[term] >= 0
        self.matrix = np.zeros((len(common), self.blocks * BLOCK))
        self.matrix[self.column[term[wide]], who[wide]] = weight[wide]
        who, term, weight = who[~wide], term[~wide], weight[~wide]
        slices = term.astype(np.int64) * self.blocks + who // BLOCK
        order = np.lexsort((who, slices))
        self.who, self.weight, slices = who[order], weight[order], slices[order]
        self.start = np.zeros(self.n_terms * self.blocks + 1, np.int32)
        np.cumsum(np.bincount(slices, minlength=self.n_terms * self.blocks), out=self.start[1:])
        used, first = np.unique(slices, return_index=True)
        self.most = np.zeros(self.n_terms * self.blocks, np.float32)
        if len(used):
            self.most[used] = np.nextafter(np.maximum.reduceat(self.weight, first).astype(np.float32), np.float32(np.inf))
        self.most = self.most.reshape(self.n_terms, self.blocks)

    def sums(self, terms: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Inner products by the lists of the chosen blocks, as ``(block, place)``; no other posting is touched."""
        at = (terms[:, None] * self.blocks + chosen[None, :]).ravel()
        first = self.start[at]
        n = self.start[at + 1] - first
        some = np.flatnonzero(n)
        first, n, w = first[some], n[some], weights[some // len(chosen)]
        ends = np.cumsum(n)
        here = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        out = np.bincount(self.who[here], weights=self.weight[here] * np.repeat(w, n), minlength=self.blocks * BLOCK)
        return out.astype(float).reshape(self.blocks, BLOCK)[chosen]

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, leave: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`nearest` of each vector; example ``leave[i]`` takes no part for vector ``i``."""
        for lo in range(0, len(vectors), TOGETHER):
            part = vectors[lo:lo + TOGETHER]
            asked = np.zeros((len(part), len(self.matrix)))
            for i, (terms, weights) in enumerate(part):
                at = self.column[terms]
                asked[i, at[at >= 0]] = weights[at >= 0]
            shares = asked @ self.matrix
            for i, (terms, weights) in enumerate(part):
                rare = self.column[terms] < 0
                yield self.ranked(shares[i], terms[rare], weights[rare], k, leave[lo + i] if leave else -1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the highest positive cosine, ties to the smaller number, and their cosines."""
        return next(self.all_nearest([(terms, weights)], k, [leave]))

    def ranked(self, share: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, leave: int) -> tuple[np.ndarray, np.ndarray]:
        """``share``: what the common terms add to each inner product; ``terms``: the others."""
        share = share.reshape(self.blocks, BLOCK)
        bound = share.max(axis=1) + weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order) and not (len(ids) >= k and bound[order[at]] * (1 + 1e-6) < scores[k - 1]):
            chosen = np.sort(order[at:at + step])
            total = (share[chosen] + self.sums(terms, weights, chosen)).ravel()
            numbers = (chosen[:, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
            new = np.flatnonzero((total > 0) & (numbers != leave) & (total >= (scores[k - 1] if len(ids) >= k else 0)))
            ids, scores = np.concatenate([ids, numbers[new]]), np.concatenate([scores, total[new]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            at, step = at + step, step * 2
        return ids, scores


@dataclass
class Model:
    """What scoring needs: bounded by the sample."""

    terms: list[bytes]
    weight: np.ndarray
    index: Index | None
    docs: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float]
    prior: float
    empty: float

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return w / (np.sqrt((w * w).sum()) or 1.0)

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines * self.weights[ids]
        return float(((w * self.labels[ids]).sum() + SHRINK * self.prior) / (w.sum() + SHRINK))

    def told(self, ids: np.ndarray, cosines: np.ndarray) -> tuple[float, list[dict]]:
        """Score and evidence from the nearest examples."""
        a, b = self.curve
        seen = [{"doc_id": int(self.docs[i]), "cosine": float(c), "toxic": int(self.labels[i])} for i, c in zip(ids[:3], cosines[:3])]
        return float(1 / (1 + np.exp(-(a * logit(self.vote(ids, cosines)) + b)))), seen


def logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the votes' logits (Newton steps, small ridge)."""
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    beta = np.array([1.0, 0.0])
    w = weights / weights.mean() if len(weights) else weights
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - labels)) + 1.0 * (beta - [1.0, 0.0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(beta[0], 0.05)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """The model: all terms of the sample, their weights, the index and the calibration curve."""
    small_batches(docs.sparkSession)
    chosen, totals = sample(labels, label_id, label_col)
    rows = examples_of(docs, chosen, id_col, text_col)
    model = built(rows, totals, lambda terms: frequencies(docs, terms, text_col))
    # The driver needs no index beside the model's own, nor the sample's texts' terms.
    Index.built.clear()
    del rows
    give_back()
    return model


def built(rows: list, totals: list[int], counted: Callable[[list[bytes]], tuple[np.ndarray, int]]) -> Model:
    """The model of the sample; ``counted`` gives the document frequencies of its terms and the number of documents."""
    prior = totals[1] / max(1, sum(totals))
    if len({r["label"] for r in rows}) < 2:
        return Model([], np.zeros(0), None, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), (1.0, 0.0), prior, prior)
    terms = sorted({bytes(t) for r in rows for t in r["terms"]})
    numbers = {t: i for i, t in enumerate(terms)}
    df, n_docs = counted(terms)
    weight = np.log((2 + n_docs) / (1 + df)) * evidence_weights(rows, numbers)

    sparse = [(np.array([numbers[bytes(t)] for t in r["terms"]], np.int64), np.array(r["counts"], float)) for r in rows]
    model = Model(terms, weight, None, np.zeros(0), np.zeros(0), np.zeros(0), (1.0, 0.0), prior, prior)
    units = [(t, model.unit(t, c)) for t, c in sparse]
    order = grouped(units, len(terms)).tolist()
    rows, units = [rows[i] for i in order], [units[i] for i in order]
    y = np.array([r["label"] for r in rows], float)
    w = np.array([totals[r["label"]] / (y == r["label"]).sum() for r in rows])
    w = w / w.mean()
    none = np.array([not len(t) for t, _ in units], bool)
    model.docs, model.labels, model.weights, model.index = np.array([r["doc"] for r in rows], np.int64), y, w, Index(units, len(terms))
    votes = np.array([logit(model.vote(*found)) for found in model.index.all_nearest(units, NEIGHBOURS, list(range(len(units))))])
    model.curve = fit_curve(votes[~none], y[~none], w[~none])
    model.empty = float(((w * y)[none].sum() + SHRINK * prior) / (w[none].sum() + SHRINK))
    return model


def scores(model: Model, texts: list[str | None], ids: TermIds, known: dict) -> list[tuple[float, list[dict]]]:
    """Score and evidence of each text; equal texts met before are not searched again."""
    if model.index is None:
        return [(model.prior, [])] * len(texts)
    keys = [xxhash.xxh3_128_digest((t or "").encode()) for t in texts]
    new = {key: t for key, t in zip(keys, texts) if key not in known}
    found = {key: known[key] for key in keys if key in known}
    searched = {key: ids.of(t) for key, t in new.items() if t and LETTER.search(t)}
    found |= {key: (model.empty, []) for key in new if key not in searched}
    nearest = model.index.all_nearest([(t, model.unit(t, c)) for t, c in searched.values()], NEIGHBOURS)
    found |= {key: model.told(*x) for key, x in zip(searched, nearest)}
    if len(known) + len(new) > MAX_SCORES:
        known.clear()
    known.update({key: found[key] for key in new})
    return [found[key] for key in keys]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``(id_col, held_out, score, predicted, evidence)`` per input row."""
    model = fit(docs, labels, id_col, text_col, label_id, label_col)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        only("toxicity", Index.built.clear)
        ids, known = TermIds(model.terms), {}
        for batch in tidied(batches):
            out = scores(model, batch.column(1).to_pylist(), ids, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], kind)],
                                             ["doc", "score", "evidence"])
        del ids, known
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    return scored.withColumnRenamed("doc", id_col).select(
        id_col, held_out(id_col).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """The documents, with all their columns, that score below ``THRESHOLD``: filtered in the pass that scores them."""
    model = fit(docs, labels, id_col, text_col, label_id, label_col)
    at = docs.columns.index(text_col)

    def run(batches):
        only("toxicity", Index.built.clear)
        ids, known = TermIds(model.terms), {}
        for batch in tidied(batches):
            good = [s < THRESHOLD for s, _ in scores(model, batch.column(at).to_pylist(), ids, known)]
            yield batch.filter(pa.array(good, pa.bool_()))
        del ids, known
        give_back()

    return docs.mapInArrow(run, docs.schema)
