"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public byte-level vocabulary. Each language has a probability for every piece; the probability of a word (a
space and a run of lower-cased letters) is the sum over all ways to cut it into pieces, found by the forward
algorithm, and a text's is the product over its words. Piece probabilities are learnt by expectation-maximisation: the
forward and backward sums of each word give the expected number of times each piece is used.

Learning counts every word of every learnable document by language, pre-aggregated in the tasks, so the table has a
row per different word and each round of EM meets each of them once; no sample is taken. The temperature of the
posterior is fitted on a bounded sample (``SAMPLE`` documents, chosen by a hash of the id).

Plan: one pass writes the word counts (their shuffle holds different words, not texts); each round reads that table and sums
expected counts per language and piece; one more pass scores the texts where they are. Words are taken through the
lattice in numpy batches of equal length, and a worker remembers the sums of the words it met. What reaches the
driver is the model: languages times pieces.

Defined cases: a text that is null or without a letter is ``und`` with score 0; so is every text if nothing can be learnt; null languages
and rows without an id are not learnt from; ties go to the first language by name; words of any length are summed with
rescaling; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.bpe import _read, parse_ranks
from retentio.llm.common import only, saved, small_batches

ROUNDS = 2
SMOOTH = 0.01                # pseudo-count of each piece
SAMPLE = 2000
FOLDS = 5                    # documents whose crc32 is divisible by this are held out
CHUNK = 8192                 # words of one length that go through the lattice at once
SPAN = 12                    # positions after which sums are rescaled
LONG = 1024                  # bytes of a word that are learnt together; the rest of a longer one is learnt as further words
COUNTED = 150_000            # different words a task counts before it hands them on
MAX_WORDS = 400_000          # words whose sums a worker remembers
PART = 150_000               # words of texts that are looked up together
LETTER = re.compile(r"[^\W\d_]")
# ASCII other than letters ends a word; all other characters are part of one.
ENDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of the lower-cased text in UTF-8: runs of ASCII letters and of characters beyond ASCII. None if the text holds no letter."""
    return (text or "").lower().encode().translate(ENDS).split() if text and LETTER.search(text) else []


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


class Pieces:
    """The vocabulary's pieces that a word can hold, as a trie over byte classes. Piece 0 and node 0 mean none."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        fits = re.compile(rb" ?[a-z\x80-\xff]*")
        tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) == 1 or fits.fullmatch(t)]
        used = sorted({b for t in tokens if fits.fullmatch(t) for b in t})
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        tokens = [t for t in tokens if all(self.classes[b] for b in t)]
        self.size = len(tokens)
        child: list[dict[int, int]] = [{}, {}]
        piece, depth = [0, 0], [0, 0]
        for number, token in enumerate(tokens, 1):
            node = 1
            for b in token:
                c = int(self.classes[b])
                nxt = child[node].get(c)
                if nxt is None:
                    nxt = child[node][c] = len(child)
                    child.append({})
                    piece.append(0)
                    depth.append(depth[node] + 1)
                node = nxt
            piece[node] = number
        self.width = len(used) + 1
        self.child = np.zeros(len(child) * self.width, np.int32)
        for node, sons in enumerate(child):
            for c, son in sons.items():
                self.child[node * self.width + c] = son
        self.piece = np.array(piece, np.int32)
        self.longest = max(depth)

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The lattice of words of one length (a byte matrix): ``(start, end, which words, which piece)``, by start."""
        classes, length = self.classes[words], words.shape[1]
        for start in range(length):
            which, node = np.arange(len(words)), np.ones(len(words), np.int32)
            for end in range(start + 1, length + 1):
                node = self.child[node * self.width + classes[which, end - 1]]
                alive = np.flatnonzero(node)
                if not len(alive):
                    break
                if len(alive) < len(node):
                    which, node = which[alive], node[alive]
                found = self.piece[node]
                is_piece = np.flatnonzero(found)
                if len(is_piece):
                    yield start, end, which[is_piece], found[is_piece]


def forward(edges: Iterable, n: int, length: int, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, logs)``: the probability of the first ``j`` bytes is ``sums[j] * exp(logs[j // SPAN])``, per word and column of ``p``.
    Where a block of ``SPAN`` places starts, all sums still in work are divided by the one there."""
    sums = np.zeros((length + 1, n, p.shape[1]))
    logs = np.zeros((length // SPAN + 1, n, p.shape[1]))
    sums[0], at = 1, 0
    for start, end, which, piece in edges:
        while at < start:
            at += 1
            if at % SPAN == 0:
                rescale(sums, logs, at, at, min(length, at + longest), 1)
        sums[end, which] += sums[start, which] * p[piece]
    for at in range(at + 1, length + 1):
        if at % SPAN == 0:
            rescale(sums, logs, at, at, length, 1)
    return sums, logs


def backward(edges: list, n: int, length: int, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the end: the probability of the bytes from ``j`` on is ``sums[j] * exp(logs[-(-j // SPAN)])``."""
    sums = np.zeros((length + 1, n, p.shape[1]))
    logs = np.zeros((-(-length // SPAN) + 1, n, p.shape[1]))
    sums[length], at = 1, length
    for start, end, which, piece in sorted(edges, key=lambda e: -e[1]):
        while at > end:
            at -= 1
            if at % SPAN == 0:
                rescale(sums, logs, at, max(0, at - longest), at, -1)
        sums[start, which] += sums[end, which] * p[piece]
    return sums, logs


def rescale(sums: np.ndarray, logs: np.ndarray, at: int, first: int, last: int, step: int) -> None:
    by = sums[at].copy()
    sums[first:last + 1] /= by
    block = at // SPAN
    logs[block] = logs[block - step] + np.log(by)


def by_length(words: list[bytes], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, byte matrix)`` of words of one length, at most ``CHUNK`` (fewer of long ones) at a time."""
    coded = [b" " + w for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        step = max(1, min(CHUNK, 2_000_000 // (size * columns)))
        for lo in range(0, len(at), step):
            part = at[lo:lo + step]
            yield part, np.frombuffer(b"".join([coded[i] for i in part.tolist()]), np.uint8).reshape(len(part), size)


def log_sums(pieces: Pieces, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """Log-probability of each word under each column of ``p``: the forward sums at its end."""
    out = np.zeros((len(words), p.shape[1]))
    for at, matrix in by_length(words, p.shape[1]):
        length = matrix.shape[1]
        sums, logs = forward(pieces.edges(matrix), len(at), length, p, pieces.longest)
        out[at] = np.log(sums[length]) + logs[length // SPAN]
    return out


def expected(pieces: Pieces, words: list[bytes], often: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How many times each piece is expected to be used in these words, ``p`` being one language's probabilities."""
    out = np.zeros(pieces.size + 1)
    p = p[:, None]
    for at, matrix in by_length(words, 4):
        length = matrix.shape[1]
        edges = list(pieces.edges(matrix))
        ahead, log_a = forward(edges, len(at), length, p, pieces.longest)
        back, log_b = backward(edges, len(at), length, p, pieces.longest)
        whole = np.log(ahead[length, :, 0]) + log_a[length // SPAN, :, 0]
        for start, end, which, piece in edges:
            share = ahead[start, which, 0] * p[piece, 0] * back[end, which, 0]
            share *= np.exp(log_a[start // SPAN, which, 0] + log_b[-(-end // SPAN), which, 0] - whole[which])
            out += np.bincount(piece, weights=share * often[at[which]], minlength=len(out))
    return out


_PIECES: dict[int, Pieces] = {}


def pieces_of(data: bytes) -> Pieces:
    """One trie per worker."""
    key = hash(data)
    if key not in _PIECES:
        _PIECES[key] = Pieces(parse_ranks(data))
    return _PIECES[key]


def word_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, word, n)`` over all documents that may be learnt from."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        counts: dict[str, Counter] = {}

        def out():
            for lang, c in counts.items():
                for word in [w for w in c if len(w) > LONG]:
                    n = c.pop(word)
                    c.update({part: n * k for part, k in Counter(word[i:i + LONG] for i in range(0, len(word), LONG)).items()})
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their piece probabilities (a column each), log-shares of the learnt documents, and the temperature."""

    def __init__(self, langs: list[str], p: np.ndarray, prior: np.ndarray, temperature: float = 1.0) -> None:
        self.langs, self.p, self.prior, self.temperature, self.key = langs, p, prior, temperature, uuid.uuid4().hex

    def posterior(self, sums: np.ndarray) -> np.ndarray:
        x = (sums + self.prior) / self.temperature
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)


class Scorer(dict):
    """word -> row of its log-sums, remembered for ``MAX_WORDS`` words."""

    def __init__(self, model: Model, pieces: Pieces) -> None:
        super().__init__()
        self.model, self.pieces = model, pieces
        self.sums, self.used = np.zeros((1024, len(model.langs))), 0

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The words' rows of ``sums``; new ones are summed first."""
        at = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            if len(self) + len(new) > MAX_WORDS:
                self.clear()
                self.used, missing, new = 0, range(len(words)), list(dict.fromkeys(words))
            self.update(zip(new, range(self.used, self.used + len(new))))
            if self.used + len(new) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(new)), self.sums.shape[1]))])
            self.sums[self.used:self.used + len(new)] = log_sums(self.pieces, new, self.model.p)
            self.used += len(new)
            at[missing] = [self[words[i]] for i in missing]
        return at

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Log-probability of each text per language, None without a word. New words of several texts go through the lattice together;
        a very long text is summed in parts."""
        cut = [words_of(t) for t in texts]
        lo = 0
        while lo < len(cut):
            hi, size = lo, 0
            while hi < len(cut) and (hi == lo or size + len(cut[hi]) <= PART):
                size += len(cut[hi])
                hi += 1
            if size <= PART:
                at, end = self.rows([w for x in cut[lo:hi] for w in x]), 0
                for x in cut[lo:hi]:
                    start, end = end, end + len(x)
                    yield self.sums[at[start:end]].sum(axis=0) if x else None
            else:
                yield sum(self.sums[self.rows(cut[lo][i:i + PART])].sum(axis=0) for i in range(0, size, PART))
            lo = hi


_SCORERS: dict[str, Scorer] = {}


def forget() -> None:
    _SCORERS.clear()
    _PIECES.clear()


def scorer_of(model: Model, vocabulary: bytes) -> Scorer:
    """The worker's scorer of a model; only the newest model's is kept."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model, pieces_of(vocabulary))
    return _SCORERS[model.key]


def learn(docs: DataFrame, vocabulary: bytes, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """The model of the documents that may be learnt from; None if no language can be."""
    small_batches(docs.sparkSession)
    counts = saved(word_counts(docs, id_col, text_col, lang_col))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    shares = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    pieces = pieces_of(vocabulary)
    n, k = pieces.size, len(langs)
    # Before the first round all pieces are alike.
    p = np.full((n + 1, k), 1 / n)
    p[0] = 0
    for _ in range(ROUNDS):
        p = normalised(expected_counts(counts, vocabulary, langs, p))
    model = Model(langs, p, np.log([shares[x] / sum(shares.values()) for x in langs]))
    model.temperature = fitted_temperature(rows, model, vocabulary, id_col, text_col, lang_col)
    return model


def normalised(counts: np.ndarray) -> np.ndarray:
    p = counts + SMOOTH
    p[0] = 0
    return p / p.sum(axis=0)


def expected_counts(counts: DataFrame, vocabulary: bytes, langs: list[str], p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language: one round's expectations, summed over the whole table of words."""
    at = {x: i for i, x in enumerate(langs)}

    def run(batches):
        only("language", forget)
        pieces, total = pieces_of(vocabulary), np.zeros(p.shape)
        for batch in batches:
            lang = np.array([at[x] for x in batch.column(0).to_pylist()])
            words, often = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for i in np.unique(lang).tolist():
                here = np.flatnonzero(lang == i)
                total[:, i] += expected(pieces, [words[j] for j in here.tolist()], often[here], p[:, i])
        piece, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, i])], ["lang", "piece", "n"])

    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", counts.sparkSession
    before = spark.conf.get(name)
    spark.conf.set(name, "50000")  # rows are single words
    try:
        sums = counts.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    finally:
        spark.conf.set(name, before)
    out = np.zeros(p.shape)
    out[sums.column("piece").to_numpy(), sums.column("lang").to_numpy()] = sums.column("n").to_numpy()
    return out


def fitted_temperature(rows: DataFrame, model: Model, vocabulary: bytes, id_col: str, text_col: str, lang_col: str) -> float:
    """The temperature, at least 1, under which the sample's languages are likeliest."""
    some = rows.where(F.col(lang_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col).cast("long")), F.col(id_col).cast("long")).limit(SAMPLE)
    some = some.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = [(r["sums"], r["lang"]) for r in log_probabilities(some, model, vocabulary, ("lang",)).collect() if r["sums"] is not None]
    if not found:
        return 1.0
    sums, right = np.array([s for s, _ in found]), np.array([model.langs.index(x) for _, x in found])
    best = (np.inf, 1.0)
    for t in np.geomspace(1, 1000, 61).tolist():
        model.temperature = t
        best = min(best, (-float(np.log(model.posterior(sums)[np.arange(len(right)), right] + 1e-12).mean()), t))
    return best[1]


def log_probabilities(rows: DataFrame, model: Model, vocabulary: bytes, more: tuple[str, ...] = ()) -> DataFrame:
    """``(id, sums array<double>, *more)`` per row ``(id, text, *more)``; null without a letter."""

    def run(batches):
        only("language", forget)
        scorer = scorer_of(model, vocabulary)
        for batch in batches:
            found = [None if x is None else x.tolist() for x in scorer.texts(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), *batch.columns[2:]], ["id", "sums", *more])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, "id long, sums array<double>" + "".join(f", {c} {kinds[c]}" for c in more))


def identify(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, held_out, lang_pred, score, posterior map<string, double>)`` per row."""
    vocabulary = _read(vocabulary_path)
    model = learn(docs, vocabulary, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, lang_pred string, score double, posterior map<string, double>"

    def run(batches):
        only("language", forget)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores, shares = [], [], []
            for sums in scorer_of(model, vocabulary).texts(texts) if model is not None else [None] * len(texts):
                share = model.posterior(sums) if sums is not None else np.zeros(0)
                langs.append(model.langs[int(share.argmax())] if len(share) else "und")
                scores.append(float(share.max(initial=0)))
                shares.append(list(zip(model.langs, share.tolist())) if len(share) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                                             ["id", "lang_pred", "score", "posterior"])

    found = rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "posterior")
