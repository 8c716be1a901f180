"""Byte-level BPE encoding and decoding with lazily built state machines.

Encoding. Merge ranks are compiled into a finite-state transducer over bytes. The last
token of a BPE encoding of a prefix is unique, and a token sequence is the encoding
of its bytes exactly when every neighbouring pair is. So after each byte it is enough to
remember the token boundaries that some vocabulary entry may still reach over, each with the
last token before it. Such a set of boundaries is a state; transitions are worked out
the first time they are taken and then looked up. A token is emitted as soon as all
remembered boundaries agree on it, which is at most the longest token ahead.

Decoding. A UTF-8 state machine takes the bytes of each id in turn and holds back
an unfinished character; its steps over whole tokens are looked up as well.

Ranks and the splitting pattern are parameters; as in the public library, a piece that is itself
a vocabulary entry is one token, whatever the merges say.

Defined cases: a null text is empty; empty texts give no ids; texts of any length are cut
piece by piece; null ids stay null; repeated rows are coded each for itself; an
unknown id is an error; other columns are not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import only, small_batches, tidied

# Memory (bytes, estimated) that looked-up entries may take per worker before a table is started afresh: pieces met before
# (each of two generations), transitions with their states, pairs of tokens with their spines, and the decoder's steps.
# Where other work has filled the executors, a caller takes a share of it.
PIECES_BYTES = 48 << 20
STATES_BYTES = 192 << 20
PAIRS_BYTES = 64 << 20
STEPS_BYTES = 4 << 20
# Bytes read before settled tokens are emitted; above twice the longest token, so some always are.
LOOKAHEAD = 4096
# A place in the trie and the token before it, or two tokens, are one number: the second has so many bits (and is counted from 1, 0 being none).
TOKEN_BITS = 24
TOKEN = (1 << TOKEN_BITS) - 1
# Texts up to this many characters are cut in one call; longer ones piece by piece.
WHOLE_CHARS = 1 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Bytes to token ids. A state holds one ``node, token`` (as one number) per boundary that a later token may
    still start from: the place in the vocabulary trie that the bytes since the boundary have
    reached, and the token that ends at the boundary. Its output on a byte is the last token of
    the bytes read so far; tokens settle once all boundaries held lead back through them."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0) -> None:
        self.ranks, self.share = ranks, share
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        self.forget()
        self.restart()

    def forget(self) -> None:
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int, int]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pairs_bytes = 0

    def restart(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]
        self.index = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.states_bytes = 0

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]] | None:
        """The parts at one edge of ``token`` while it is merged from bytes: ``(part, born, gone)``,
        the ranks at which the part comes about and goes. None if merging never arrives at the token."""
        known = self.spines.get((token, right), 0)
        if known != 0:
            return known
        data, none = self.bytes_of[token], 1 << 60
        parts = [data[i:i + 1] for i in range(len(data))]
        edge = -1 if right else 0
        out, born, now = [], -1, -1
        while len(parts) > 1:
            rank, i = min((self.ranks.get(x + y, none), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            now = max(now, rank)
            if i == (len(parts) - 2 if right else 0):
                out.append((parts[edge], born, now))
                born = now
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        known = self.spines[token, right] = [*out, (parts[edge], born, none)] if len(parts) == 1 else None
        self.pairs_bytes += 250 + 200 * len(out)
        return known

    def adjoin(self, a: int, b: int) -> bool:
        """May ``b`` follow ``a``? (``a`` of -1: may ``b`` stand first?) Not if a part at the end of ``a``
        and one at the start of ``b`` would have been merged with each other while both were there."""
        key = a + 1 << TOKEN_BITS | b
        known = self.pairs.get(key)
        if known is None:
            left, right = self.spine(a, True) if a >= 0 else [], self.spine(b, False)
            known = right is not None and left is not None
            if known:
                for x, x_born, x_gone in left:
                    for y, y_born, y_gone in right:
                        rank = self.ranks.get(x + y)
                        if rank is not None and max(rank, x_born) < x_gone and max(rank, y_born) <= y_gone \
                                and x_born < y_gone and y_born < x_gone and max(rank, y_born) < x_gone and max(rank, x_born) <= y_gone:
                            known = False
            if self.pairs_bytes > PAIRS_BYTES * self.share:
                self.forget()
            self.pairs[key] = known
            self.pairs_bytes += 140
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Work out a transition: the next state and the last token so far."""
        child, token_at, pairs = self.child, self.token_at, self.pairs
        live, end = [], -1
        for at in self.states[state]:
            node = child[at >> TOKEN_BITS].get(byte)
            if node is not None:
                if end < 0 and (t := token_at[node]) >= 0:
                    may = pairs.get((at & TOKEN) << TOKEN_BITS | t)
                    if may if may is not None else self.adjoin((at & TOKEN) - 1, t):
                        end = t
                        pairs = self.pairs
                if child[node]:
                    live.append(node << TOKEN_BITS | at & TOKEN)
        live.append(end + 1)
        key = tuple(live)
        nxt = self.index.get(key)
        if nxt is None:
            nxt = self.index[key] = len(self.states)
            self.states.append(key)
            self.states_bytes += 260 + 48 * len(key)
        return nxt, end

    def settled(self, ends: list[int], state: int) -> int:
        """How many of the bytes read are covered by tokens that nothing to come can change."""
        back = [len(ends) - self.depth[at >> TOKEN_BITS] for at in self.states[state]]
        while (top := max(back)) != min(back):
            back = [x - self.length[ends[x - 1]] if x == top else x for x in back]
        return back[0]

    def tokens(self, ends: list[int], upto: int) -> list[int]:
        """The tokens of the first ``upto`` bytes, read back from their last ones."""
        out = []
        while upto:
            out.append(ends[upto - 1])
            upto -= self.length[ends[upto - 1]]
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.states_bytes > STATES_BYTES * self.share:
            self.restart()
        out: list[int] = []
        ends: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            key = state << 8 | byte
            known = steps.get(key)
            if known is None:
                known = steps[key] = self.step(state, byte)
                self.states_bytes += 220
            state, end = known
            ends.append(end)
            if len(ends) == LOOKAHEAD:
                done = self.settled(ends, state)
                out.extend(self.tokens(ends, done))
                del ends[:done]
        out.extend(self.tokens(ends, len(ends)))
        return out


class Pieces(dict):
    """Pieces met before and their ids as packed 32-bit numbers. Two generations: a full
    one becomes the old one, out of which pieces that come again are taken over."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer, self.old, self.bytes = transducer, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode_piece(piece.encode())).tobytes()
        if self.bytes > PIECES_BYTES * self.transducer.share:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[piece] = ids
        self.bytes += 240 + 2 * len(piece) + len(ids)
        return ids


class Encoder:
    """Text to ids: cut by the pattern, each piece through the transducer or the table of pieces met before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0) -> None:
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(Transducer(ranks, share))

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= WHOLE_CHARS:
            cut: Iterable[str] = self.pattern.findall(text)
        else:
            cut = (m.group() for m in self.pattern.finditer(text))
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, cut)), np.int32)


class Utf8Machine:
    """Incremental UTF-8: state 0 is a character's end; otherwise ``(bytes to come, lowest, highest next byte)``."""

    @staticmethod
    def next(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
        left, low, high = state
        if left:
            return (left - 1, 0x80, 0xBF) if low <= byte <= high else None
        if byte < 0x80:
            return 0, 0, 0
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None


class Decoder:
    """Ids to text, as they come: each call returns the characters that are complete.
    Bytes that cannot be UTF-8 become U+FFFD, one for each rejected run."""

    START = (0, 0, 0)

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.forget()
        # From one character's end to the next: tokens of complete characters only, known without a walk; None for the others.
        self.complete: list[str | None] = [None] * (max(self.bytes_of, default=-1) + 1)
        for i, token in self.bytes_of.items():
            state, held, text = self.walk(self.START, b"", token)
            if not held:
                self.complete[i] = text
        self.reset()

    def forget(self) -> None:
        self.table: dict[tuple, tuple] = {}
        self.table_bytes = 0

    def reset(self) -> None:
        self.state, self.held = self.START, b""

    def walk(self, state: tuple, held: bytes, token: bytes) -> tuple[tuple, bytes, str]:
        out, run = [], bytearray(held)
        for b in token:
            nxt = Utf8Machine.next(state, b)
            if nxt is None and run and state[0]:
                out.append("�")  # an unfinished character; the byte may begin another
                run, state = bytearray(), self.START
                nxt = Utf8Machine.next(state, b)
            if nxt is None:
                out.append("�")
                continue
            run.append(b)
            state = nxt
            if not state[0]:
                out.append(run.decode())
                run = bytearray()
        return state, bytes(run), "".join(out)

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            key = (self.held, i)
            step = self.table.get(key)
            if step is None:
                step = self.walk(self.state, self.held, self.bytes_of[i])
                if self.table_bytes > STEPS_BYTES:
                    self.forget()
                self.table[key] = step
                self.table_bytes += 500
            self.state, self.held, text = step
            yield text

    def finish(self) -> str:
        tail = "�" if self.held else ""
        self.reset()
        return tail

    def decode(self, ids: Iterable[int]) -> str:
        self.reset()
        ids = list(ids)
        if min(ids, default=0) < 0 or max(ids, default=0) >= len(self.complete):
            raise KeyError("an id that the ranks do not hold")
        try:
            return "".join(map(self.complete.__getitem__, ids))
        except TypeError:  # a token that is no whole number of characters
            return "".join(self.feed(ids)) + self.finish()


_MACHINES: dict = {}


def forget_machines() -> None:
    """For :func:`only`: a function travels to the workers by name; ``_MACHINES.clear`` would clear a copy of the dict there."""
    _MACHINES.clear()


def _machine(kind: type, data: bytes, *more):
    """One machine per worker: its tables serve all tasks of the worker."""
    key = (kind.__name__, hash(data), *more)
    if key not in _MACHINES:
        _MACHINES[key] = kind(parse_ranks(data), *more)
    return _MACHINES[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` per row. The rank file is read where the job is
    described and travels with it (its size does not depend on the data)."""
    small_batches(docs.sparkSession)
    data = _read(ranks_path)

    def run(batches):
        only("bpe", forget_machines)
        encoder = _machine(Encoder, data, pattern)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids)], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.zeros(0, np.int32))


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids_col, decoded string)`` per row; null ids decode to an empty text."""
    data = _read(ranks_path)

    def run(batches):
        only("bpe", forget_machines)
        decoder = _machine(Decoder, data)
        for batch in batches:
            texts = [decoder.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(run, "id long, ids array<int>, decoded string")
    return out.withColumnsRenamed({"id": id_col, "ids": ids_col})


def coded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
          with_ids: bool = False, share: float = 1.0) -> DataFrame:
    """:func:`encode`, :func:`decode` and the digests of both results, in one Arrow pass, so that one Python worker per task
    holds the machines (in ``share`` of the memory they may take) and no decoded text goes back: ``(id_col, [ids,] n_tokens, ids_sha256, decoded_sha256)`` per row."""
    small_batches(docs.sparkSession)
    data = _read(ranks_path)

    def run(batches):
        only("bpe", forget_machines)
        encoder, decoder = _machine(Encoder, data, pattern, share), _machine(Decoder, data)
        decimals = _machine(Decimals, data).of
        for batch in tidied(batches):
            ids, shas, texts = [], [], []
            for text in batch.column(1).to_pylist():
                found = encoder.encode(text or "")
                listed = found.tolist()
                ids.append(found)
                shas.append(sha256(",".join(map(decimals, listed)).encode()).hexdigest())
                texts.append(sha256(decoder.decode(listed).encode()).hexdigest())
            more = [lists(ids)] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, pa.array(map(len, ids), pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                                             ["id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Decimals:
    """Ids as decimal texts."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.of = [str(i) for i in range(max(ranks.values(), default=-1) + 1)].__getitem__


def digests(coded: DataFrame, id_col: str = "doc_id", *more: str) -> DataFrame:
    return coded.select(
        id_col, *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
