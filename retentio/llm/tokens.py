"""Words and word-sequence hashes of a text as numpy arrays, for the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

# Words whose hashes a worker keeps before it starts afresh.
MAX_WORDS = 100_000
WIDTH = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def forget_words() -> None:
    _WORDS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as bytes: on bytes, ``split`` cuts at just these and ``lower`` changes A-Z only."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words, from the word hashes."""
    out = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        out = mix(out + hashes[k:k + len(out)] + np.uint64(k + 1))
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of the lower-cased text; a text of one to four
    words is one shingle, a text without words has none."""
    h = word_hashes(split(text, lower=True))
    return np.unique(window_hashes(h, min(WIDTH, len(h)))) if len(h) else h
