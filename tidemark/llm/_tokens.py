"""Word hashes and window hashes of whole texts, batch by batch, in numpy.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. Its 64-bit hash
depends on its bytes alone, and a window hash is a polynomial over word hashes
modulo 2^64, so equal windows agree in every document, task and run.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd

KEYS = ("0123456789123456", "fedcba9876543210")
#: Odd multipliers of the window polynomials, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordBatch:
    """The words of some texts in one array; ``starts[i]:starts[i + 1]`` is text i."""

    def __init__(self, texts: list[str | None]):
        words = [split_words(t) for t in texts]
        self.starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.n = np.diff(self.starts)
        flat = np.empty(int(self.starts[-1]), dtype=object)
        flat[:] = list(chain.from_iterable(words))
        self.codes, self.uniques = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), np.empty(0, object))
        self._hashes: dict[int, np.ndarray] = {}
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, which: int = 0) -> np.ndarray:
        if which not in self._hashes:
            self._hashes[which] = pd.util.hash_array(np.asarray(self.uniques, dtype=object), hash_key=KEYS[which], categorize=False)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        return self._hashes[which]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def windows(self, start: np.ndarray, size, which: int = 0) -> np.ndarray:
        """Hashes of the windows of ``size`` words that begin at the given word indices."""
        if which not in self._sums:
            h = self.hashes(which)
            up = np.ones(len(h) + 1, np.uint64)
            down = np.ones(len(h) + 1, np.uint64)
            np.multiply.accumulate(np.full(len(h), BASES[which], np.uint64), out=up[1:])
            np.multiply.accumulate(np.full(len(h), INVERSES[which], np.uint64), out=down[1:])
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h) * up[:-1], out=sums[1:])
            self._sums[which] = sums, down
        sums, down = self._sums[which]
        return mix((sums[start + size] - sums[start]) * down[start] + np.uint64(7))


def batches_of(texts: list, most: int = 4_000_000):
    """(from, to) of consecutive rows with about ``most`` characters, one row at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)
