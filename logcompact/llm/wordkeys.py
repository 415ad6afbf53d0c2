"""Keys of words that no rule for building words makes equal."""

from __future__ import annotations

import numpy as np

#: Places of a word whose random numbers are looked up; those beyond are mixed from place and character.
NEAR = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordKeys:
    """A 64-bit key per word: the sum of a random number for each character at each place in the word.

    Unlike a polynomial modulo a power of two, no arrangement of two parts (such as repeated doubling) has equal sums; two
    given words meet with a chance of 2^-64.
    """

    def __init__(self, symbols: int, seed: int):
        self.symbols, self.seed = symbols, np.uint64(seed * 2 + 1)
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, NEAR * symbols, dtype=np.uint64)

    def __call__(self, codes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of the words codes[at:end], which don't overlap; codes are below `symbols`."""
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        begin = np.zeros(len(codes), dtype=np.int64)
        begin[at] = at
        np.maximum.accumulate(begin, out=begin)
        index = (np.arange(len(codes)) - begin) * self.symbols + codes
        value = self.table[np.minimum(index, len(self.table) - 1)]
        far = np.flatnonzero(index >= len(self.table))
        if len(far):
            value[far] = mixed(index[far].astype(np.uint64) * _ODD + self.seed)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        return mixed((sums[end] - sums[at]) ^ (end - at).astype(np.uint64) * _ODD)
