"""Word shingles of whole texts as 64-bit hashes, a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from logcompact.llm.wordkeys import WordKeys, mixed

WIDTH = 5
BLOCK = 1 << 20
_STEP, _LIFT = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32  # A-Z count as a-z
_KEYS = WordKeys(256, 5)
_PLACE = np.cumprod(np.full(63, _LIFT, dtype=np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in the bytes of a text; long texts go in stretches that end between words."""
    chars = np.frombuffer(data, dtype=np.uint8)
    found, first = [], 0
    while first < len(chars):
        end = first + BLOCK
        while end < len(chars):  # on to the first gap
            gaps = np.flatnonzero(_SPACE[chars[end : end + BLOCK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += BLOCK
        part = chars[first:end]
        gap = _SPACE[part]
        at = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        stop = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
        found.append((first + at, _KEYS(_FOLDED[part], at, stop)))
        first = end
    none = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    return tuple(np.concatenate(x) for x in zip(*(found or none), strict=True))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, end, bytes, start of each text) of texts put together with a space after each."""
    at = 0
    while at < len(texts):
        data, held = [], 0
        while at + len(data) < len(texts):
            text = texts[at + len(data)] or ""
            if data and held + 4 * len(text) >= BLOCK:
                break
            data.append(text.encode("utf-8", "surrogatepass"))
            held += len(data[-1]) + 1
        sizes = np.array([len(x) + 1 for x in data])
        yield at, at + len(data), b" ".join(data) + b" ", np.cumsum(sizes) - sizes
        at += len(data)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than the width make one shingle, no words none."""
    for first, end, data, starts in blocks(texts):
        at, words = word_hashes(data)
        bounds = np.append(np.searchsorted(at, starts), len(at))
        n = max(len(words) - width + 1, 0)
        whole = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            whole += words[j : j + n] * _PLACE[j]
        whole = mixed(whole)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            else:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mixed(short + np.uint64(int(b - a) * _STEP % (1 << 64))) if b > a else short[:0]
