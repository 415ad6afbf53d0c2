"""Word-piece counts by a longest-match automaton that never goes back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.llm.shingles import _SPACE, blocks

#: Bytes of a word that are read beside those of the other words of a block.
SIDE_BY_SIDE = 1024


class Automaton:
    """A trie of pieces with failure links, as tables: next state and pieces popped for every state and byte.

    The state is the longest beginning of a piece that is still open. When a byte doesn't continue it, the longest pieces at its
    front are closed; how many, and which state is left, depends on the state alone and is worked out here, level by level.
    `rest` is how many pieces an open state closes when the word ends. Every single byte must be a piece.
    """

    def __init__(self, pieces: list[bytes]):
        pieces = sorted(set(pieces))
        if sum(len(p) == 1 for p in pieces) != 256:
            raise ValueError("the vocabulary must hold every single byte")
        children: list[dict[int, int]] = [{}]
        ends, parent, byte, depth = [False], [0], [0], [0]
        for piece in pieces:
            at = 0
            for b in piece:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(False)
                    parent.append(at)
                    byte.append(b)
                    depth.append(depth[at] + 1)
                at = children[at][b]
            ends[at] = True
        size = len(children)
        parent, byte, depth, ends = map(np.array, (parent, byte, depth, ends))
        self.next = np.zeros((size, 256), dtype=np.int32)
        self.pops = np.zeros((size, 256), dtype=np.uint8)
        link, popped = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.rest = np.zeros(size, dtype=np.int32)
        child = {b: s for b, s in children[0].items()}
        self.next[0, list(child)] = list(child.values())
        for level in range(1, int(depth.max()) + 1):
            at = np.flatnonzero(depth == level)
            if level > 1:  # a state that is no piece goes where the state before it went, and on from there
                up = link[parent[at]]
                link[at] = np.where(ends[at], 0, self.next[up, byte[at]])
                popped[at] = np.where(ends[at], 1, popped[parent[at]] + self.pops[up, byte[at]])
            else:
                popped[at] = 1
            self.next[at] = self.next[link[at]]
            closed = self.pops[link[at]] + popped[at][:, None]
            if closed.max(initial=0) > np.iinfo(self.pops.dtype).max:  # long pieces can close many at once
                self.pops = self.pops.astype(np.int32)
            self.pops[at] = closed
            self.rest[at] = popped[at] + self.rest[link[at]]
            below = np.flatnonzero(depth == level + 1)
            self.next[parent[below], byte[below]] = below
            self.pops[parent[below], byte[below]] = 0

    def lengths(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, state: int = 0) -> np.ndarray:
        """Pieces of every word data[at:end], all words side by side, one byte of each at a time; the rest of long ones alone."""
        size = end - at
        order = np.argsort(-size, kind="stable")
        place, size = at[order], size[order]
        states, total = np.full(len(order), state, dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        n, step = len(order), 0
        while n and step < SIDE_BY_SIDE:
            n = np.searchsorted(-size[:n], -step)  # words longer than the step
            if not n:
                break
            b = data[place[:n] + step]
            total[:n] += self.pops[states[:n], b]
            states[:n] = self.next[states[:n], b]
            step += 1
        for k in range(int(np.searchsorted(-size, -step))):
            more, states[k] = self._alone(data[place[k] + step : place[k] + size[k]], int(states[k]))
            total[k] += more
        out = np.empty(len(order), dtype=np.int64)
        out[order] = total + self.rest[states]
        return out


    def _alone(self, data: np.ndarray, state: int) -> tuple[int, int]:
        """Pieces closed by these bytes and the state after them."""
        go, pops, total = memoryview(self.next.reshape(-1)), memoryview(self.pops.reshape(-1)), 0
        for b in data.tobytes():
            at = state * 256 + b
            total += pops[at]
            state = go[at]
        return total, state


_KEPT: dict[str, Automaton] = {}


def vocabulary_name(pieces: list[bytes]) -> str:
    """A digest of all pieces in order."""
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(len(piece).to_bytes(8, "little") + piece)
    return digest.hexdigest()


def automaton(pieces: list[bytes], name: str) -> Automaton:
    """One automaton per worker process and vocabulary."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Automaton(pieces)
    return _KEPT[name]


def count_pieces(docs: DataFrame, pieces: list[bytes], front: bytes = b" ") -> DataFrame:
    """How many pieces greedy longest match cuts each text into, word by word, each word with `front` before it.

    Words are what stands between white space (space, tab to carriage return). The automaton reads every byte once, whatever
    the words, and no piece is built. Its tables grow with the vocabulary only; the vocabulary is broadcast.

    Null and empty texts have no words and no pieces. Rows are independent of each other, so repeated rows get equal counts.
    Columns other than doc_id and text are not read. Returns doc_id, n_words, n_tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    name = vocabulary_name(pieces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(shared.value, name)
        begin, before = 0, 0
        for b in front:
            before += int(machine.pops[begin, b])
            begin = int(machine.next[begin, b])
        for batch in batches:
            words, tokens = [], []
            for _, _, data, starts in blocks(batch["text"].tolist()):
                chars = np.frombuffer(data, dtype=np.uint8)
                gap = _SPACE[chars]
                at = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
                end = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
                sums = np.concatenate([[0], np.cumsum(machine.lengths(chars, at, end, begin) + before)])
                bounds = np.append(np.searchsorted(at, starts), len(at))
                words.append(np.diff(bounds))
                tokens.append(np.diff(sums[bounds]))
            none = [np.zeros(0, dtype=np.int64)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": np.concatenate(words or none), "n_tokens": np.concatenate(tokens or none)}).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_words long, n_tokens long")
