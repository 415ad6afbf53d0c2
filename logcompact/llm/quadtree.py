"""A tree of K x K quadrants over a sparse matrix of counts, and walks over two of them at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

K = 4
#: Sides of a tile; powers of K. A tile is a strip at the top of a square of its longer side, whose other rows are empty quadrants.
ROWS, COLUMNS = 64, 4096
#: Joint leaves that are evaluated at once.
AT_ONCE = 4096


@dataclass
class Quadtree:
    """Per level, the nonempty quadrants' places in row and column, and for each a word whose bits are its nonempty children.

    Children of a level come in the order of their parents and bits, so a child is found by counting bits, and empty
    quadrants take no room. `leaves` holds the K x K counts of every nonempty quadrant of the last level.
    """

    words: list[np.ndarray]
    leaves: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, side: int = COLUMNS) -> Quadtree:
        depth = 0
        while K ** (depth + 1) < side:
            depth += 1
        # the path of a cell: per level the child it lies in, so that cells sort as the tree does
        path = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth, -1, -1):
            step = K**level
            path = path * K * K + rows // step % K * K + columns // step % K
        order = np.argsort(path, kind="stable")
        path, counts = path[order], counts[order]
        node = path // (K * K)
        at, which = np.unique(node, return_inverse=True)
        leaves = np.zeros((len(at), K * K), dtype=np.int64)
        leaves[which, path % (K * K)] = counts
        words = []
        for _ in range(depth):
            parent, of = np.unique(at // (K * K), return_inverse=True)
            word = np.zeros(len(parent), dtype=np.uint16)
            np.bitwise_or.at(word, of, (1 << at % (K * K)).astype(np.uint16))
            words.insert(0, word)
            at = parent
        return cls(words, leaves.reshape(-1, K, K))

    def __len__(self) -> int:
        return len(self.leaves)

    def children(self) -> list[np.ndarray]:
        """Per level a table of each quadrant's children by bit: their numbers in the next level, -1 for empty ones."""
        out = []
        for word in self.words:
            has = (word[:, None] >> np.arange(K * K, dtype=np.uint16) & 1).astype(bool)
            number = np.cumsum(has.reshape(-1)).reshape(has.shape) - 1
            out.append(np.where(has, number, -1))
        return out

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, leaves) of the nonempty leaves, a block at a time; rows and columns of their first cells."""
        for row, _, column, a, _ in joint(self, None, ROWS, 1):
            yield row, column, self.leaves[a]


def joint(a: Quadtree, b: Quadtree | None, rows_of_a: int, rows_of_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Walks two trees down the same columns: blocks of (row in a, row in b, column, leaf of a, leaf of b).

    Every pair of row quadrants is followed where at least one of the two is nonempty, and -1 stands for the empty one; where
    both are empty the walk ends, however large the quadrant. Quadrants that begin beyond the trees' rows are no partners. A
    tree walked with itself gives pairs of rows once. Without b the leaves of a are walked.
    """
    same, depth = b is a, len(a.words)
    row_a = row_b = column = np.zeros(1, dtype=np.int64)
    at_a = np.zeros(1, dtype=np.int64) if len(a) else np.full(1, -1)
    at_b = np.zeros(1, dtype=np.int64) if b is not None and len(b) else np.full(1, -1)
    down_a, down_b = a.children(), b.children() if b is not None else []
    span = np.arange(K)
    for level in range(depth):
        n = len(at_a)
        grid = (n, K, K, K) if b is not None else (n, K, 1, K)  # quadrant, row in a, row in b, column
        ra, rb, c = np.broadcast_arrays(span[None, :, None, None], span[: grid[2]][None, None, :, None], span[None, None, None, :])
        pick = lambda down, at, r: np.where(at[:, None, None, None] >= 0, down[level][at[:, None, None, None], r * K + c], -1) if len(down[level]) else np.full((n, *c.shape[1:]), -1)
        next_a = np.broadcast_to(pick(down_a, at_a, ra), grid)
        next_b = np.broadcast_to(pick(down_b, at_b, rb), grid) if b is not None else np.full(grid, -1)
        rows_a = np.broadcast_to(row_a[:, None, None, None] * K + ra, grid)
        rows_b = np.broadcast_to(row_b[:, None, None, None] * K + rb, grid)
        each = K ** (depth - level)
        go = ((next_a >= 0) | (next_b >= 0)) & (rows_a * each < rows_of_a) & (rows_b * each < rows_of_b)
        if same:
            go &= rows_a <= rows_b
        columns = np.broadcast_to(column[:, None, None, None] * K + c, grid)
        at_a, at_b, row_a, row_b, column = next_a[go], next_b[go], rows_a[go], rows_b[go], columns[go]
    some = np.flatnonzero((at_a >= 0) | (at_b >= 0))
    for k in range(0, len(some), AT_ONCE):
        x = some[k : k + AT_ONCE]
        yield row_a[x] * K, row_b[x] * K, column[x] * K, at_a[x], at_b[x]
