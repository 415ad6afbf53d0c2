"""A vantage-point tree over the vectors of one shard, searched for many queries at once."""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np

LEAF = 32
#: Leaves that each open query looks into before bounds are tested again.
WAVE = 4


def lifted(points: np.ndarray, longest: float) -> np.ndarray:
    """Points with one more component that gives all of them the length `longest`.

    Between a query, whose extra component is 0, and such points the largest inner product is the least distance.
    """
    rest = np.maximum(longest**2 - np.einsum("nd,nd->n", points, points), 0.0)
    return np.concatenate([points, np.sqrt(rest)[:, None]], axis=1)


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added from the first component to the last."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * points[:, j]
    return total


@dataclass
class Tree:
    """Nodes level by level: a point and, for either half of the other points below it, the range of their distances to it."""

    order: np.ndarray  # points by leaf
    first: np.ndarray  # of each leaf in `order`, and the end
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # (point, (node, side, low/high))

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Halves every node by distance from its point farthest from the node's first, until leaves hold `leaf` points or fewer.

        All nodes of a level hold as many points as each other, give or take one, so the level is as deep for all;
        points at one distance are halved by place.
        """
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        order, bounds, levels = np.arange(n), np.array([0, n]), []
        for _ in range(depth):
            marks, ranges, cuts, parts = [], [], [0], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[a:b]
                away = np.linalg.norm(points[own] - points[own[0]], axis=1)
                mark = own[away.argmax()]
                d = np.linalg.norm(points[own] - points[mark], axis=1)
                half = (b - a + 1) // 2
                split = np.argpartition(d, half - 1) if half < b - a else np.arange(b - a)
                near, far = split[:half], split[half:]
                parts += [own[near], own[far]]
                cuts += [a + half, b]
                marks.append(mark)
                sides = [(d[s].min(), d[s].max()) if len(s) else (np.inf, np.inf) for s in (near, far)]
                ranges.append(sides)
            order, bounds = np.concatenate(parts), np.array(cuts)
            levels.append((np.array(marks), np.array(ranges)))
        return cls(order, bounds, levels)

    def bounds(self, points: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, what the triangle inequality says its points are at least away."""
        least = np.zeros((len(queries), 1))
        for marks, ranges in self.levels:
            d = distances(queries, points[marks])[:, :, None]
            here = np.maximum(np.maximum(ranges[None, :, :, 0] - d, d - ranges[None, :, :, 1]), 0.0)
            least = np.maximum(here, least[:, :, None]).reshape(len(queries), -1)
        return least


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = np.einsum("qd,qd->q", queries, queries)[:, None] + np.einsum("pd,pd->p", points, points)[None, :]
    return np.sqrt(np.maximum(squares - 2 * (queries @ points.T), 0.0))


class Shard:
    """Distinct vectors of one shard in the order of their smallest ids, with the ids of each, under a tree."""

    def __init__(self, points: np.ndarray, ids: list[list[int]], tree: Tree | None = None):
        self.points, self.ids = points, ids
        self.low = np.array([x[0] for x in ids], dtype=np.int64)
        self.longest = float(np.sqrt(np.einsum("nd,nd->n", points, points).max(initial=0.0)))
        self.lifted = lifted(points, self.longest)
        self.tree = tree or Tree.build(self.lifted)

    def dump(self) -> bytes:
        out = io.BytesIO()
        levels = {f"{name}{k}": x for k, level in enumerate(self.tree.levels) for name, x in zip(("marks", "ranges"), level, strict=True)}
        counts = np.array([len(x) for x in self.ids])
        flat = np.array([i for x in self.ids for i in x], dtype=np.int64)
        np.savez(out, points=self.points, counts=counts, ids=flat, order=self.tree.order, first=self.tree.first, **levels)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as x:
            levels = [(x[f"marks{k}"], x[f"ranges{k}"]) for k in range(sum(n.startswith("marks") for n in x.files))]
            ids = [part.tolist() for part in np.split(x["ids"], np.cumsum(x["counts"])[:-1])]
            return cls(x["points"], ids, Tree(x["order"], x["first"], levels))


class Nearest:
    """The k best (score, smallest id, point) of each of some queries, over the shards searched so far.

    A point is the number of a shard in the order of searching, shifted, and its place there.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries = queries
        self.score = np.full((len(queries), k), -np.inf)
        self.low = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.point = np.full((len(queries), k), -1, dtype=np.int64)
        self.leaves = 0

    def limit(self, longest: float) -> np.ndarray:
        """How far a point may be in the space of a shard to come among the k best; with room for rounding."""
        squares = np.einsum("qd,qd->q", self.queries, self.queries) + longest**2
        return np.sqrt(np.maximum(squares - 2 * self.score[:, -1], 0.0)) + 1e-7 * np.sqrt(squares)

    def search(self, shard: Shard, number: int, factor: float) -> None:
        """Look into the shard's leaves by increasing bound.

        A leaf is left out when `factor` times its bound exceeds the k-th best distance so far: with factor 1 nothing
        can be lost; a larger factor leaves out leaves that could only just hold a better point.
        """
        if not len(self.queries) or not len(shard.points):
            return
        above = np.concatenate([self.queries, np.zeros((len(self.queries), 1))], axis=1)
        least = shard.tree.bounds(shard.lifted, above) * factor
        turn = np.argsort(least, axis=1, kind="stable")
        least = np.take_along_axis(least, turn, 1)
        open_ = np.arange(len(self.queries))
        for at in range(0, least.shape[1], WAVE):
            limit = self.limit(shard.longest)
            open_ = open_[least[open_, at] <= limit[open_]]
            if not len(open_):
                break
            rows, cols = np.nonzero(least[open_, at : at + WAVE] <= limit[open_, None])
            rows = open_[rows]
            leaf = turn[rows, at + cols]
            self.leaves += len(leaf)
            by = np.argsort(leaf, kind="stable")
            rows, leaf = rows[by], leaf[by]
            edges = np.flatnonzero(np.diff(leaf, prepend=-1))
            met = []
            for a, b in zip(edges, np.append(edges[1:], len(rows)), strict=True):
                members = shard.tree.order[shard.tree.first[leaf[a]] : shard.tree.first[leaf[a] + 1]]
                about = self.queries[rows[a:b]] @ shard.points[members].T
                least_score = self.score[rows[a:b], -1]
                near = np.where(np.isfinite(least_score), least_score - 1e-9 * (1 + np.abs(least_score)), -np.inf)
                r, m = np.nonzero(about >= near[:, None])
                met.append((rows[a:b][r], members[m]))
            rows, members = (np.concatenate(x) for x in zip(*met, strict=True))
            self._merge(rows, products(self.queries[rows], shard.points[members]), shard.low[members], number << 32 | members)

    def _merge(self, rows: np.ndarray, score: np.ndarray, low: np.ndarray, point: np.ndarray) -> None:
        if not len(rows):
            return
        k, touched = self.score.shape[1], np.unique(rows)
        of = np.concatenate([np.repeat(touched, k), rows])
        both = [np.concatenate([held[touched].reshape(-1), new]) for held, new in ((self.score, score), (self.low, low), (self.point, point))]
        order = np.lexsort((both[2], both[1], -both[0], of))
        take = order[np.searchsorted(of[order], touched)[:, None] + np.arange(k)[None, :]]
        self.score[touched], self.low[touched], self.point[touched] = (x[take] for x in both)
