"""A navigable small-world graph over the unit vectors of one shard, searched for many queries at once."""

from __future__ import annotations

import numpy as np

LINKS, LINKS_BELOW = 12, 24
BUILD_BEAM, BATCH, AT_A_TIME = 32, 256, 4


def rank_best(sims: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest of each row, largest first."""
    if sims.shape[1] > n:
        part = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")


class Graph:
    def __init__(self, vectors: np.ndarray):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        # the level of a point depends on its place only, so a shard built anew is the same graph
        chance = np.random.default_rng(n).random(n)
        self.level = np.minimum((-np.log(np.maximum(chance, 1e-12)) / np.log(LINKS)).astype(int), 8)
        if n:
            self.level[0] = self.level.max()
        self.near = [np.full((n, LINKS_BELOW if k == 0 else LINKS), -1, dtype=np.int32) for k in range(self.level.max(initial=0) + 1)]
        done = min(n, 1)
        while done < n:
            step = min(max(done, 16), BATCH, n - done)
            self._insert(np.arange(done, done + step), done)
            done += step

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """The nearest point that a walk finds on the levels above `to`, for each query."""
        at = np.zeros(len(queries), dtype=np.int64)
        for level in range(len(self.near) - 1, to, -1):
            at = self.search(queries, at[:, None], level, 1)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, similarities) of the best `beam` points met, best first; -1 where there are fewer."""
        q, n, near = len(queries), len(self.x), self.near[level]
        seen = np.zeros((q, n + 1), dtype=bool)
        seen[:, n] = True  # the place of -1
        rows = np.arange(q)
        np.put_along_axis(seen, start, True, axis=1)
        ids = np.full((q, beam), -1, dtype=np.int64)
        sims = np.full((q, beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((q, beam), dtype=bool)
        first = np.einsum("qd,qkd->qk", queries, self.x[start])
        best = rank_best(first, min(beam, start.shape[1]))
        ids[:, : best.shape[1]] = np.take_along_axis(start, best, 1)
        sims[:, : best.shape[1]] = np.take_along_axis(first, best, 1)
        open_[:, : best.shape[1]] = True
        live = rows
        width = min(AT_A_TIME, beam)
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            pick = rank_best(score, width)
            fine = np.isfinite(np.take_along_axis(score, pick, 1))
            live, pick, fine = live[fine[:, 0]], pick[fine[:, 0]], fine[fine[:, 0]]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            current = np.where(fine, ids[live[:, None], pick], -1)
            found = np.where(current[:, :, None] >= 0, near[current], -1).reshape(len(live), -1)
            found[seen[live[:, None], found]] = -1
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1  # met twice at once
            seen[live[:, None], found] = True
            fresh = np.flatnonzero((found >= 0).any(axis=1))
            if not len(fresh):
                continue
            at, found = live[fresh], found[fresh]
            new = np.einsum("qd,qkd->qk", queries[at], self.x[found])
            new[found < 0] = -np.inf
            every = np.concatenate([sims[at], new], axis=1)
            keep = rank_best(every, beam)
            sims[at] = np.take_along_axis(every, keep, 1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], found], axis=1), keep, 1)
            open_[at] = np.take_along_axis(np.concatenate([open_[at], found >= 0], axis=1), keep, 1)
            ids[at] = np.where(np.isfinite(sims[at]), ids[at], -1)
            open_[at] &= ids[at] >= 0
        return ids, sims

    def _diverse(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, best first, those nearer to the point than to any chosen before; filled up with the best others."""
        vectors = self.x[ids]
        among = np.einsum("qid,qjd->qij", vectors, vectors)
        valid = (ids >= 0) & (ids != points[:, None])
        chosen = np.zeros(ids.shape, dtype=bool)
        for k in range(ids.shape[1]):
            closest = np.where(chosen, among[:, k], -np.inf).max(axis=1)
            chosen[:, k] = valid[:, k] & (sims[:, k] > closest) & (chosen.sum(axis=1) < most)
        score = np.where(valid, sims, -np.inf) + np.where(chosen, 4, 0)
        best = rank_best(score, min(most, ids.shape[1]))
        out = np.take_along_axis(ids, best, 1)
        return np.where(np.isfinite(np.take_along_axis(score, best, 1)), out, -1)

    def _insert(self, new: np.ndarray, done: int) -> None:
        top = len(self.near) - 1
        queries = self.x[new]
        start = np.zeros((len(new), 1), dtype=np.int64)
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        for level in range(top, -1, -1):
            rise = self.level[new] >= level
            ids, sims = self.search(queries, start, level, BUILD_BEAM if rise.any() else 1)
            start = ids[:, :1]
            if not rise.any():
                continue
            here = np.flatnonzero(rise)
            mates = np.where(rise[None, :], among[here], -np.inf)  # points of the batch see each other
            best = rank_best(mates, min(BUILD_BEAM, len(new)))
            mate_sims = np.take_along_axis(mates, best, 1)
            mate_ids = np.where(np.isfinite(mate_sims), new[best], -1)
            every = np.concatenate([ids[here], mate_ids], axis=1)
            score = np.concatenate([sims[here], mate_sims], axis=1)
            order = rank_best(score, min(BUILD_BEAM, score.shape[1]))
            every, score = np.take_along_axis(every, order, 1), np.take_along_axis(score, order, 1)
            width = self.near[level].shape[1]
            links = self._diverse(new[here], every, score, width // 2)
            self.near[level][new[here], : links.shape[1]] = links
            self._link_back(new[here], links, level)

    def _link_back(self, points: np.ndarray, links: np.ndarray, level: int) -> None:
        near = self.near[level]
        to, back = links.ravel(), np.repeat(points, links.shape[1])
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        owner, first, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(owner), count.max(initial=0)), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(owner)), count), np.arange(len(to)) - np.repeat(first, count)] = back
        for at in range(0, len(owner), BATCH):
            own = owner[at : at + BATCH]
            ids = np.sort(np.concatenate([near[own], extra[at : at + BATCH]], axis=1), axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("qd,qkd->qk", self.x[own], self.x[ids])
            sims[ids < 0] = -np.inf
            order = rank_best(sims, min(sims.shape[1], 2 * BUILD_BEAM))
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            kept = self._diverse(own, ids, sims, near.shape[1])
            near[own] = -1
            near[own, : kept.shape[1]] = kept
