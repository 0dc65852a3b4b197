"""A hierarchical navigable small-world graph in flat numpy arrays, built and searched many vectors at a time.

Nodes are stored in random order. The nodes of a level are a prefix of those of the level below, so a level is one
array of neighbour slots (row = node, -1 = free). Searches run in lockstep: each step expands the best unexpanded
entries of every query's beam and scores all their unseen neighbours at once, so Python's cost is per step, not per vector.
"""

from __future__ import annotations

import numpy as np

M, CAP, KEEP = 12, 40, 24  # links of a new node; slots of a node; links left when its slots run over
EF_BUILD, RATIO, TOP = 32, 6, 4096  # beam of an insertion; nodes per node of the level above; most nodes of the top level
BLOCK, BATCH, PEERS, SEEN_BYTES = 1024, 1024, 8, 32 << 20


class Hnsw:
    """Index over the rows of ``x`` (unit vectors, float32). Row numbers in results are those of ``x``."""

    def __init__(self, x: np.ndarray, ef_build: int = EF_BUILD, seed: int = 7):
        self.ef_build = ef_build
        n = len(x)
        self.order = np.random.default_rng(seed).permutation(n)
        self.x = np.zeros((n + 1, x.shape[1]), np.float32)  # the last row stands for a free slot
        self.x[:n] = x[self.order]
        self.n = n
        self.sizes = [n]
        while len(self.sizes) == 1 and n > 64 or self.sizes[-1] > TOP:
            self.sizes.append(-(-self.sizes[-1] // RATIO))
        self.links: list[np.ndarray] = [np.empty(0)] * len(self.sizes)
        for level in range(len(self.sizes) - 1, -1, -1):
            self._build(level)

    # -- search ---------------------------------------------------------------------------------------------------

    def _entries(self, q: np.ndarray, level: int) -> np.ndarray:
        """Where the search of each query on ``level`` begins: the nearest nodes of the level above."""
        top = len(self.sizes) - 1
        m = self.sizes[top]
        s = q @ self.x[:m].T
        e = min(4, m)
        at = np.argpartition(-s, e - 1, axis=1)[:, :e] if m > e else np.broadcast_to(np.arange(m), (len(q), m))
        for up in range(top - 1, level, -1):
            ids, _ = self._beam(q, at, up, 8, 2)
            at = ids[:, :4]
        return at

    def _beam(self, q: np.ndarray, at: np.ndarray, level: int, ef: int, width: int, floor: float = -2.0, enough: int | None = None, hide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of up to ``ef`` nodes for each query, best first; id n and -inf where there are fewer.

        A query ends when its best unexpanded entry is below ``floor``, or below its ``enough``-th best.
        """
        links, n, b = self.links[level], self.n, len(q)
        enough = min(enough or ef, ef)
        seen = np.zeros((b, n + 1), bool)
        rows = np.arange(b)
        seen[:, n] = True
        if hide is not None:
            seen[rows, hide] = True
        ids, sim, done = np.full((b, ef), n, np.int32), np.full((b, ef), -np.inf, np.float32), np.zeros((b, ef), bool)
        out_ids, out_sim = ids.copy(), sim.copy()
        nb = at.astype(np.int32)
        new = ~seen[rows[:, None], nb]
        seen[rows[:, None], nb] = True
        while len(rows):
            r, c = np.nonzero(new)
            s = np.full(nb.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.x[nb[r, c]], q[rows[r]])
            ids, sim, done = np.concatenate([ids, nb], 1), np.concatenate([sim, s], 1), np.concatenate([done, np.zeros(nb.shape, bool)], 1)
            top = np.argpartition(-sim, ef - 1, axis=1)[:, :ef]
            ids, sim, done = (np.take_along_axis(v, top, 1) for v in (ids, sim, done))
            open_ = np.where(done, -np.inf, sim)
            w = min(width, ef - 1) or 1
            pick = np.argpartition(-open_, w - 1, axis=1)[:, :w] if ef > w else np.arange(ef)[None].repeat(len(rows), 0)
            ps = np.take_along_axis(open_, pick, 1)
            bar = np.partition(sim, ef - enough, axis=1)[:, ef - enough]
            go = ps.max(1) >= np.maximum(bar, floor)
            go &= ps.max(1) > -np.inf
            if not go.all():
                end = ~go
                out_ids[rows[end]], out_sim[rows[end]] = ids[end], sim[end]
                rows, ids, sim, done, pick, ps = (v[go] for v in (rows, ids, sim, done, pick, ps))
                if not len(rows):
                    break
            np.put_along_axis(done, pick, True, 1)
            chosen = np.where(ps > -np.inf, np.take_along_axis(ids, pick, 1), n)
            parts, fresh = [], []
            for j in range(chosen.shape[1]):  # one at a time, for two chosen nodes may share a neighbour
                nj = links[chosen[:, j]]
                fj = ~seen[rows[:, None], nj]
                seen[rows[:, None], nj] = True
                parts.append(nj)
                fresh.append(fj)
            nb, new = np.concatenate(parts, 1), np.concatenate(fresh, 1)
        by = np.argsort(-out_sim, axis=1, kind="stable")
        return np.take_along_axis(out_ids, by, 1), np.take_along_axis(out_sim, by, 1)

    def _blocks(self, n: int):
        step = max(16, min(BLOCK, SEEN_BYTES // (self.n + 1)))
        return (slice(i, min(i + step, n)) for i in range(0, n, step))

    def search(self, q: np.ndarray, k: int, ef: int = 40, floor: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest rows of each query and their similarities; -1 where there are fewer."""
        ids, sim = [], []
        for s in self._blocks(len(q)):
            i, v = self._beam(q[s], self._entries(q[s], 0), 0, ef, 3, floor, k)
            ids.append(i[:, :k])
            sim.append(v[:, :k])
        return self._out(np.concatenate(ids), np.concatenate(sim))

    def search_self(self, k: int, ef: int = 40, floor: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """As ``search`` with every row of the index as a query (not its own neighbour); it begins at the row's own links."""
        ids, sim = np.empty((self.n, k), np.int64), np.empty((self.n, k), np.float32)
        for s in self._blocks(self.n):
            own = np.arange(s.start, s.stop)
            i, v = self._beam(self.x[s], self.links[0][s], 0, ef, 3, floor, k, own)
            ids[self.order[s]], sim[self.order[s]] = self._out(i[:, :k], v[:, :k])
        return ids, sim

    def _out(self, ids: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(self.order, -1)[ids], sim

    # -- construction ---------------------------------------------------------------------------------------------

    def _build(self, level: int) -> None:
        size = self.sizes[level]
        links = self.links[level] = np.full((self.n + 1, CAP), self.n, np.int32)
        if level == len(self.sizes) - 1:  # bounded by TOP
            k = min(self.ef_build, size - 1)
            if k < 1:
                return
            s = self.x[:size] @ self.x[:size].T
            np.fill_diagonal(s, -np.inf)
            ids = np.argsort(-s, axis=1, kind="stable")[:, :k].astype(np.int32)
            self._insert(links, np.arange(size), ids, np.take_along_axis(s, ids, 1))
            return
        above = self.sizes[level + 1]
        links[:above] = self.links[level + 1][:above]
        start = above
        while start < size:
            stop = min(size, start + min(BATCH, max(64, start // 4)))
            cand, sims = [], []
            for s in self._blocks(stop - start):
                q = self.x[start + s.start : start + s.stop]
                i, v = self._beam(q, self._entries(q, level), level, self.ef_build, 3, enough=M + 2)
                # Nodes of one batch can't meet in the graph yet; they are compared with each other.
                peer = q @ self.x[start:stop].T
                peer[np.arange(len(q)), np.arange(s.start, s.stop)] = -np.inf
                few = min(PEERS, stop - start)
                at = np.argpartition(-peer, few - 1, axis=1)[:, :few]
                i, v = np.concatenate([i, (at + start).astype(np.int32)], 1), np.concatenate([v, np.take_along_axis(peer, at, 1)], 1)
                by = np.argsort(-v, axis=1, kind="stable")[:, : self.ef_build]
                cand.append(np.take_along_axis(i, by, 1))
                sims.append(np.take_along_axis(v, by, 1))
            self._insert(links, np.arange(start, stop), np.concatenate(cand), np.concatenate(sims))
            start = stop

    def _select(self, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """``m`` of each node's candidates (best first): the nearest half, those nearer to it than to any kept before, then the next nearest."""
        out = np.empty((len(ids), m), np.int32)
        for i in range(0, len(ids), BLOCK):
            d, s = ids[i : i + BLOCK], sim[i : i + BLOCK]
            v = self.x[d]
            between = v @ v.transpose(0, 2, 1)
            closest = np.full(d.shape, -np.inf, np.float32)
            kept = np.zeros(d.shape, bool)
            for j in range(d.shape[1]):
                ok = (s[:, j] > closest[:, j]) & (s[:, j] > -np.inf)
                kept[:, j] = ok
                np.maximum(closest, between[:, j], out=closest, where=ok[:, None])
            first = np.argsort(-(s + 4 * kept + 8 * (np.arange(d.shape[1]) < m // 2)), axis=1, kind="stable")[:, :m]
            got = np.where(np.take_along_axis(s, first, 1) > -np.inf, np.take_along_axis(d, first, 1), self.n)
            out[i : i + BLOCK] = got if got.shape[1] == m else np.pad(got, ((0, 0), (0, m - got.shape[1])), constant_values=self.n)
        return out

    def _insert(self, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        """Links new nodes with their candidates, both ways."""
        n = self.n
        chosen = self._select(ids, sim, min(M, ids.shape[1]))
        links[nodes, : chosen.shape[1]] = chosen
        u, j = np.nonzero(chosen < n)
        v, u = chosen[u, j], nodes[u]
        known = (links[v] == u[:, None]).any(1)  # where both are new
        v, u = v[~known], u[~known]
        by = np.argsort(v, kind="stable")
        v, u = v[by], u[by]
        begin = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, int)
        count = np.diff(np.r_[begin, len(v)])
        pos = np.arange(len(v)) - np.repeat(begin, count)
        used = (links[v] < n).sum(1)
        slot = used + pos
        fits = slot < CAP
        full, over = np.unique(v[~fits]), {}
        old = {t: links[t].copy() for t in full} if len(full) else over
        links[v[fits], slot[fits]] = u[fits]
        if len(full):
            # Slots run over: choose again among the old links and the nearest of the new ones.
            s = np.einsum("ij,ij->i", self.x[u], self.x[v])
            many = np.isin(v, full)
            v, u, s = v[many], u[many], s[many]
            by = np.lexsort((-s, v))
            v, u, s = v[by], u[by], s[by]
            begin = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            pos = np.arange(len(v)) - np.repeat(begin, np.diff(np.r_[begin, len(v)]))
            near = pos < CAP
            where = np.searchsorted(full, v)
            cand = np.full((len(full), 2 * CAP), n, np.int32)
            cand[:, :CAP] = np.stack([old[t] for t in full])
            cand[where[near], CAP + pos[near]] = u[near]
            cs = np.where(cand < n, np.einsum("imj,ij->im", self.x[cand], self.x[full]), -np.inf).astype(np.float32)
            by = np.argsort(-cs, axis=1, kind="stable")
            cand, cs = np.take_along_axis(cand, by, 1), np.take_along_axis(cs, by, 1)
            links[full] = n
            links[full, :KEEP] = self._select(cand, cs, KEEP)
