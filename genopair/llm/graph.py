"""Neighbour graphs in NumPy, searched and built for many points at a time.

Points of one shard only; Spark decides what is a shard. Distances are squared Euclidean ones in
single precision; callers rescore what they return.
"""

import numpy as np


def distances(points: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_norms: np.ndarray) -> np.ndarray:
    """From each query to the points in its row of ``ids``."""
    dots = np.matmul(points[ids], queries[:, :, None])[:, :, 0]
    return norms[ids] + query_norms[:, None] - 2.0 * dots


class Graph:
    """Out-neighbours of each point, in rows padded with -1."""

    def __init__(self, points: np.ndarray, degree: int):
        self.points = np.ascontiguousarray(points, np.float32)
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.degree = degree
        self.out = np.full((len(points), degree), -1, np.int32)

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest points that greedy expansion from ``entry`` (one row of points for each query) meets.

        Ids and distances by distance; -1 and infinity where fewer were met.
        """
        n_q = len(queries)
        rows = np.arange(n_q)
        q_norms = np.einsum("ij,ij->i", queries, queries)
        seen = np.zeros((n_q, len(self.points)), bool)
        ids = np.full((n_q, beam), -1, np.int32)
        dist = np.full((n_q, beam), np.inf, np.float32)
        done = np.ones((n_q, beam), bool)

        def admit(who, cand):
            """Put fresh candidates of the queries ``who`` into their beams."""
            fresh = cand >= 0
            at = np.where(fresh, cand, 0)
            fresh &= ~seen[who[:, None], at]
            # A candidate that two expanded points share counts once.
            order = np.argsort(np.where(fresh, at, -1), axis=1, kind="stable")
            sorted_at = np.take_along_axis(np.where(fresh, at, -1), order, 1)
            keep = np.ones_like(fresh)
            keep[:, 1:] = sorted_at[:, 1:] != sorted_at[:, :-1]
            at, fresh = np.maximum(sorted_at, 0), keep & (sorted_at >= 0)
            r, c = np.nonzero(fresh)
            seen[who[r], at[r, c]] = True
            d = np.where(fresh, distances(self.points, self.norms, at, queries[who], q_norms[who]), np.inf).astype(np.float32)
            all_d = np.concatenate([dist[who], d], axis=1)
            all_i = np.concatenate([ids[who], np.where(fresh, at, -1)], axis=1)
            all_done = np.concatenate([done[who], ~fresh], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[who], ids[who], done[who] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_done))

        admit(rows, entry.astype(np.int32))
        while True:
            open_ = ~done
            who = np.flatnonzero(open_.any(axis=1))
            if not len(who):
                return ids, dist
            pick = open_[who] & (np.cumsum(open_[who], axis=1) <= step)
            first = np.argsort(~pick, axis=1, kind="stable")[:, :step]
            chosen = np.where(np.take_along_axis(pick, first, 1), np.take_along_axis(ids[who], first, 1), -1)
            done[who] |= pick
            near = np.where(chosen[:, :, None] >= 0, self.out[np.maximum(chosen, 0)], -1)
            admit(who, near.reshape(len(who), -1))

    def prune(self, who: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """Diverse neighbours for the points ``who`` out of their rows of candidates.

        From the nearest on, a candidate stays unless one that stayed is ``alpha`` times nearer to it than
        the point is (distances, not squares); free places go to the nearest of the others.
        """
        q = self.points[who]
        at = np.maximum(cand, 0)
        d = distances(self.points, self.norms, at, q, self.norms[who])
        d = np.where((cand >= 0) & (cand != who[:, None]), d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        cand, at, d = (np.take_along_axis(x, order, 1) for x in (cand, at, d))
        same = np.zeros(cand.shape, bool)
        for k in range(1, cand.shape[1]):
            same[:, k] = (cand[:, k : k + 1] == cand[:, :k]).any(axis=1)
        alive = np.isfinite(d) & ~same
        x = self.points[at]
        between = np.maximum(self.norms[at][:, :, None] + self.norms[at][:, None, :] - 2.0 * np.matmul(x, x.transpose(0, 2, 1)), 0.0)
        hidden = between * (alpha * alpha) <= d[:, None, :]
        stay = np.zeros(cand.shape, bool)
        for k in range(cand.shape[1]):
            stay[:, k] = alive[:, k] & ~(stay & hidden[:, :, k]).any(axis=1)
        stay &= np.cumsum(stay, axis=1) <= self.degree
        rest = alive & ~stay
        rest &= np.cumsum(rest, axis=1) <= (self.degree - stay.sum(axis=1))[:, None]
        take = np.argsort(~(stay | rest), axis=1, kind="stable")[:, : self.degree]
        out = np.where(np.take_along_axis(stay | rest, take, 1), np.take_along_axis(cand, take, 1), -1)
        full = np.full((len(who), self.degree), -1, np.int32)
        full[:, : out.shape[1]] = out
        return full

    def connect(self, who: np.ndarray, cand: np.ndarray, alpha: float) -> None:
        """Set pruned out-edges of ``who`` and add the reverse edges, pruned where a row is full."""
        chosen = self.prune(who, cand, alpha)
        self.out[who] = chosen
        src = np.repeat(who, self.degree)[chosen.ravel() >= 0].astype(np.int32)
        dst = chosen.ravel()[chosen.ravel() >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        target, start, n = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(target), 512):
            t, s, m = target[at : at + 512], start[at : at + 512], n[at : at + 512]
            width = min(int(m.max()), 2 * self.degree)
            col = np.arange(width)
            # Of more new edges than fit, those from the nearest points.
            new = np.full((len(t), int(m.max())), -1, np.int32)
            inside = np.arange(new.shape[1]) < m[:, None]
            new[inside] = src[np.concatenate([np.arange(a, a + b) for a, b in zip(s, m)])]
            if new.shape[1] > width:
                d = distances(self.points, self.norms, np.maximum(new, 0), self.points[t], self.norms[t])
                new = np.take_along_axis(new, np.argsort(np.where(new >= 0, d, np.inf), axis=1, kind="stable")[:, col], 1)
            both = np.concatenate([self.out[t], new], axis=1)
            known = (new[:, :, None] == self.out[t][:, None, :]).any(axis=2)
            both[:, self.degree :][known] = -1
            fits = (both >= 0).sum(axis=1) <= self.degree
            row = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : self.degree]
            if (~fits).any():
                row[~fits] = self.prune(t[~fits], both[~fits], alpha)
            self.out[t] = row


def exact_neighbours(points: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of ``among`` for each of ``among``, by brute force on a small set."""
    x = points[among]
    d = (x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2.0 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(among) - 1)
    if k < 1:
        return np.full((len(among), 1), -1, np.int32)
    return among[np.argsort(d, axis=1, kind="stable")[:, :k]].astype(np.int32)


class HNSW:
    """Layers of graphs; each higher one holds a smaller sample of the points and gives the entry to the one below."""

    def __init__(self, points: np.ndarray, keys: np.ndarray, degree: int = 16, beam: int = 48, batch: int = 512):
        n = len(points)
        u = ((keys >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        level = np.minimum((-np.log(u) / np.log(degree)).astype(np.int64), 8)
        self.layers: list[tuple[np.ndarray, Graph]] = []  # the lowest last
        for k in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= k)
            # Members of the layer above come first: they are where later ones enter.
            members = members[np.argsort(-level[members], kind="stable")]
            graph = Graph(points[members], degree if k else 2 * degree)
            self._build(graph, points[members], beam, batch)
            self.layers.append((members, graph))
        self.n = n

    def _build(self, graph: Graph, points: np.ndarray, beam: int, batch: int) -> None:
        first = min(batch, len(points))
        among = np.arange(first)
        graph.connect(among, exact_neighbours(points, among, beam), 1.0)
        upper = len(self.layers[-1][0]) if self.layers else 0
        at = first
        while at < len(points):
            who = np.arange(at, min(at + batch, len(points)))
            entry = np.zeros((len(who), 1), np.int32)
            if upper:
                found = self._descend(points[who], len(self.layers))
                entry = np.where(found < at, found, 0)
            near, _ = graph.search(points[who], entry, beam)
            cand = np.concatenate([near, exact_neighbours(points, who, beam // 2)], axis=1)
            graph.connect(who, cand, 1.0)
            at = who[-1] + 1

    def _descend(self, queries: np.ndarray, layers: int) -> np.ndarray:
        """Entry points in the layer below the first ``layers``: numbers among that layer's members, which begin with those above."""
        entry = np.zeros((len(queries), 1), np.int32)
        for _, graph in self.layers[:layers]:
            near, _ = graph.search(queries, entry, 4, 1)
            entry = near[:, :1]
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        members, graph = self.layers[-1]
        near, dist = graph.search(queries, self._descend(queries, len(self.layers) - 1), beam)
        return np.where(near >= 0, members[np.maximum(near, 0)], -1), dist


def vamana(points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 512, seed: int = 0) -> tuple[Graph, int]:
    """A robust-pruned graph and its entry, the point nearest to the mean."""
    graph = Graph(points, degree)
    n = len(points)
    mean = graph.points.mean(axis=0)
    entry = int(np.argmin(((graph.points - mean) ** 2).sum(axis=1)))
    rng = np.random.default_rng(seed)
    if n > 1:
        draw = rng.integers(0, n - 1, size=(n, min(degree, n - 1)))
        graph.out[:, : draw.shape[1]] = draw + (draw >= np.arange(n)[:, None])
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            who = order[at : at + batch]
            near, _ = graph.search(graph.points[who], np.full((len(who), 1), entry), beam)
            graph.connect(who, np.concatenate([near, graph.out[who]], axis=1), a)
    return graph, entry
