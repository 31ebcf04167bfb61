"""Kernels of a flat proximity graph over the unit vectors of one shard: build by robust pruning, beam search, range expansion.

An adjacency is an integer matrix, one row a vector, filled up with -1. Searches run for many queries in step: each step
expands the nearest open vectors of every query's beam at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Queries that run in step, and open vectors of a beam that one step expands.
BLOCK, WIDTH = 256, 4
#: Squared distances below this can't be told apart in single precision: such vectors don't cover each other.
NOISE = 2e-6
#: Up to so many vectors the cosines of all of them are held at once.
DENSE = 2048


def medoid(x: np.ndarray) -> int:
    """The vector nearest to the mean direction of all."""
    return int(np.argmax(x @ x.mean(0)))


def _first_seen(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """``ids`` row by row with -1 for what was seen before or stands twice in a row; marks the rest as seen."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    rows = np.arange(len(ids))[:, None]
    ids[seen[rows, ids] & (ids >= 0)] = -1
    at = np.nonzero(ids >= 0)
    seen[at[0], ids[at]] = True
    return ids


def beam_search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ``beam`` nearest vectors that a greedy search from ``start`` finds (-1: fewer), and their cosines."""
    q, n = len(queries), len(x)
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    ids = np.full((q, beam), -1)
    sims = np.full((q, beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = start, queries @ x[start]
    done = np.ones((q, beam), bool)
    done[:, 0] = False
    rows = np.arange(q)[:, None]
    while True:
        live = np.flatnonzero((~done).any(1))
        if not len(live):
            return ids, sims
        here = rows[: len(live)]
        closed = np.where(done[live], -np.inf, sims[live])
        pick = np.argsort(-closed, axis=1)[:, :WIDTH]
        from_ = np.where(np.isneginf(closed[here, pick]), -1, ids[live][here, pick])
        done[live[:, None], pick] = True
        near = np.where(from_[:, :, None] >= 0, adj[from_], -1).reshape(len(live), -1)
        fresh = seen[live]
        near = _first_seen(near, fresh)
        seen[live] = fresh
        got = np.where(near >= 0, np.einsum("qkd,qd->qk", x[near], queries[live]), -np.inf).astype(np.float32)
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], got], 1)
        all_done = np.concatenate([done[live], near < 0], 1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live], done[live] = all_ids[here, best], all_sims[here, best], all_done[here, best]


def robust_prune(x: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int, alpha: float, cos: np.ndarray | None = None) -> np.ndarray:
    """Out-neighbours of the vectors ``at``, one row each, of the candidates ``cand`` (-1: none): the nearest one is taken
    and all that lie nearer to it, by ``alpha``, than to the vector are passed over, until ``degree`` are taken. ``cos``:
    cosines of all vectors, where they are few enough."""
    q = len(at)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == at[:, None]] = -1
    if cos is None:
        v = x[cand]
        own = np.where(cand >= 0, 2 - 2 * np.einsum("qkd,qd->qk", v, x[at]), np.inf)
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    else:
        own = np.where(cand >= 0, 2 - 2 * cos[at[:, None], cand], np.inf)
    out, rows = np.full((q, degree), -1), np.arange(q)
    for i in range(degree):
        best = np.argmin(own, axis=1)
        ok = np.isfinite(own[rows, best])
        if not ok.any():
            break
        out[ok, i] = cand[rows, best][ok]
        apart = between[rows, best] if cos is None else 2 - 2 * cos[cand[rows, best][:, None], cand]
        covered = alpha * alpha * apart + NOISE <= own
        covered[rows, best] = True
        own[covered] = np.inf
    return out


def _packed(heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``heads`` and a matrix of their ``tails``, filled up with -1."""
    order = np.argsort(heads, kind="stable")
    heads, tails = heads[order], tails[order]
    which, first, count = np.unique(heads, return_index=True, return_counts=True)
    out = np.full((len(which), count.max() if len(which) else 0), -1)
    row = np.repeat(np.arange(len(which)), count)
    out[row, np.arange(len(heads)) - np.repeat(first, count)] = tails
    return which, out


def _adopt(x: np.ndarray, adj: np.ndarray, at: np.ndarray, cand: np.ndarray, alpha: float, cos: np.ndarray | None = None) -> None:
    """Give the vectors ``at`` neighbours out of ``cand`` and add the edges back, pruned where they are too many."""
    degree = adj.shape[1]
    for i in range(0, len(at), BLOCK):
        adj[at[i : i + BLOCK]] = robust_prune(x, at[i : i + BLOCK], cand[i : i + BLOCK], degree, alpha, cos)
    heads, tails = adj[at].ravel(), np.repeat(at, degree)
    heads, back = _packed(heads[heads >= 0], tails[heads >= 0])
    wide = 4 * degree
    for j in range(0, back.shape[1], wide):  # a vector that very many call near takes them in by parts
        size = (back[:, j : j + wide] >= 0).sum(1)
        order = np.argsort(size, kind="stable")[(size == 0).sum() :]  # blocks of about equal width
        for i in range(0, len(order), BLOCK):
            some = order[i : i + BLOCK]
            m = heads[some]
            both = np.sort(np.concatenate([adj[m], back[some, j : j + size[some[-1]]]], 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(1) > degree
            if full.any():
                adj[m[full]] = robust_prune(x, m[full], both[full], degree, alpha, cos)
            if (~full).any():
                adj[m[~full]] = np.sort(both[~full], axis=1)[:, ::-1][:, :degree]


def build(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 1) -> np.ndarray:
    """The adjacency of all vectors. Up to ``DENSE`` of them are pruned once, of the ``beam`` nearest of each; more are inserted in
    batches of doubling size, then every vector is searched and pruned once more."""
    n = len(x)
    adj = np.full((n, degree), -1)
    if n <= degree + 1:
        for i in range(n):
            adj[i, : n - 1] = np.delete(np.arange(n), i)
        return adj
    if n <= DENSE:
        cos = x @ x.T
        others = cos.copy()
        np.fill_diagonal(others, -np.inf)
        beam = min(beam, n - 1)
        _adopt(x, adj, np.arange(n), np.argpartition(-others, beam - 1, axis=1)[:, :beam], alpha, cos)
        return adj
    start = medoid(x)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    first = order[: degree + 1]
    _adopt(x, adj, first, np.tile(first, (len(first), 1)), alpha)
    spans, done = [], len(first)
    while done < n:
        size = min(done, max(n // 8, BLOCK), n - done)
        spans.append(order[done : done + size])
        done += size
    again = [order[i : i + max(n // 8, BLOCK)] for i in range(0, n, max(n // 8, BLOCK))]
    for at in spans + again:
        cand = np.concatenate([beam_search(x, adj, x[at[i : i + BLOCK]], start, beam)[0] for i in range(0, len(at), BLOCK)])
        _adopt(x, adj, at, np.concatenate([cand, adj[at]], 1), alpha)
    return adj


def range_search(x: np.ndarray, adj: np.ndarray, least: float, slack: float = 0.02, beam: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, vector) positions whose cosine is ``least`` or more, as far as the search finds them.

    Every vector is a query: a greedy search from the medoid fills its beam; then all vectors found within ``least`` less
    ``slack`` are expanded, and what is found within that in turn, until nothing new is. Up to ``DENSE`` vectors are
    expanded from the query itself, whose place in the graph is known, all of a block in step.
    """
    if len(x) < 2:
        return
    if len(x) <= DENSE:
        yield from _expanded(x, adj, least, slack)
        return
    start, n = medoid(x), len(x)
    for i in range(0, n, BLOCK):
        queries = x[i : i + BLOCK]
        ids, sims = beam_search(x, adj, queries, start, beam)
        at = np.nonzero((sims >= least - slack) & (ids >= 0))
        q, v, s = at[0], ids[at], sims[at]
        # not what the beam search has looked at: what fell out of a full beam may be near all the same
        seen = np.zeros((len(queries), n), bool)
        seen[q, v] = True
        while len(q):
            hit = (s >= least - 1e-5) & (q + i != v)
            yield q[hit] + i, v[hit]
            new_q, new_v, new_s = [], [], []
            for j in range(0, len(q), 4096):
                near = adj[v[j : j + 4096]]
                key = (q[j : j + 4096, None] * n + near)[near >= 0]
                key = np.unique(key[~seen.ravel()[key]])
                seen.ravel()[key] = True
                a, b = key // n, key % n
                c = np.einsum("kd,kd->k", queries[a], x[b])
                close = c >= least - slack
                new_q.append(a[close])
                new_v.append(b[close])
                new_s.append(c[close])
            q, v, s = np.concatenate(new_q), np.concatenate(new_v), np.concatenate(new_s)


def _expanded(x: np.ndarray, adj: np.ndarray, least: float, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(x)
    edge = np.zeros((n, n), np.float32)
    edge[np.repeat(np.arange(n), adj.shape[1])[adj.ravel() >= 0], adj[adj >= 0]] = 1
    for i in range(0, n, BLOCK):
        cos = x[i : i + BLOCK] @ x.T
        near = cos >= least - slack
        front = np.zeros(cos.shape, bool)
        front[np.arange(len(cos)), np.arange(i, i + len(cos))] = True
        seen = front.copy()
        while front.any():
            q = np.flatnonzero(front.any(1))
            front[q] = (front[q].astype(np.float32) @ edge > 0) & near[q] & ~seen[q]
            seen |= front
        seen[np.arange(len(cos)), np.arange(i, i + len(cos))] = False
        q, v = np.nonzero(seen & (cos >= least - 1e-5))
        yield q + i, v


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids of at most ``k`` clusters of directions."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), c)
    return c
