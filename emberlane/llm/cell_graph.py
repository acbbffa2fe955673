"""NN-descent and greedy walks over the vectors of one cell, which fit in memory.

Pairs are compared in the cell's own precision; whatever is close for its distance from zero, and every distance that is handed
out, is taken by differences.
"""

from __future__ import annotations

import numpy as np

#: Pairs closer than this share of their squared lengths are measured again by differences.
CLOSE = {np.dtype(np.float32): 1e-3, np.dtype(np.float64): 1e-6}
#: Lists compared at once, pairs merged at once, queries walked at once, and nodes a query visits at once.
LISTS, PAIRS, QUERIES, AHEAD = 128, 1 << 20, 128, 32


def working(*vectors: np.ndarray) -> type:
    """The least precision in which squares neither overflow nor vanish."""
    for vec in vectors:
        if vec.dtype != np.float32:
            return np.float64
        largest = np.abs(vec).max(axis=1)
        if len(largest) and not 1e-6 < largest.min() <= largest.max() < 1e15:
            return np.float64
    return np.float32


def _places(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each item within its group, and where groups begin. Groups lie together."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.empty(0, np.int64)
    sizes = np.diff(first, append=len(groups))
    return np.arange(len(groups)) - np.repeat(first, sizes), first


def _between(rows: np.ndarray, few: int, absent: np.ndarray) -> np.ndarray:
    """Squared distances (g, few, c) of each list's first ``few`` members to all; to itself and to absent ones infinite."""
    square = np.einsum("gcd,gcd->gc", rows, rows)
    square[absent] = np.inf
    d = np.matmul(rows[:, :few] * rows.dtype.type(-2), rows.transpose(0, 2, 1))
    both = square[:, :few, None] + square[:, None]
    with np.errstate(invalid="ignore", over="ignore"):
        d += both
        d[:, np.arange(few), np.arange(few)] = np.inf
        both *= rows.dtype.type(CLOSE[rows.dtype])
        at = np.flatnonzero(d < both)
    if len(at):
        g, i, j = np.unravel_index(at, d.shape)
        apart = rows[g, i] - rows[g, j]
        d.reshape(-1)[at] = np.einsum("rd,rd->r", apart, apart)
    return d


class CellGraph:
    """The ``k`` nearest found of each vector: ``near`` (-1 where there are fewer), ``dist`` and, while building, ``fresh``."""

    def __init__(self, vec: np.ndarray, *, k: int, sample: int, trees: int, rounds: int, leaf: int, seed: int):
        self.vec, self.k, self.sample, self.rng = vec, k, sample, np.random.default_rng(seed)
        m = len(vec)
        self.near, self.dist = np.full((m, k), -1, np.int32), np.full((m, k), np.inf, vec.dtype)
        self.fresh, self.worst = np.zeros((m, k), bool), np.full(m, np.inf, vec.dtype)
        for _ in range(trees):
            self._leaves(leaf)
        for _ in range(rounds):
            self._join()
            if (self.fresh & (self.near >= 0)).sum() <= 0.01 * k * m:
                break

    def links(self) -> np.ndarray:
        """Each node's neighbours and a sample of those it is a neighbour of, -1 where there are fewer."""
        return np.hstack([self.near, self._back()[0]])

    def _leaves(self, leaf: int) -> None:
        """Neighbours within leaves, made by halving the cell along random directions."""
        vec, m = self.vec, len(self.vec)
        order, cuts = np.arange(m), np.array([0, m])
        while len(cuts) - 1 < m / leaf:
            side = vec @ self.rng.normal(size=vec.shape[1]).astype(vec.dtype)
            order = order[np.lexsort((side[order], np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))))]
            cuts = np.sort(np.concatenate([cuts, (cuts[:-1] + cuts[1:]) // 2]))
        most = int(np.diff(cuts).max())
        few = min(self.k, most - 1)
        if few < 1:
            return
        step = max(1, (1 << 18) // (most * most))
        held: list[tuple] = []
        for at in range(0, len(cuts) - 1, step):
            begin, end = cuts[:-1][at : at + step, None], cuts[1:][at : at + step, None]
            absent = begin + np.arange(most) >= end
            node = order[np.minimum(begin + np.arange(most), m - 1)]
            rows = vec[node]
            rows -= rows[:, :1].copy()
            d = _between(rows, most, absent)
            nearest = np.argpartition(d, few - 1, axis=2)[:, :, :few]
            d = np.take_along_axis(d, nearest, axis=2)
            ok = np.isfinite(d)
            source = np.broadcast_to(node[:, :, None], ok.shape)[ok]
            held.append((source, node[np.arange(len(node))[:, None, None], nearest][ok], d[ok]))
            if sum(len(h[0]) for h in held) > PAIRS or at + step >= len(cuts) - 1:
                self._merge(*(np.concatenate(part) for part in zip(*held, strict=True)))
                held = []

    def _merge(self, source: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        """Put pairs not known before into the lists of their first ones, as fresh."""
        m, k = self.near.shape
        key = source.astype(np.int64) * m + other
        order = np.argsort(key)
        key = key[order]
        once = order[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else order
        once = once[d[once] < self.worst[source[once]]]
        once = once[~(self.near[source[once]] == other[once][:, None]).any(axis=1)]
        if not len(once):
            return
        source, other, d = source[once], other[once], d[once]
        # They are in order of their sources; a sort by distances that keeps it.
        order = np.argsort(source.astype(np.int64) << 32 | d.view(np.int32)) if d.dtype == np.float32 else np.lexsort((d, source))
        source, other, d = source[order], other[order], d[order]
        nth, first = _places(source)
        rows, row = source[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(source)))
        ok = nth < k
        wide = int(nth[ok].max()) + 1
        ids, far = np.full((len(rows), wide), -1, np.int32), np.full((len(rows), wide), np.inf, d.dtype)
        ids[row[ok], nth[ok]], far[row[ok], nth[ok]] = other[ok], d[ok]
        far = np.hstack([self.dist[rows], far])
        best = np.argpartition(far, k - 1, axis=1)[:, :k]
        self.near[rows] = np.take_along_axis(np.hstack([self.near[rows], ids]), best, axis=1)
        self.fresh[rows] = np.take_along_axis(np.hstack([self.fresh[rows], ids >= 0]), best, axis=1)
        self.dist[rows] = far = np.take_along_axis(far, best, axis=1)
        self.worst[rows] = far.max(axis=1)

    def _back(self) -> tuple[np.ndarray, np.ndarray]:
        """A sample of the nodes that each node is a neighbour of but which are no neighbours of it, fresh ones first."""
        m, k = self.near.shape
        source, other = np.repeat(np.arange(m, dtype=np.int32), k), self.near.ravel()
        at = np.flatnonzero(other >= 0)
        source, other, fresh = source[at], other[at], self.fresh.ravel()[at]
        key = (other.astype(np.int64) << 32) + (~fresh).astype(np.int64) * (1 << 31) + self.rng.integers(0, 1 << 31, len(at))
        order = np.argsort(key)
        nth, _ = _places(other[order])
        order, nth = order[nth < self.sample], nth[nth < self.sample]
        back, new = np.full((m, self.sample), -1, np.int32), np.zeros((m, self.sample), bool)
        back[other[order], nth], new[other[order], nth] = source[order], fresh[order]
        for begin in range(0, m, 8192):
            part = slice(begin, begin + 8192)
            known = (back[part, :, None] == self.near[part, None]).any(axis=2)
            back[part][known], new[part][known] = -1, False
        return back, new

    def _join(self) -> None:
        """One round: members of a list, one of them fresh, are compared with each other."""
        back, new = self._back()
        near, fresh = self.near.copy(), self.fresh & (self.near >= 0)
        self.fresh[:] = False
        count = fresh.sum(axis=1) + new.sum(axis=1)
        # Lists with as many fresh members go together.
        order = np.argsort(-count, kind="stable")[: int((count > 0).sum())]
        width = near.shape[1] + back.shape[1]
        rows = np.empty((LISTS, width, self.vec.shape[1]), self.vec.dtype)
        held, pairs = [], 0
        for begin in range(0, len(order), LISTS):
            node = order[begin : begin + LISTS]
            member, is_new = np.hstack([near[node], back[node]]), np.hstack([fresh[node], new[node]])
            turn = np.argsort(np.where(member < 0, 2, 1) - is_new, axis=1, kind="stable")
            member, few = np.take_along_axis(member, turn, axis=1), int(count[node[0]])
            absent, own = member < 0, rows[: len(node)]
            np.take(self.vec, member, axis=0, out=own, mode="clip")
            # Relative to the list's node: distances within a list are small for vectors far from zero.
            own -= self.vec[node][:, None]
            d = _between(own, few, absent)
            worst = self.worst[member]
            old = np.arange(width) >= count[node][:, None]
            d[old[:, :few]] = np.inf
            for ok, forth in ((d < worst[:, :few, None], True), (d < np.where(old, worst, 0)[:, None], False)):
                at = np.flatnonzero(ok)
                i, j = at // width, at % width
                first, second = member[i // few, i % few], member[i // few, j]
                held.append((first, second, d.ravel()[at]) if forth else (second, first, d.ravel()[at]))
                pairs += len(at)
            if pairs > PAIRS or begin + LISTS >= len(order):
                self._merge(*(np.concatenate(part) for part in zip(*held, strict=True)))
                held, pairs = [], 0


def walk(vec: np.ndarray, links: np.ndarray, wanted: np.ndarray, own: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the ``beam`` best nodes of each of the ``wanted`` vectors, -1 where there are fewer.

    Walks start from the ``entries`` and from a vector's ``own`` node (-1: none), and end when no node of a beam is unvisited.
    """
    found = [_walk(vec, links, wanted[a : a + QUERIES], own[a : a + QUERIES], entries, beam) for a in range(0, len(wanted), QUERIES)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _walk(vec, links, wanted, own, entries, beam):
    queries, m = len(wanted), len(vec)
    beam = min(beam, m)
    seen = np.zeros(queries * m, bool)
    ids, dist, done = np.full((queries, beam), -1, np.int32), np.full((queries, beam), np.inf, vec.dtype), np.ones((queries, beam), bool)
    worst = np.full(queries, np.inf, vec.dtype)
    apart, asking = np.empty((2, 1024, vec.shape[1]), vec.dtype)

    def reach(key: np.ndarray) -> None:
        """Measure the (query, node) pairs not seen before and take the better ones into the beams."""
        key = key[~seen.take(key)]
        key.sort()
        if not len(key):
            return
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        seen[key] = True
        q, node = np.divmod(key, m)
        d = np.empty(len(key), vec.dtype)
        for a in range(0, len(key), len(apart)):
            some = slice(a, min(len(key), a + len(apart)))
            one, two = apart[: some.stop - a], asking[: some.stop - a]
            np.take(vec, node[some], axis=0, out=one, mode="clip")
            np.take(wanted, q[some], axis=0, out=two, mode="clip")
            one -= two
            np.einsum("rd,rd->r", one, one, out=d[some])
        ok = np.flatnonzero(d < worst.take(q))
        if not len(ok):
            return
        q, node, d = q[ok], node[ok], d[ok]
        nth, first = _places(q)
        rows, row, wide = q[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(q))), int(nth.max()) + 1
        far = np.full((len(rows), beam + wide), np.inf, vec.dtype)
        far[:, :beam] = dist[rows]
        far[row, beam + nth] = d
        best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        both = np.full((len(rows), beam + wide), -1, np.int32)
        both[:, :beam] = ids[rows]
        both[row, beam + nth] = node
        been = np.zeros((len(rows), beam + wide), bool)
        been[:, :beam] = done[rows]
        ids[rows], done[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(been, best, axis=1)
        dist[rows] = far = np.take_along_axis(far, best, axis=1)
        worst[rows] = far.max(axis=1)

    at = np.flatnonzero(own >= 0)
    reach(np.concatenate([(np.arange(queries)[:, None] * m + entries).ravel(), at * m + own[at]]))
    active = np.arange(queries)
    while len(active):
        ahead = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
        pick = np.argpartition(ahead, AHEAD - 1, axis=1)[:, :AHEAD] if beam > AHEAD else np.broadcast_to(np.arange(beam), ahead.shape)
        ok = np.isfinite(np.take_along_axis(ahead, pick, axis=1))
        row, place = np.nonzero(ok)
        query, place = active[row], pick[row, place]
        active = active[ok.any(axis=1)]
        if len(query):
            done[query, place] = True
            reached = links.take(ids[query, place], axis=0)
            reach((query[:, None] * m + reached)[reached >= 0])
    return ids, dist


class NearestRows:
    """The ``n`` nearest rows with another id than its own of each of the ``wanted`` vectors, ties to the smaller id.

    A product of matrices leaves out what is farther than the n nearest so far by more than the product's rounding.
    """

    def __init__(self, keys: np.ndarray, wanted: np.ndarray, n: int):
        self.keys, self.wanted, self.n, self.exact = keys, wanted, n, wanted.astype(np.float64)
        self.ids, self.scores = np.full((len(wanted), n), -1, np.int64), np.full((len(wanted), n), np.inf)

    def take(self, ids: np.ndarray, vec: np.ndarray) -> None:
        kind = working(vec, self.wanted)
        rows, asked = vec.astype(kind, copy=False), self.wanted.astype(kind, copy=False)
        slack = 1e-5 if kind == np.float32 else 1e-12
        with np.errstate(over="ignore", invalid="ignore"):
            # Squared lengths less their rounding; that of a row is one more number of its vector.
            far, length = (np.einsum("rd,rd->r", x, x) * kind(1 - slack) for x in (rows, asked))
            finite = np.isfinite(far).all() and np.isfinite(length).all()
            rows, asked = np.hstack([rows, far[:, None]]), np.hstack([asked * kind(-2), np.ones((len(asked), 1), kind)])
            for q in range(0, len(asked), 256):
                some = slice(q, q + 256)
                for r in range(0, len(rows), 1024):
                    part = slice(r, r + 1024)
                    d = asked[some] @ rows[part].T
                    first = np.flatnonzero(np.isinf(self.scores[some, -1]))
                    if len(first) and d.shape[1] > 8 * self.n:
                        near = np.argpartition(d[first], self.n, axis=1)[:, : self.n + 1]
                        self._settle(q + np.repeat(first, self.n + 1), near.ravel(), ids[part], vec[part])
                    bound = np.nextafter((self.scores[some, -1] ** 2 * (1 + slack) - length[some]).astype(kind), kind(np.inf))
                    near = d <= bound[:, None]
                    if not finite:
                        # What is no number, as lengths are too large, is measured.
                        near |= ~np.isfinite(d)
                    hit = np.flatnonzero(near) if near.any() else ()
                    if len(hit):
                        which, row = np.divmod(hit, d.shape[1])
                        self._settle(q + which, row, ids[part], vec[part])

    def _settle(self, which: np.ndarray, row: np.ndarray, ids: np.ndarray, vec: np.ndarray) -> None:
        """Take the rows that belong among the nearest; ``which`` is in order."""
        for a in range(0, len(which), 1 << 16):
            w, r = which[a : a + (1 << 16)], row[a : a + (1 << 16)]
            d = np.sqrt(((vec[r].astype(np.float64) - self.exact[w]) ** 2).sum(axis=1))
            ok = (d <= self.scores[w, -1]) & (ids[r] != self.keys[w])
            w, key, d = w[ok], ids[r[ok]], d[ok]
            if not len(w):
                continue
            touched = np.unique(w)
            w = np.concatenate([np.repeat(touched, self.n), w])
            key, d = np.concatenate([self.ids[touched].ravel(), key]), np.concatenate([self.scores[touched].ravel(), d])
            held = np.isfinite(d)
            w, key, d = w[held], key[held], d[held]
            # A row that comes again, or repeats an id, counts once, by the nearer.
            order = np.lexsort((d, key, w))
            w, key, d = w[order], key[order], d[order]
            once = np.concatenate([[True], (w[1:] != w[:-1]) | (key[1:] != key[:-1])])
            w, key, d = w[once], key[once], d[once]
            order = np.lexsort((key, d, w))
            w, key, d = w[order], key[order], d[order]
            nth, _ = _places(w)
            ok = nth < self.n
            self.ids[w[ok], nth[ok]], self.scores[w[ok], nth[ok]] = key[ok], d[ok]

    def given(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which wanted one, id, distance)."""
        which, nth = np.nonzero(np.isfinite(self.scores))
        return which, self.ids[which, nth], self.scores[which, nth]
