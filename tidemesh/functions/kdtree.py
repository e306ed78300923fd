"""Nearest neighbours in numpy: leaves of a whole cloud for the cluster, and exact searches within one leaf's points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Leaves:
    """Median splits of every group's sample; a leaf is named by a number, groups without a sample have leaf -1.

    Leaves tile space, so every place of a group that has a sample lies in one leaf. They only decide where points and
    queries meet.
    """

    def __init__(self, groups: np.ndarray, xyz: np.ndarray, most: int):
        """`groups` (hashes) and places of a sample; leaves hold at most `most` of it, unless those lie at one place."""
        self.axis, self.split, self.left, self.right = [], [], [], []
        self.low, self.high, self.tree = [], [], []
        order = np.argsort(groups, kind="stable")
        names, first = np.unique(groups[order], return_index=True)
        self.names = names
        self.roots = np.array([self._grow(xyz[rows], most, t, np.full(3, -np.inf), np.full(3, np.inf)) for t, rows in enumerate(np.split(order, first[1:]))] if len(names) else [], int)
        self.axis, self.left, self.right, self.tree = (np.array(v, int) for v in (self.axis, self.left, self.right, self.tree))
        self.split = np.array(self.split, float)
        self.low, self.high = (np.array(v, float).reshape(-1, 3) for v in (self.low, self.high))

    def _grow(self, xyz: np.ndarray, most: int, tree: int, low: np.ndarray, high: np.ndarray) -> int:
        me = len(self.axis)
        for v in (self.axis, self.split, self.left, self.right):
            v.append(-1)
        cut = None
        if len(xyz) > most:
            a = int(np.argmax(np.ptp(xyz, axis=0)))
            v = np.sort(xyz[:, a])
            at = v[len(v) // 2]
            cut = at if at > v[0] else v[np.searchsorted(v, at, "right")] if v[-1] > at else None
        if cut is None:
            self.left[me] = len(self.low)
            self.low.append(low), self.high.append(high), self.tree.append(tree)
            return me
        below, above = high.copy(), low.copy()
        below[a] = above[a] = cut
        under = xyz[:, a] < cut
        self.axis[me], self.split[me] = a, cut
        self.left[me] = self._grow(xyz[under], most, tree, low, below)
        self.right[me] = self._grow(xyz[~under], most, tree, above, high)
        return me

    def of(self, groups: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        """The leaf of every place."""
        out = np.full(len(xyz), -1)
        if not len(self.names):
            return out
        k = np.minimum(np.searchsorted(self.names, groups), len(self.names) - 1)
        known = self.names[k] == groups
        node = self.roots[k]
        open_ = np.flatnonzero(known & (self.axis[node] >= 0))
        while len(open_):
            n = node[open_]
            node[open_] = np.where(xyz[open_, self.axis[n]] < self.split[n], self.left[n], self.right[n])
            open_ = open_[self.axis[node[open_]] >= 0]
        out[known] = self.left[node[known]]
        return out


def places(t: pa.Table | pa.RecordBatch, prefix: str = "") -> np.ndarray:
    return np.stack([t.column(f"{prefix}{a}").to_numpy(**({"zero_copy_only": False} if isinstance(t, pa.RecordBatch) else {})) for a in "xyz"], 1)


def ranks(ids) -> np.ndarray:
    """Numbers in the order of the ids."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    out = np.empty(len(ids), int)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def first_of_place(xyz: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Rows of the `most` smallest ranks at every place, in their order of place."""
    order = np.lexsort((rank, *xyz.T))
    if not len(order):
        return order
    v = xyz[order]
    new = np.r_[True, (v[1:] != v[:-1]).any(1)]
    start = np.flatnonzero(new)
    return order[np.arange(len(order)) - start[np.cumsum(new) - 1] < most]


def _near2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances to boxes, summed as those of points are, so that no box is farther than a point in it."""
    gap = np.maximum(np.maximum(low - q, q - high), 0.0)
    gap *= gap
    return gap[..., 0] + gap[..., 1] + gap[..., 2]


def to_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of every place to every box."""
    return _near2(q[:, None], low, high)


def _d2(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    d *= d
    return d[..., 0] + d[..., 1] + d[..., 2]


def search(xyz: np.ndarray, rank: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, d2) of the k nearest points of every query within its bound (squared, inclusive), by query, d2 and rank. own: the point that a query is, -1 for none, is left out."""
    none = np.empty(0, int), np.empty(0, int), np.empty(0)
    if not len(q) or not len(xyz):
        return none
    perm = first_of_place(xyz, rank, k + 1)
    xyz, rank = xyz[perm], rank[perm]
    if own is not None:
        back = np.full(int(perm.max()) + 1, -1)
        back[perm] = np.arange(len(perm))
        own = np.where((own >= 0) & (own < len(back)), back[np.clip(own, 0, len(back) - 1)], -1)
    n, depth = len(xyz), 0
    while n >> (depth + 1) >= max(8, k + 2):
        depth += 1
    order, start, levels = np.arange(n), np.array([0]), []
    for level in range(depth + 1):
        v = xyz[order]
        low, high = np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)
        levels.append((low, high))
        if level < depth:
            size = np.diff(np.r_[start, n])
            node = np.repeat(np.arange(len(start)), size)
            along = v[np.arange(n), np.argmax(high - low, 1)[node]]
            order = order[np.lexsort((along, node))]
            start = np.stack([start, start + size // 2], 1).ravel()
    size = np.diff(np.r_[start, n])
    wide = np.arange(size.max())
    sorted_ = xyz[order]
    out = []
    for a in range(0, len(q), 2048):
        mine, far = q[a : a + 2048], bound[a : a + 2048].copy()
        me = own[a : a + 2048] if own is not None else None
        rows = np.arange(len(mine))
        node = np.zeros(len(mine), int)
        for low, high in levels[1:]:
            pair = _near2(mine[:, None], low[np.stack([2 * node, 2 * node + 1], 1)], high[np.stack([2 * node, 2 * node + 1], 1)])
            node = 2 * node + (pair[:, 1] < pair[:, 0])
        at = np.minimum(start[node][:, None] + wide, n - 1)
        d = _d2(sorted_[at], mine[:, None])
        d[wide >= size[node][:, None]] = np.inf
        if me is not None:
            d[order[at] == me[:, None]] = np.inf
        if d.shape[1] >= k:
            far = np.minimum(far, np.partition(d, k - 1, axis=1)[:, k - 1])
        at_q, at_n = rows, np.zeros(len(mine), int)
        for level, (low, high) in enumerate(levels):
            if level:
                at_q, at_n = np.repeat(at_q, 2), np.stack([2 * at_n, 2 * at_n + 1], 1).ravel()
            keep = _near2(mine[at_q], low[at_n], high[at_n]) <= far[at_q]
            at_q, at_n = at_q[keep], at_n[keep]
        hits = []
        step = max(1, 1_000_000 // len(wide))
        for b in range(0, len(at_q), step):
            who, leaf = at_q[b : b + step], at_n[b : b + step]
            at = np.minimum(start[leaf][:, None] + wide, n - 1)
            d = _d2(sorted_[at], mine[who][:, None])
            ok = (wide < size[leaf][:, None]) & (d <= far[who][:, None])
            if me is not None:
                ok &= order[at] != me[who][:, None]
            i, j = np.nonzero(ok)
            hits.append((who[i], order[at[i, j]], d[i, j]))
        if hits:
            who, p, d = (np.concatenate(v) for v in zip(*hits))
            o = np.lexsort((rank[p], d, who))
            who, p, d = who[o], p[o], d[o]
            begins = np.searchsorted(who, rows)
            top = np.arange(len(who)) - begins[who] < k
            out.append((who[top] + a, perm[p[top]], d[top]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else none
