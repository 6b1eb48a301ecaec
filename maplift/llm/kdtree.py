"""A KD-tree over integer vectors for exact largest inner products of many queries at once."""
from __future__ import annotations

import numpy as np

#: Vectors of a leaf: compared in one product, which costs about as much as opening a node.
LEAF = 512
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q x' of whole numbers held in doubles, exact, as longs (held within a long)."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if top < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = [[int(v) for v in r] for r in q], [[int(v) for v in r] for r in x]
    return np.array([[min(max(sum(a * b for a, b in zip(u, v)), LOWEST + 1), HIGHEST) for v in exact[1]] for u in exact[0]],
                    np.int64).reshape(len(q), len(x))


class KdTree:
    """Median splits on the widest side of each node's box; boxes are tight; a node knows its smallest id.

    Equal vectors are split by id, so any number of copies makes a balanced tree."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        low, high, first, kids, spans = [], [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            at = order[lo: hi]
            part = vectors[at]
            node = len(spans)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            first.append(ids[at].min())
            kids.append([])
            spans.append((lo, hi))
            if parent >= 0:
                kids[parent].append(node)
            if hi - lo > leaf:
                side = int(np.argmax(high[-1] - low[-1])) if part.shape[1] else None
                order[lo: hi] = at[np.lexsort((ids[at], part[:, side])) if side is not None else np.argsort(ids[at], kind="stable")]
                mid = (lo + hi) // 2
                todo += [(mid, hi, node), (lo, mid, node)]
        self.low, self.high, self.first = np.array(low), np.array(high), np.array(first)
        self.kids, self.spans = kids, spans
        self.vectors, self.ids, self.rows = vectors[order], ids[order], rows[order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product each query can have with a vector of each node's box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return products(np.hstack([up, down]), np.hstack([self.high, self.low]))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, score: np.ndarray, rival: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each queries x k, best first: greater score, then smaller id; LOWEST where there are fewer.

        ``own``: row of each query, which is no candidate.  ``score``, ``rival``: the kth score and id found so far
        elsewhere; what does not beat them may be left out.  Best first: each query opens its most promising
        node, all queries at once; it ends when the best bound is below its kth score."""
        n = len(q)
        best, who = np.full((n, k), LOWEST), np.full((n, k), HIGHEST)
        kth, kth_id = score.copy(), rival.copy()
        reach = self.bounds(q)
        front = np.full_like(reach, LOWEST)
        front[:, 0] = reach[:, 0]
        live = np.arange(n)
        while len(live):
            node = front[live].argmax(axis=1)
            bound = front[live, node]
            front[live, node] = LOWEST
            go = (bound > LOWEST) & (bound >= kth[live])
            live, node, bound = live[go], node[go], bound[go]
            # at a bound equal to the kth score only a smaller id counts
            opened = (bound > kth[live]) | (self.first[node] < kth_id[live])
            for v in np.unique(node[opened]).tolist():
                who_opens = live[opened & (node == v)]
                if self.kids[v]:
                    for child in self.kids[v]:
                        front[who_opens, child] = reach[who_opens, child]
                    continue
                lo, hi = self.spans[v]
                got = products(q[who_opens], self.vectors[lo: hi])
                got[own[who_opens][:, None] == self.rows[lo: hi][None, :]] = LOWEST
                gains = got.max(axis=1) >= kth[who_opens]
                who_opens, got = who_opens[gains], got[gains]
                if not len(who_opens):
                    continue
                got = np.hstack([best[who_opens], got])
                name = np.hstack([who[who_opens], np.broadcast_to(self.ids[lo: hi], (len(who_opens), hi - lo))])
                name = np.where(got == LOWEST, HIGHEST, name)
                order = np.lexsort((name, -1 - got), axis=-1)[:, :k]  # -1 - x: no overflow
                best[who_opens], who[who_opens] = (np.take_along_axis(x, order, axis=1) for x in (got, name))
                s, i = best[who_opens, k - 1], who[who_opens, k - 1]
                better = (s > kth[who_opens]) | ((s == kth[who_opens]) & (i < kth_id[who_opens]))
                kth[who_opens[better]], kth_id[who_opens[better]] = s[better], i[better]
        return best, who
