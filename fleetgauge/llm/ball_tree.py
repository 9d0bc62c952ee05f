"""Exact inner-product search over sparse integer vectors by a ball tree.

Each node of the tree holds the centroid c of its points, the radius r of the ball around it that holds
them all, and that ball's reach r_t along each term: how far above the centroid any of its points gets. For a query
q without negative weights the inner product of any point of the node is at most q.c + |q| r (Cauchy-Schwarz,
over the terms that the node has) and at most q.c + sum of q_t r_t. Vectors of texts have hundreds of terms
and a query has a few of them, so the ball as a whole is wide and it is mostly its reach along the query's terms
that decides. A search goes down the tree best bound first and leaves out a node only if the lesser bound,
rounded up, is below the score that is already needed; points of the leaves are scored in integers.

Points and queries are compared in coordinates multiplied and divided by the square roots of the term
weights. That changes no inner product, and keeps terms that nearly every document has from filling the balls.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Relative room for the rounding of double sums; they err by less than 1e-12 for vectors of thousands of terms.
ROOM = 1e-9


class Best:
    """The ``top`` highest scores of one query; equal scores by ascending id, a null id last."""

    def __init__(self, top: int, floor: int = 1):
        self.top, self.floor, self.heap = top, floor, []

    @property
    def needed(self) -> int:
        """The lowest score that can still enter."""
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.top else self.floor

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int | None, int]]:
        return [(-minus if known else None, score) for score, known, minus in self.heap]


class BallTree:
    """Points as rows of (terms, values), each with at least one term; ``values`` are 64-bit integers.

    ``scale`` gives every term its coordinate factor. A node of at most ``leaf`` points, or of equal
    points only, is a leaf; other nodes are halved along the line between two far points, so the depth is
    logarithmic whatever the points look like. Only one centroid is spread out at a time.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray, leaf: int = 8):
        self.order = np.arange(len(starts) - 1)
        self.starts, self.terms, self.values = starts.astype(np.int64), terms, values
        self._coords = values * scale[terms]
        self._spread = np.zeros(len(scale))
        self._squares = np.add.reduceat(self._coords * self._coords, self.starts[:-1]) if len(self.order) else np.empty(0)
        self.nodes: list[tuple[int, int, int, int]] = []            # first point, end, children (-1: leaf)
        self._balls: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []   # terms, centroid, reach
        self.radii: list[float] = []
        if len(self.order):
            self._grow(leaf)
            self._by_term()

    def _dots(self, lo: int, hi: int, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        a, b = self.starts[lo], self.starts[hi]
        self._spread[cols] = vals
        dots = np.add.reduceat(self._coords[a:b] * self._spread[self.terms[a:b]], self.starts[lo:hi] - a)
        self._spread[cols] = 0
        return dots

    def _row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.terms[a:b], self._coords[a:b]

    def _sort(self, lo: int, hi: int, by: np.ndarray) -> None:
        """Put points ``lo`` to ``hi`` into the order ``by``."""
        a, b = self.starts[lo], self.starts[hi]
        first, n = self.starts[lo:hi][by], np.diff(self.starts[lo:hi + 1])[by]
        begins = a + np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first - begins[:-1], n) + np.arange(a, b)
        for name in ("terms", "values", "_coords"):
            getattr(self, name)[a:b] = getattr(self, name)[take]
        self.starts[lo:hi + 1] = begins
        self.order[lo:hi], self._squares[lo:hi] = self.order[lo:hi][by], self._squares[lo:hi][by]

    def _grow(self, leaf: int) -> None:
        open_nodes = [self._add(0, len(self.order))]
        while open_nodes:
            node, far = open_nodes.pop()
            lo, hi, _, _ = self.nodes[node]
            if hi - lo <= leaf or far < 0:
                continue
            one = self._row(far)
            dots = self._dots(lo, hi, *one)
            other = lo + int(np.argmax(self._squares[lo:hi] - 2 * dots))
            along = dots - self._dots(lo, hi, *self._row(other))
            middle = (hi - lo) // 2
            self._sort(lo, hi, np.argpartition(along, middle))
            children = [self._add(lo, lo + middle), self._add(lo + middle, hi)]
            self.nodes[node] = lo, hi, children[0][0], children[1][0]
            open_nodes += children

    def _add(self, lo: int, hi: int) -> tuple[int, int]:
        """A node for these points; returned with its point farthest from the centroid (-1: all are equal)."""
        a, b = self.starts[lo], self.starts[hi]
        by_term = np.argsort(self.terms[a:b], kind="stable")
        terms, coords = self.terms[a:b][by_term], self._coords[a:b][by_term]
        begins = np.flatnonzero(np.diff(terms, prepend=-1))
        cols, vals = terms[begins], np.add.reduceat(coords, begins) / (hi - lo)
        reach = np.maximum(np.maximum.reduceat(coords, begins) - vals, 0)
        square = float(vals @ vals)
        dots = self._dots(lo, hi, cols, vals)
        room = 1e-11 * (self._squares[lo:hi] + square)
        away = np.maximum(self._squares[lo:hi] - 2 * dots + square, 0)
        farthest = int(np.argmax(away))
        self.nodes.append((lo, hi, -1, -1))
        self._balls.append((cols, vals, reach))
        self.radii.append(float(np.sqrt((away + room).max())) * (1 + ROOM))
        return len(self.nodes) - 1, lo + farthest if away[farthest] > room[farthest] else -1

    def _by_term(self) -> None:
        """Centroids and reaches laid out by term, so that a query reads those of its own terms only."""
        cols, centroid, reach = (np.concatenate(parts) for parts in zip(*self._balls))
        node = np.repeat(np.arange(len(self._balls), dtype=np.int32), [len(ball[0]) for ball in self._balls])
        order = np.argsort(cols, kind="stable")
        self._node, self._centroid, self._reach = node[order], centroid[order], reach[order]
        self._first = np.searchsorted(cols[order], np.arange(len(self._spread) + 1))
        self._radius, self._balls = np.array(self.radii), []

    def bounds(self, terms: np.ndarray, query: np.ndarray) -> np.ndarray:
        """For every node, no less than the inner product of ``query`` (coordinates of ``terms``) with any of its points."""
        spans = [slice(self._first[t], self._first[t + 1]) for t in terms.tolist()]
        node = np.concatenate([self._node[s] for s in spans])
        q = np.repeat(query, [s.stop - s.start for s in spans])
        total = lambda x: np.bincount(node, x, len(self.nodes))
        inner = total(q * np.concatenate([self._centroid[s] for s in spans]))
        away = np.minimum(np.sqrt(total(q * q)) * self._radius, total(q * np.concatenate([self._reach[s] for s in spans])))
        return (inner + away) * (1 + ROOM) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, scale: np.ndarray, ids: list, best: Best) -> int:
        """Offer ``best`` every point that can be among its highest scores; ``ids`` by point as given. Returns the points scored."""
        if not self.nodes or not len(terms):
            return 0
        bound = self.bounds(terms, weights / scale[terms])
        whole = np.zeros(len(self._spread), np.int64)
        whole[terms] = weights
        scored, waiting = 0, [(-float(bound[0]), 0)]
        while waiting and -waiting[0][0] >= best.needed:             # else no other node can help either
            _, node = heapq.heappop(waiting)
            lo, hi, left, right = self.nodes[node]
            if left < 0:
                a, b = self.starts[lo], self.starts[hi]
                scores = np.add.reduceat(whole[self.terms[a:b]] * self.values[a:b], self.starts[lo:hi] - a)
                scored += hi - lo
                for i in np.flatnonzero(scores >= best.needed).tolist():
                    best.offer(int(scores[i]), ids[self.order[lo + i]])
                continue
            for child in (left, right):
                if bound[child] >= best.needed:
                    heapq.heappush(waiting, (-float(bound[child]), child))
        return scored
