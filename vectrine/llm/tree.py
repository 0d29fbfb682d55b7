"""Hierarchical k-means tree over unit vectors, with best-bin-first traversal."""

from __future__ import annotations

import heapq

import numpy as np

#: Children of a node, rounds of k-means, and leaves of a tree at most (it is sent to all executors).
BRANCH, ROUNDS, MOST_LEAVES = 16, 8, 8192
#: Numbers of a matrix of products that are held at once.
PIECE = 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 as float32; norms are taken in double precision."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def unit64(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the centroid of each row; an empty centroid keeps its place."""
    first = [int(rng.integers(len(x)))]
    near = ((x - x[first[0]]) ** 2).sum(1)
    for _ in range(k - 1):  # spread the starting points
        total = near.sum()
        if total <= 1e-12:
            break
        first.append(int(np.searchsorted(np.cumsum(near), rng.random() * total, side="right").clip(0, len(x) - 1)))
        near = np.minimum(near, ((x - x[first[-1]]) ** 2).sum(1))
    c = x[first].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c, ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


class Tree:
    """Tree fitted on a bounded sample. Leaves are numbered so that near ones have near numbers."""

    def __init__(self, sample: np.ndarray, leaf_rows: int = 48, branch: int = BRANCH, seed: int = 7, alike: float = 2.0):
        """``leaf_rows``: sample rows of a leaf; ``alike``: mean cosine to their centroid from which rows stay together."""
        self.centroids: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        leaf_rows = max(leaf_rows, -(-2 * len(sample) // MOST_LEAVES), 1)
        self.alike = alike
        width = sample.shape[1]
        self._add(np.zeros(width, np.float32))
        self._split(0, sample, leaf_rows, branch, np.random.default_rng(seed))
        self.c = np.stack(self.centroids)
        self.cc = (self.c * self.c).sum(1)
        self.centroids = []
        self.nodes_of = [np.array(k, np.int64) for k in self.children]

    def _add(self, centroid: np.ndarray) -> int:
        self.centroids.append(centroid)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def _split(self, node: int, x: np.ndarray, leaf_rows: int, branch: int, rng: np.random.Generator) -> None:
        k = min(branch, -(-len(x) // leaf_rows))
        if k > 1 and self.alike < 1:
            mean = x.mean(0)
            if float((x @ (mean / max(float(np.sqrt(mean @ mean)), 1e-12))).mean()) >= self.alike:
                k = 1
        if k > 1:
            c, own = k_means(x, k, rng)
            used = np.unique(own)
            if len(used) > 1:
                # neighbours side by side: order by a chain of nearest centroids
                left, chain = set(used.tolist()), [int(used[0])]
                left.discard(chain[0])
                while left:
                    rest = np.array(sorted(left))
                    chain.append(int(rest[((c[rest] - c[chain[-1]]) ** 2).sum(1).argmin()]))
                    left.discard(chain[-1])
                for j in chain:
                    child = self._add(c[j])
                    self.children[node].append(child)
                    self._split(child, x[own == j], leaf_rows, branch, rng)
                return
        self.leaf[node] = self.leaves
        self.leaves += 1

    def directions(self) -> np.ndarray:
        """Centroid of each leaf at length 1."""
        node = np.argsort(np.where(np.array(self.leaf) >= 0, self.leaf, len(self.leaf)), kind="stable")[: self.leaves]
        c = self.c[node]
        return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down to the nearest child at each node."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            kids = self.nodes_of[node]
            if not len(kids):
                out[rows] = self.leaf[node]
                continue
            own = (self.cc[kids] - 2 * (x[rows] @ self.c[kids].T)).argmin(1)
            todo += [(int(k), rows[own == j]) for j, k in enumerate(kids)]
        return out

    def best_bins(self, x: np.ndarray, visits: int) -> list[list[int]]:
        """First ``visits`` leaves of each row in best-bin-first order.

        A priority queue holds the nodes seen so far by the distance of their
        centroids; the nearest is opened next, wherever it is in the tree.
        """
        out, step = [], max(1, PIECE // len(self.c))
        for s in range(0, len(x), step):
            d = self.cc - 2 * (x[s : s + step] @ self.c.T)
            for row in map(np.ndarray.tolist, d):
                heap, found = [(0.0, 0)], []
                while heap and len(found) < visits:
                    _, node = heapq.heappop(heap)
                    kids = self.children[node]
                    if not kids:
                        found.append(self.leaf[node])
                    for k in kids:
                        heapq.heappush(heap, (row[k], k))
                out.append(found)
        return out
