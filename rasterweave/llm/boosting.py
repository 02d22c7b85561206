"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are cut into at most ``BINS`` bins at sample quantiles; every split is found from histograms of gradients.
A model is flat arrays: for all trees one array each of feature, threshold, children and value, so that all rows
go down a tree together.

Defined cases: without rows every score is a half; labels of one kind give their share, kept off 0 and 1, everywhere; a
value equal to a threshold goes left; equal rows have equal scores; features that are all equal are never split.
"""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 2.0, min_rows: int = 10):
        self.rounds, self.depth, self.rate, self.l2, self.min_rows = rounds, depth, rate, l2, min_rows
        self.base = 0.0
        self.feature = np.zeros((0, 0), np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, width = x.shape
        p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        nodes = (2 << self.depth) - 1
        self.feature = np.full((self.rounds, nodes), -1, np.int32)
        self.threshold, self.value = np.zeros((self.rounds, nodes)), np.zeros((self.rounds, nodes))
        if not n or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        slots = (binned + np.arange(width) * BINS).ravel()
        score = np.full(n, self.base)
        for r in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, prob * (1 - prob)
            self._grow(r, binned, slots, cuts, g, h)
            score += self._leaf_values(r, x)
        return self

    def _grow(self, r, binned, slots, cuts, g, h):
        n, width = binned.shape
        node = np.zeros(n, np.int64)
        for level in range(self.depth + 1):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            gs, hs = np.bincount(local[local >= 0], g[local >= 0], count), np.bincount(local[local >= 0], h[local >= 0], count)
            self.value[r, first : first + count] = -self.rate * gs / (hs + self.l2)
            live = np.flatnonzero(local >= 0)
            if level == self.depth or not len(live):
                return
            size = width * BINS
            at = (local[live, None] * size + slots.reshape(n, width)[live]).ravel()
            hist = [np.bincount(at, np.repeat(w[live], width), count * size).reshape(count, width, BINS).cumsum(2) for w in (g, h, np.ones(n))]
            gl, hl, nl = hist
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
            gain[(nl < self.min_rows) | (nt - nl < self.min_rows)] = -1
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            for k in range(count):
                if flat[k, best[k]] <= 1e-9:
                    node[node == first + k] = -1
                    continue
                j, b = divmod(int(best[k]), BINS)
                if b >= len(cuts[j]):
                    node[node == first + k] = -1
                    continue
                self.feature[r, first + k], self.threshold[r, first + k] = j, cuts[j][b]
                own = np.flatnonzero(node == first + k)
                node[own] = 2 * (first + k) + 1 + (binned[own, j] > b)

    def _leaf_values(self, r: int, x: np.ndarray) -> np.ndarray:
        feature, threshold, node = self.feature[r], self.threshold[r], np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[node]
            down = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node])
            node = np.where(f >= 0, down, node)
        return self.value[r][node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for r in range(len(self.feature)):
            score += self._leaf_values(r, x)
        return 1 / (1 + np.exp(-score))
