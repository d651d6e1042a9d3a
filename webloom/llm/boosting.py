"""Gradient-boosted trees on binned features, trained on the driver on a bounded sample, applied in batches.

Small on purpose: logistic loss, histograms, depth-limited trees stored as arrays; numpy only.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier; decision() gives log-odds. The same data and parameters give the same trees."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 8.0, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, m = x.shape
        w = np.ones(n) if weight is None else weight.astype(float)
        self.edges = []
        for f in range(m):
            values = np.unique(x[:, f])
            if len(values) > self.bins:
                values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)))
            self.edges.append((values[1:] + values[:-1]) / 2)
        b = self._bin(x)
        p = float(np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6))
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.n_trees, size), -1, np.int32)
        self.cut = np.zeros((self.n_trees, size), np.int32)
        self.value = np.zeros((self.n_trees, size))
        for t in range(self.n_trees):
            q = 1 / (1 + np.exp(-score))
            g, h = w * (q - y), w * q * (1 - q)
            node = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, count = 2**level - 1, 2**level
                at = node - first
                live = (at >= 0) & (at < count)
                gs = np.bincount(at[live], g[live], count)
                hs = np.bincount(at[live], h[live], count)
                self.value[t, first : first + count] = -self.rate * gs / (hs + self.l2)
                if level == self.depth:
                    break
                best = np.full(count, 1e-6)
                rows, k = np.flatnonzero(live), self.bins + 1
                for f in range(m):
                    if not len(self.edges[f]):
                        continue
                    key = at[rows] * k + b[rows, f]
                    gl = np.bincount(key, g[rows], count * k).reshape(count, k).cumsum(1)
                    hl = np.bincount(key, h[rows], count * k).reshape(count, k).cumsum(1)
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (gs**2 / (hs + self.l2))[:, None]
                    gain[(hl < self.least / 4) | (hr < self.least / 4)] = 0
                    c = gain.argmax(1)
                    v = gain[np.arange(count), c]
                    up = v > best
                    best[up] = v[up]
                    self.feature[t, first : first + count][up] = f
                    self.cut[t, first : first + count][up] = c[up]
                f = self.feature[t, node]
                go = live & (f >= 0)
                right = b[np.flatnonzero(go), f[go]] > self.cut[t, node[go]]
                node[go] = 2 * node[go] + 1 + right
            score += self.value[t, node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def decision(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                go = f >= 0
                node = np.where(go, 2 * node + 1 + (b[rows, np.maximum(f, 0)] > self.cut[t, node]), node)
            score += self.value[t, node]
        return score
