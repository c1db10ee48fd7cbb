"""Gradient-boosted trees for two classes over dense features (histograms, Newton leaves)."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.base, self.cuts, self.trees = 0.0, [], []

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        if not len(y):
            return self
        self.cuts = []
        for j in range(x.shape[1]):
            # quantiles of the values other than the commonest one, so that rare positive values get bins
            v, n = np.unique(x[:, j], return_counts=True)
            rest = x[x[:, j] != v[n.argmax()], j]
            at = np.unique(np.quantile(rest, np.linspace(0, 1, self.bins))) if len(rest) else np.zeros(0)
            self.cuts.append(np.unique(np.append((at[1:] + at[:-1]) / 2, [(v[i] + v[i + 1]) / 2 for i in (n.argmax() - 1, n.argmax()) if 0 <= i < len(v) - 1])))
        codes, f = self._codes(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree: dict[int, tuple] = {}
            node = np.zeros(len(y), np.int64)
            self._grow(tree, 0, 0, np.arange(len(y)), codes, p - y, p * (1 - p), node)
            self.trees.append(tree)
            f += np.array([tree[i][3] if i in tree else 0.0 for i in range(1 << (self.depth + 1))])[node]
        return self

    def _grow(self, tree, at, level, rows, codes, g, h, node) -> None:
        G, H = g[rows].sum(), h[rows].sum()
        node[rows] = at
        tree[at] = (-1, 0, 0, -self.rate * G / (H + self.l2))
        if level == self.depth or len(rows) < 2 * self.least:
            return
        best = (1e-6, -1, 0)
        for j in range(codes.shape[1]):
            c, size = codes[rows, j], len(self.cuts[j]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (g[rows], h[rows], None))
            gain = gs**2 / (hs + self.l2) + (G - gs) ** 2 / (H - hs + self.l2) - G * G / (H + self.l2)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] < 0:
            return
        left = codes[rows, best[1]] <= best[2]
        tree[at] = (best[1], best[2], 1, 0.0)
        self._grow(tree, 2 * at + 1, level + 1, rows[left], codes, g, h, node)
        self._grow(tree, 2 * at + 2, level + 1, rows[~left], codes, g, h, node)

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes, f = self._codes(x), np.full(len(x), self.base)
        size = 1 << (self.depth + 1)
        for tree in self.trees:
            feature, cut, inner, leaf = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)
            for k, v in tree.items():
                feature[k], cut[k], inner[k], leaf[k] = max(v[0], 0), v[1], v[2], v[3]
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                down = 2 * at + 1 + (codes[np.arange(len(x)), feature[at]] > cut[at])
                at = np.where(inner[at], down, at)
            f += leaf[at]
        return f
