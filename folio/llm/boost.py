"""Gradient-boosted trees for small tables of features, on the logistic loss."""

from __future__ import annotations

import numpy as np


class Boost:
    """Trees of depth `depth` over quantile cuts; predicts probabilities."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 24) -> None:
        self.rounds, self.depth, self.rate, self.cuts = rounds, depth, rate, cuts
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, self.cuts))) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._tree(codes, edges, y - q, q * (1 - q))
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _tree(self, codes, edges, g, h):
        n = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(n, -1), np.zeros(n), np.zeros(n)
        node = np.zeros(len(g), int)
        for k in range(n):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = self.rate * gs / (hs + 1.0)
            if k >= 2**self.depth - 1:
                continue
            best = 1e-6
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, j]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, feature[k], cut[k] = gain[i], j, e[i]
                    split = c <= i
            if feature[k] >= 0:
                node[rows] = np.where(split, 2 * k + 1, 2 * k + 2)
        return feature, cut, value

    def _apply(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            left = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(left, 2 * at + 1, 2 * at + 2), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, np.shape(x)[-1])
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._apply(tree, x)
        return 1 / (1 + np.exp(-score))
