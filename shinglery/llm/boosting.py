"""Gradient-boosted trees for a binary label, in numpy: logistic loss, quantile cuts, depth-limited trees."""

from __future__ import annotations

import numpy as np


class Boosted:
    """`rounds` trees of `depth` levels; leaves are Newton steps shrunk by `rate`."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, cuts: int = 16):
        self.rounds, self.depth, self.rate, self.ridge, self.cuts = rounds, depth, rate, ridge, cuts
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        marks = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(x.shape[1])]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), marks, self.depth)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, x, g, h, at, marks, depth):
        total_g, total_h = g[at].sum(), h[at].sum()
        leaf = -self.rate * total_g / (total_h + self.ridge)
        best = (1e-6, None)
        if depth:
            for j, cuts in enumerate(marks):
                for c in cuts:
                    left = x[at, j] <= c
                    gl, hl = g[at][left].sum(), h[at][left].sum()
                    gain = gl**2 / (hl + self.ridge) + (total_g - gl) ** 2 / (total_h - hl + self.ridge) - total_g**2 / (total_h + self.ridge)
                    if gain > best[0]:
                        best = (gain, (j, float(c), left))
        if best[1] is None:
            return float(leaf)
        j, c, left = best[1]
        return (j, c, self._grow(x, g, h, at[left], marks, depth - 1), self._grow(x, g, h, at[~left], marks, depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] <= c, self._walk(low, x), self._walk(high, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))
