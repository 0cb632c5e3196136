"""Gradient-boosted trees for small feature tables: logistic loss, histogram splits, numpy only."""
from __future__ import annotations

import numpy as np


def _grow(codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, bins: int, least: float):
    total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
    leaf = float(-total_g / (total_h + 1.0))
    if not depth or len(rows) < 8:
        return leaf
    best = (1e-6, None, None)
    for feature in range(codes.shape[1]):
        c = codes[rows, feature]
        g, h = (np.cumsum(np.bincount(c, weights=w[rows], minlength=bins))[:-1] for w in (gradient, hessian))
        gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(h < least) | (total_h - h < least)] = 0
        if gain[k := int(gain.argmax())] > best[0]:
            best = (gain[k], feature, k)
    if best[1] is None:
        return leaf
    left = codes[rows, best[1]] <= best[2]
    return best[1], best[2], *(_grow(codes, gradient, hessian, r, depth - 1, bins, least) for r in (rows[left], rows[~left]))


def _apply(tree, codes: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(codes), tree)
    feature, cut, low, high = tree
    left = codes[:, feature] <= cut
    out = np.empty(len(codes))
    out[left], out[~left] = _apply(low, codes[left]), _apply(high, codes[~left])
    return out


class BoostedTrees:
    """fit(x, y) with y in 0, 1; probability(x)."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1) if x.shape[1] else np.zeros((len(x), 0), dtype=int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins)[1:-1])) for k in range(x.shape[1])]
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        codes, score = self._codes(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(codes, p - y, p * (1 - p), np.arange(len(y)), self.depth, self.bins, self.least)
            score += self.rate * _apply(tree, codes)
            self.trees.append(tree)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        codes, score = self._codes(x), np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * _apply(tree, codes)
        return 1 / (1 + np.exp(-score))
