"""Gradient-boosted regression trees for two classes, and isotonic calibration, for samples that fit the driver."""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    """Logistic loss, Newton leaf values, features cut at quantiles into at most ``BINS`` bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15,
                 ridge: float = 1.0, least: float = 0.5):
        self.depth, self.rate = depth, rate
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(prior / (1 - prior)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(binned, y - p, p * (1 - p), ridge, least)
            self.trees.append(tree)
            total += self._leaf(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, binned, gradient, weight, ridge, least):
        """Feature and bin of each inner node, breadth first, and the value of each leaf."""
        inner = 2 ** self.depth - 1
        feature, upto = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(gradient), np.int64)
        for level in range(self.depth):
            first, width = 2 ** level - 1, 2 ** level
            at = node - first
            best = np.full(width, 1e-9)
            for f in range(binned.shape[1]):
                cell = at * BINS + binned[:, f]
                g = np.bincount(cell, gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(cell, weight, width * BINS).reshape(width, BINS).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = (g * g / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g ** 2 / (all_h + ridge))
                gain[(h < least) | (all_h - h < least)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best = np.where(better, value, best)
                feature[first:first + width] = np.where(better, f, feature[first:first + width])
                upto[first:first + width] = np.where(better, top, upto[first:first + width])
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > upto[node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, weight, inner + 1)
        return feature, upto, self.rate * g / (h + ridge)

    def _leaf(self, tree, binned) -> np.ndarray:
        feature, upto, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > upto[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        binned = self._binned(x)
        return self.start + sum(self._leaf(t, binned) for t in self.trees)


class Isotonic:
    """The non-decreasing function of a score that fits 0/1 outcomes best (pool adjacent violators)."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        level: list[list[float]] = []  # mean, weight, lowest score, highest score
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            level.append([v, 1.0, s, s])
            while len(level) > 1 and level[-2][0] >= level[-1][0]:
                mean, weight, _, high = level.pop()
                low = level[-1]
                low[0] = (low[0] * low[1] + mean * weight) / (low[1] + weight)
                low[1] += weight
                low[3] = high
        self.at = np.array([x for b in level for x in (b[2], b[3])])
        self.value = np.array([b[0] for b in level for _ in range(2)])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
