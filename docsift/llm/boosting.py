"""A small gradient boosting of regression trees on logistic loss, whose model is written out as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Boosted:
    """Trees as nested tuples ``(feature, threshold, below, above)`` with leaf values, a start value and a calibration."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 10):
        self.n_trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.trees: list = []
        self.start, self.slope, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(col, np.linspace(0.05, 0.95, 19))) for col in x.T]
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            raw += _apply(tree, x)
        return self

    def _grow(self, x, grad, hess, at, cuts, depth):
        def gain(rows) -> float:
            return grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)

        best = (1e-6, None)
        if depth and len(at) >= 2 * self.least:
            whole = gain(at)
            for f, options in enumerate(cuts):
                for t in options:
                    low = x[at, f] <= t
                    if self.least <= low.sum() <= len(at) - self.least:
                        best = max(best, (gain(at[low]) + gain(at[~low]) - whole, (f, float(t))), key=lambda b: b[0])
        if best[1] is None:
            return self.rate * float(grad[at].sum() / (hess[at].sum() + 1.0))
        f, t = best[1]
        low = x[at, f] <= t
        return f, t, self._grow(x, grad, hess, at[low], cuts, depth - 1), self._grow(x, grad, hess, at[~low], cuts, depth - 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        """Logistic calibration on rows that were not trained on; the threshold is the least that keeps ``precision`` there."""
        raw = self.raw(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.slope * raw + self.shift)))
            w = p * (1 - p) + 1e-6
            design = np.stack([raw, np.ones_like(raw)])
            step = np.linalg.solve((design * w) @ design.T + 1e-3 * np.eye(2), design @ (y - p))
            self.slope, self.shift = self.slope + step[0], self.shift + step[1]
            if abs(step).max() < 1e-9:
                break
        p = self.probability(x)
        good = [t for t in np.unique(np.round(p, 6)) if t >= 0.5 and y[p >= t].mean() >= precision]
        self.threshold = float(min(good, default=0.99))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def expression(self, features: list[Column]) -> Column:
        """The calibrated probability as a column of the given features."""

        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, t, low, high = tree
            return F.when(features[f] <= t, of(low)).otherwise(of(high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-(total * self.slope + self.shift)))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _apply(low, x), _apply(high, x))
