"""Gradient-boosted trees for two classes: logistic loss, complete trees of fixed depth over quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes), nodes in breadth-first order
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    inner, width = 2**depth - 1, bins + 1
    made = Trees(base, np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                place = (node - first) * width + binned[:, f]
                g = np.bincount(place, gradient, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(place, curve, count * width).reshape(count, width).cumsum(axis=1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
                gain = gain[:, : len(c)]
                at = gain.argmax(axis=1)
                better = gain[np.arange(count), at] > best
                best = np.where(better, gain[np.arange(count), at], best)
                made.feature[t, first : first + count][better] = f
                made.threshold[t, first : first + count][better] = c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), made.feature[t, node]] > made.threshold[t, node])
        place = node - inner
        made.leaf[t] = rate * np.bincount(place, gradient, inner + 1) / (np.bincount(place, curve, inner + 1) + ridge)
        score += made.leaf[t][place]
    return made
