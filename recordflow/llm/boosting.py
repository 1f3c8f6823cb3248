"""Gradient-boosted trees on binned features, kept as flat arrays.

A tree of depth ``d`` is an implicit binary heap: node ``i`` has children ``2i + 1`` and ``2i + 2``,
so all rows walk all levels of a tree with array look-ups alone. A node that is not split
sends every row to its left child.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # rows with a value above it go right
    leaf: np.ndarray  # trees x leaves
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows, n_inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < n_inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - n_inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        l2: float = 1.0, min_weight: float = 1.0) -> Forest:
    """Logistic boosting; splits are searched in histograms of gradients over quantile bins.

    Without rows of both classes the forest is empty and its score the smoothed share of class 1.
    """
    y = np.asarray(y, dtype=float)
    share = (y.sum() + 1) / (len(y) + 2)
    n_inner, n_leaves, n_features = 2**depth - 1, 2**depth, x.shape[1]
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, n_inner), int), np.zeros((0, n_inner)), np.zeros((0, n_leaves)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(n_features)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(n_features)], axis=1)
    cell = binned + np.arange(n_features) * bins
    forest = ([], [], [])
    total = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(n_inner, int), np.full(n_inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (n_features * bins) + cell).ravel()
            size = width * n_features * bins
            shape = (width, n_features, bins)
            g = np.bincount(key, np.repeat(grad, n_features), size).reshape(shape)
            h = np.bincount(key, np.repeat(hess, n_features), size).reshape(shape)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
            gain[(hl < min_weight) | (hr < min_weight)] = -1
            best = gain.reshape(width, -1).argmax(1)
            split_bin = np.full(width, bins)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k], split_bin[k] = j, cuts[j][b], b
            at = node - first
            right = binned[np.arange(len(y)), feature[node]] > split_bin[at]
            node = 2 * node + 1 + right
        at = node - n_inner
        leaf = -rate * np.bincount(at, grad, n_leaves) / (np.bincount(at, hess, n_leaves) + l2)
        total += leaf[at]
        for part, value in zip(forest, (feature, threshold, leaf), strict=True):
            part.append(value)
    return Forest(*map(np.array, forest), base)
