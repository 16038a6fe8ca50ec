"""Gradient-boosted regression trees for the logistic loss, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: per tree and inner node a feature and a threshold."""

    base: float
    features: np.ndarray  # (trees, 2**depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray  # (trees, 2**depth)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Newton boosting; a node splits at the bin of the largest gain, ties by feature and bin."""
    n, width = x.shape
    rate_of = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    inner = 2**depth - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, width), np.int64)
    score = np.full(n, base)
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    offset = np.arange(width) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(rows) > 1:
                flat = (binned[rows] + offset).ravel()
                g = np.bincount(flat, np.repeat(grad[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(flat, np.repeat(hess[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = 0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > best[0]:
                    best = (gain[j, b], j, edges[j][b])
            features[t, node], thresholds[t, node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        leaves[t] = rate * g / (h + ridge)
        score += leaves[t][leaf]
    return Forest(base, features, thresholds, leaves)
