"""Gradient-boosted trees for two classes, on binned features, with numpy. Fits on bounded samples; predicts whole arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth. A row goes right where its feature is above the threshold."""

    start: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray
    value: np.ndarray  # tree, leaf

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < len(feature):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between distinct values, at most ``bins - 1``."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
    return (values[1:] + values[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0,
        ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order splits. Ties go to the first feature and the lowest threshold, so refits agree."""
    n, m = x.shape
    edges = [_edges(x[:, j], bins) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64)
    limits = np.array([len(e) for e in edges])
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score, inner, leaves = np.full(n, start), (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    allowed = np.arange(bins)[None, :] < limits[:, None]
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            base = (at - first) * bins
            gs, hs = (np.stack([np.bincount(base + b, w, width * bins) for b in binned]).reshape(m, width, bins) for w in (g, h))
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain = np.where(allowed[:, None, :] & (hl >= least) & (ht - hl >= least), gain, -1).transpose(1, 0, 2).reshape(width, -1)
            best = gain.argmax(axis=1)
            for k in range(width):
                j, cut = divmod(int(best[k]), bins)
                if gain[k, best[k]] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        score += value[t, leaf]
    return Trees(start, feature, threshold, value)
