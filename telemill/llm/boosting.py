"""A small gradient-boosted classifier: binned features, trees of fixed depth, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Trees as flat arrays; node i has the children 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray  # tree, inner node
    limit: np.ndarray  # right if the value is above it
    value: np.ndarray  # tree, leaf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(rows), np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (rows[every, feature[at]] > limit[at])
            out += value[at - inner]
        return out


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Fit on a bounded training set; splits are searched on quantile bins by gradient and curvature sums."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features = np.zeros((trees, inner), np.int64)
    limits = np.full((trees, inner), np.inf)
    values = np.zeros((trees, leaves))
    for t in range(trees):
        guess = 1 / (1 + np.exp(-score))
        slope, bend = labels - guess, guess * (1 - guess)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = (at - first) * BINS
            total = [np.bincount(at - first, w, count) for w in (slope, bend)]
            best = total[0] ** 2 / (total[1] + penalty) + 1e-6
            for f in range(width):
                if not len(edges[f]):
                    continue
                sums = [np.cumsum(np.bincount(cell + binned[:, f], w, count * BINS).reshape(count, BINS), axis=1) for w in (slope, bend)]
                right = [total[k][:, None] - sums[k] for k in (0, 1)]
                gain = sums[0] ** 2 / (sums[1] + penalty) + right[0] ** 2 / (right[1] + penalty)
                gain = gain[:, : len(edges[f])]
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best = np.where(better, gain[np.arange(count), top], best)
                nodes = first + np.flatnonzero(better)
                features[t, nodes], limits[t, nodes] = f, edges[f][top[better]]
            at = 2 * at + 1 + (rows[np.arange(n), features[t, at]] > limits[t, at])
        leaf = at - inner
        sums = [np.bincount(leaf, w, leaves) for w in (slope, bend)]
        values[t] = rate * sums[0] / (sums[1] + penalty)
        score += values[t, leaf]
    return Trees(start, features, limits, values)
