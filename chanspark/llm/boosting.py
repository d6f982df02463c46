"""Gradient-boosted trees for a few classes, on binned features; training and prediction are whole-array NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Trees of equal depth as arrays (tree, node): split feature and bin; leaves hold what is added to the class's score."""

    edges: list[np.ndarray]
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    classes: int
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for f, e in enumerate(self.edges):
            out[:, f] = np.searchsorted(e, x[:, f], side="left")
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities, a column for each class."""
        bins, rows = self.binned(x), np.arange(len(x))
        out = np.zeros((len(x), self.classes))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (bins[rows, self.feature[t, at]] > self.limit[t, at])
            out[:, t % self.classes] += self.leaf[t, at - (2**self.depth - 1)]
        return _log_softmax(out)


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 20, depth: int = 4, rate: float = 0.4, ridge: float = 1.0, least: int = 8) -> Trees:
    """Fits one tree for each class and round to the gradient of the multinomial log-likelihood."""
    n, n_features = x.shape
    edges = []
    for f in range(n_features):
        values = np.unique(x[:, f])
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) >= BINS:
            middles = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(middles)
    inner, leaves = 2**depth - 1, 2**depth
    trees = Trees(edges, np.zeros((rounds * classes, inner), np.int64), np.full((rounds * classes, inner), 255, np.int64), np.zeros((rounds * classes, leaves)), classes, depth)
    bins = trees.binned(x)
    offsets = bins.astype(np.int64) + np.arange(n_features) * BINS
    truth, score = np.eye(classes)[y], np.zeros((n, classes))
    for r in range(rounds):
        p = np.exp(_log_softmax(score))
        for c in range(classes):
            t = r * classes + c
            gradient, curve = truth[:, c] - p[:, c], p[:, c] * (1 - p[:, c]) + 1e-9
            at = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                cells = ((at - first)[:, None] * (n_features * BINS) + offsets).ravel()
                total = width * n_features * BINS
                shape = (width, n_features, BINS)
                g = np.bincount(cells, np.repeat(gradient, n_features), total).reshape(shape).cumsum(axis=2)
                h = np.bincount(cells, np.repeat(curve, n_features), total).reshape(shape).cumsum(axis=2)
                m = np.bincount(cells, minlength=total).reshape(shape).cumsum(axis=2)
                part = lambda a, b: a**2 / (b + ridge)
                gain = part(g, h) + part(g[:, :, -1:] - g, h[:, :, -1:] - h) - part(g[:, :, -1:], h[:, :, -1:])
                gain[(m < least) | (m[:, :, -1:] - m < least)] = 0
                flat = gain.reshape(width, -1)
                best = flat.argmax(axis=1)
                real = flat[np.arange(width), best] > 1e-6
                trees.feature[t, first : first + width] = np.where(real, best // BINS, 0)
                trees.limit[t, first : first + width] = np.where(real, best % BINS, 255)
                at = 2 * at + 1 + (bins[np.arange(n), trees.feature[t, at]] > trees.limit[t, at])
            at -= inner
            trees.leaf[t] = rate * np.bincount(at, gradient, leaves) / (np.bincount(at, curve, leaves) + ridge)
            score[:, c] += trees.leaf[t, at]
    return trees
