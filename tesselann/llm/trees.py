"""Gradient-boosted trees for two classes, in numpy: logistic loss, Newton steps, histogram splits."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete trees of ``depth`` levels: at level d, row k of a tree's arrays has the split of the node with path k."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, decay: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.decay, self.least = rounds, depth, rate, bins, decay, least
        self.trees: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]] = []
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        mean = np.average(y, weights=weight)
        self.prior = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        z = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = (y - p) * weight, p * (1 - p) * weight + 1e-9
            path = np.zeros(len(y), np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                many = 1 << level
                best = np.full(many, 1e-9)
                feature, code = np.zeros(many, np.int64), np.full(many, self.bins)
                total = [np.bincount(path, v, many) for v in (g, h)]
                for f in range(x.shape[1]):
                    at = path * self.bins + codes[:, f]
                    gl, hl = (np.bincount(at, v, many * self.bins).reshape(many, -1).cumsum(1) for v in (g, h))
                    gr, hr = total[0][:, None] - gl, total[1][:, None] - hl
                    gain = gl**2 / (hl + self.decay) + gr**2 / (hr + self.decay) - (total[0] ** 2 / (total[1] + self.decay))[:, None]
                    gain[(hl < self.least * 0.25) | (hr < self.least * 0.25)] = 0
                    k = gain.argmax(1)
                    won = gain[np.arange(many), k] > best
                    best[won], feature[won], code[won] = gain[np.arange(many), k][won], f, k[won]
                value = np.array([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature, code, strict=True)])
                features.append(feature)
                cuts.append(value)
                path = path * 2 + (x[np.arange(len(x)), feature[path]] > value[path])
            leaf = np.bincount(path, g, 1 << self.depth) / (np.bincount(path, h, 1 << self.depth) + self.decay) * self.rate
            z += leaf[path]
            self.trees.append((features, cuts, leaf))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.prior), np.arange(len(x))
        for features, cuts, leaf in self.trees:
            path = np.zeros(len(x), np.int64)
            for f, c in zip(features, cuts, strict=True):
                path = path * 2 + (x[rows, f[path]] > c[path])
            z += leaf[path]
        return z
