"""Gradient-boosted trees for two classes, in numpy, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of equal depth; a node's split is kept in an array, level by level."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 8.0):
        self.trees, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least
        self.base = 0.0
        self.feature: list[np.ndarray] = []
        self.bound: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        rows, columns = x.shape
        edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS)[1:-1])) for c in range(columns)]
        binned = np.stack([np.searchsorted(e, x[:, c], "left") for c, e in enumerate(edges)], axis=1)
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(rows, self.base)
        cells = binned + np.arange(columns) * BINS
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            slope, bend = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(rows, int)  # place in the level
            features, bounds = [], []
            for level in range(self.depth):
                width = 1 << level
                keys = (at[:, None] * columns * BINS + cells).ravel()
                g = np.bincount(keys, np.repeat(slope, columns), width * columns * BINS).reshape(width, columns, BINS).cumsum(axis=2)
                h = np.bincount(keys, np.repeat(bend, columns), width * columns * BINS).reshape(width, columns, BINS).cumsum(axis=2)
                n = np.bincount(keys, np.repeat(weight, columns), width * columns * BINS).reshape(width, columns, BINS).cumsum(axis=2)
                all_g, all_h, all_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(n < self.least) | (all_n - n < self.least)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                feature, cut = best // BINS, best % BINS
                # Without a gain all rows go left.
                none = gain.reshape(width, -1).max(axis=1) <= 1e-9
                cut = np.where(none, BINS, cut)
                limit = np.array([np.inf if c >= len(edges[f]) else edges[f][c] for f, c in zip(feature, cut)])
                features.append(feature)
                bounds.append(limit)
                at = 2 * at + (binned[np.arange(rows), feature[at]] > cut[at])
            leaves = 1 << self.depth
            leaf = -self.rate * np.bincount(at, slope, leaves) / (np.bincount(at, bend, leaves) + self.ridge)
            z += leaf[at]
            self.feature.append(np.concatenate(features))
            self.bound.append(np.concatenate(bounds).astype(np.float32))
            self.leaf.append(leaf)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[rows, feature[node]] > bound[node])
            z += leaf[at]
        return z
