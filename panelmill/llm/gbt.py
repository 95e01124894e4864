"""Gradient-boosted trees for a yes or no question, in numpy: binned features, log loss."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Trees of fixed depth, kept as arrays: feature, cut and value of node i; its sons are 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, least: int = 10) -> None:
        self.depth, self.trees = depth, []
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self.bins(x)
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(binned, y - p, p * (1 - p), rate, least)
            self.trees.append(tree)
            z += self._value(tree, binned)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, dtype=np.uint8), np.zeros(nodes)
        rows = {0: np.arange(len(g))}
        for node in range(nodes):
            at = rows.pop(node, None)
            if at is None or not len(at):
                continue
            value[node] = rate * g[at].sum() / (h[at].sum() + 1.0)
            if node >= 2**self.depth - 1 or len(at) < 2 * least:
                continue
            # All features' histograms in one count.
            key = (x[at].astype(np.int64) + BINS * np.arange(x.shape[1])[None, :]).ravel()
            size = BINS * x.shape[1]
            wide = x.shape[1]
            gs = np.bincount(key, np.repeat(g[at], wide), size).reshape(-1, BINS).cumsum(axis=1)
            hs = np.bincount(key, np.repeat(h[at], wide), size).reshape(-1, BINS).cumsum(axis=1)
            ns = np.bincount(key, minlength=size).reshape(-1, BINS).cumsum(axis=1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(ns < least) | (len(at) - ns < least)] = 0
            best = int(gain.argmax())
            if gain.flat[best] <= 1e-6:
                continue
            feature[node], cut[node] = best // BINS, best % BINS
            left = x[at, feature[node]] <= cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, cut, value

    def _value(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            down = 2 * node + 1 + (x[np.arange(len(x)), f] > cut[node])
            node = np.where(f >= 0, down, node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes."""
        if not len(x):
            return np.zeros(0)
        binned = self.bins(x)
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += self._value(tree, binned)
        return 1 / (1 + np.exp(-z))
