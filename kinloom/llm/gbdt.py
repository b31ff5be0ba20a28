"""Histogram gradient-boosted trees in numpy, flattened into arrays for vectorised traversal."""

from __future__ import annotations

import numpy as np


class Forest:
    """Complete binary trees of one depth: node k of a tree has the children 2k + 1 and 2k + 2; x > cut goes right."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype="int64")
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


#: Quantile bins of a feature at most; a bin's number is a byte.
BINS = 64


def quantiles(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner edges of the bins of each feature."""
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for f in range(x.shape[1])]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype("uint8")


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, trees: int = 80, depth: int = 4, bins: int = BINS, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic loss, second-order gains; features are cut into at most `bins` quantile bins; w: how often a row counts."""
    cuts = quantiles(x, bins)
    return grow(binned(x, cuts), y, np.ones(len(x)) if w is None else w, cuts, trees, depth, bins, rate, l2, least)


def grow(at_bin: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], trees: int = 80, depth: int = 4, bins: int = BINS, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Forest:
    """fit of rows told by the bins of their features, a byte each; beside them a row takes some numbers, whatever its width."""
    n, width = at_bin.shape
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        p = ((y * w).sum() + 0.5) / (w.sum() + 1.0) if n else 0.5
        return Forest(np.empty((0, inner), dtype="int64"), np.empty((0, inner)), np.empty((0, inner + 1)), float(np.log(p / (1 - p))))
    columns = np.ascontiguousarray(at_bin.T)
    mean = (y * w).sum() / w.sum()
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = w * (p - y), w * p * (1 - p)
        feature, cut = np.zeros(inner, dtype="int64"), np.full(inner, np.inf)
        at = np.zeros(n, dtype="int64")  # node within its level
        for level in range(depth):
            nodes = 2**level
            base_key = at * bins
            sums = [[np.bincount(key, v, nodes * bins).reshape(nodes, bins) for v in (grad, hess)] for key in (base_key + c for c in columns)]
            g, h = (np.stack([s[k] for s in sums], axis=1).cumsum(axis=2) for k in (0, 1))
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < least) | (ht - h < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            split_bin = np.full(nodes, bins)
            chosen = np.zeros(nodes, dtype="int64")
            for k in range(nodes):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    chosen[k], split_bin[k] = f, b
                    feature[nodes - 1 + k], cut[nodes - 1 + k] = f, cuts[f][b]
            at = 2 * at + (columns[chosen[at], np.arange(n)] > split_bin[at])
        total_g, total_h = np.bincount(at, grad, 2**depth), np.bincount(at, hess, 2**depth)
        leaf = -rate * total_g / (total_h + l2)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(cut)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)
