"""Gradient-boosted regression trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class BoostedTrees:
    """Complete binary trees as arrays: inner nodes' features and limits, leaves' values."""

    features: np.ndarray  # trees x inner nodes
    limits: np.ndarray
    leaves: np.ndarray  # trees x leaves
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for features, limits, leaves in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, features[node]] > limits[node])
            total += leaves[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, min_hessian: float = 1.0) -> BoostedTrees:
    """Newton boosting of the logistic loss; every level of a tree is split at once by histograms."""
    limits = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(cut, column, "left") for cut, column in zip(limits, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(y), bias)
    inner = (1 << depth) - 1
    all_features = np.zeros((trees, inner), np.int64)
    all_limits = np.full((trees, inner), np.inf)
    all_leaves = np.zeros((trees, 1 << depth))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            split_bin = np.full(width, BINS)
            split_feature = np.zeros(width, np.int64)
            for feature in range(x.shape[1]):
                if not len(limits[feature]):
                    continue
                slot = (node - first) * BINS + binned[:, feature]
                g = np.bincount(slot, gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(slot, hessian, width * BINS).reshape(width, BINS).cumsum(axis=1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (whole_g - g) ** 2 / (whole_h - h + l2) - whole_g**2 / (whole_h + l2)
                gain[(h < min_hessian) | (whole_h - h < min_hessian)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                split_bin[better], split_feature[better] = at[better], feature
            cuts = [limits[f][b] if b < len(limits[f]) else np.inf for f, b in zip(split_feature, split_bin)]
            all_features[tree, first : first + width] = split_feature
            all_limits[tree, first : first + width] = cuts
            here = node - first
            node = 2 * node + 1 + (x[np.arange(len(x)), split_feature[here]] > np.array(cuts)[here])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, 1 << depth), np.bincount(leaf, hessian, 1 << depth)
        all_leaves[tree] = rate * g / (h + l2)
        score += all_leaves[tree][leaf]
    return BoostedTrees(all_features, all_limits, all_leaves, bias)
