"""Gradient-boosted decision trees of a fixed depth for two classes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Perfect binary trees: ``feature`` and ``cut`` of the inner nodes by level, ``value`` of the leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of class 1; a value above a cut goes to the right."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return total


def fit_trees(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0
) -> Trees:
    """Trees fitted to the logistic loss, each split by the greatest gain over histograms of gradients."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)])
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(x), base), 2**depth - 1
    out = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p) + 1e-9
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            begin, count = 2**level - 1, 2**level
            place = node - begin
            best = np.zeros(count)
            for f, values in enumerate(cuts):
                width = len(values) + 1
                if width < 2:
                    continue
                cell = place * width + codes[:, f]
                g = np.bincount(cell, gradient, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(cell, weight, count * width).reshape(count, width).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                at = gain[:, :-1].argmax(axis=1)
                gains = gain[np.arange(count), at]
                better = gains > best + 1e-9
                best[better] = gains[better]
                feature[begin + np.flatnonzero(better)] = f
                cut[begin + np.flatnonzero(better)] = values[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - inner
        sums = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        value = rate * sums[0] / (sums[1] + ridge)
        margin += value[leaf]
        out.append((feature, cut, value))
    return Trees(base, *(np.array(part) for part in zip(*out)))
