"""Gradient-boosted trees and isotonic calibration over small dense matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: features and thresholds level by level, then leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (leaf.size - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Logistic boosting with quantile histograms. Of equal gains the first feature and the lowest threshold are taken."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, k), np.int64)
    rate_of = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    f = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            gain, at, cut = np.full(count, 1e-9), np.zeros(count, np.int64), np.full(count, -1)
            sum_g, sum_h = np.bincount(local, g, count), np.bincount(local, h, count)
            whole = sum_g**2 / (sum_h + l2)
            for j in range(k):
                m = len(edges[j]) + 1
                if m < 2:
                    continue
                cell = local * m + code[:, j]
                left_g = np.bincount(cell, g, count * m).reshape(count, m).cumsum(1)[:, :-1]
                left_h = np.bincount(cell, h, count * m).reshape(count, m).cumsum(1)[:, :-1]
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                won = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - whole[:, None]
                won[(left_h < least / 4) | (right_h < least / 4)] = -1
                best = won.argmax(1)
                top = won[np.arange(count), best]
                better = top > gain
                gain[better], at[better], cut[better] = top[better], j, best[better]
            for c in range(count):
                if cut[c] >= 0:
                    feature[first + c], threshold[first + c] = at[c], edges[at[c]][cut[c]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf_of = node - inner
        value = rate * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + l2)
        f += value[leaf_of]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


@dataclass
class Isotonic:
    """A non-decreasing map from margins to probabilities, linear between its knots."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; a pool's probability is smoothed by half a row of either kind. Equal margins form one pool."""
    if not len(margin):
        return Isotonic(np.array([-8.0, 8.0]), 1 / (1 + np.exp([8.0, -8.0])))
    at, of = np.unique(margin, return_inverse=True)
    pools: list[list[float]] = []  # sum, size, first, last
    for first, s, n in zip(at, np.bincount(of, y), np.bincount(of)):
        pools.append([s, n, first, first])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    knots, values = [], []
    for s, n, first, last in pools:
        p = (s + 0.5) / (n + 1)
        knots += [first, last] if last > first else [first]
        values += [p, p] if last > first else [p]
    return Isotonic(np.array(knots), np.maximum.accumulate(values))
