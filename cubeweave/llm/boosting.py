"""Gradient-boosted trees for a yes-or-no label, on histograms of feature values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, LEAST_LEAF, RIDGE, BINS = 80, 5, 0.2, 8, 1.0, 32


@dataclass
class Trees:
    """Complete trees of one depth: at each inner place a feature and a limit (go right above it), and a value for each leaf."""

    start: float
    features: np.ndarray
    limits: np.ndarray
    values: np.ndarray

    def gain(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, limit, value in zip(self.features, self.limits, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > limit[at])
            out += value[at - inner] if len(at) else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Second-order boosting of the log loss; splits at up to BINS limits of each feature's values."""
    limits = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(limits, x.T, strict=True)], 1)
    n, m = x.shape
    width = BINS + 1
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    out_f, out_l, out_v = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    columns = np.arange(m) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            places = 1 << level
            key = (at[:, None] * (m * width) + columns + binned).ravel()
            size = places * m * width
            sum_g = np.bincount(key, np.repeat(g, m), size).reshape(places, m, width).cumsum(2)
            sum_h = np.bincount(key, np.repeat(h, m), size).reshape(places, m, width).cumsum(2)
            count = np.bincount(key, minlength=size).reshape(places, m, width).cumsum(2)
            all_g, all_h, all_n = sum_g[:, :1, -1:], sum_h[:, :1, -1:], count[:, :1, -1:]
            better = sum_g**2 / (sum_h + RIDGE) + (all_g - sum_g) ** 2 / (all_h - sum_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            better[(count < LEAST_LEAF) | (all_n - count < LEAST_LEAF)] = 0
            best = better.reshape(places, -1).argmax(1)
            split = better.reshape(places, -1).max(1) > 1e-6
            feature, bin_ = best // width, best % width
            base = places - 1
            for k in range(places):
                if split[k]:
                    out_f[t, base + k], out_l[t, base + k] = feature[k], limits[feature[k]][bin_[k]]
            right = split[at] & (binned[np.arange(n), feature[at]] > bin_[at])
            at = 2 * at + right
        value = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + RIDGE)
        out_v[t] = value
        score += value[at]
    return Trees(start, out_f, out_l, out_v)
