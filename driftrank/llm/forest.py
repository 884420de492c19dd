"""A small random forest for two classes in numpy; flat arrays, vectorised over rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Per tree and node: feature (-1 at a leaf), cut, left child (right is left + 1), share of class 1."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 over the trees, per row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, l, s in zip(self.feature, self.cut, self.left, self.share):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = f[node] >= 0
                if not inner.any():
                    break
                here, at = node[inner], rows[inner]
                node[inner] = l[here] + (x[at, f[here]] > c[here])
            total += s[node]
        return total / len(self.feature)


def _best_cut(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, float]:
    """(impurity, cut) of the best split of one feature; infinite impurity if there is none."""
    order = np.argsort(x, kind="stable")
    v, ones = x[order], np.cumsum(y[order])
    n, k = len(v), np.arange(1, len(v))
    ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
    if not ok.any():
        return np.inf, 0.0
    lo, hi = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
    impurity = np.where(ok, k * lo * (1 - lo) + (n - k) * hi * (1 - hi), np.inf)
    i = int(impurity.argmin())
    return float(impurity[i]), float((v[i] + v[i + 1]) / 2)


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 8, least: int = 3, seed: int = 11) -> Forest:
    """Bootstrap trees, each split over a random square root of the features."""
    rng = np.random.default_rng(seed)
    width = max(1, int(round(np.sqrt(x.shape[1]))))
    size = 2 ** (depth + 1)
    feature = np.full((trees, size), -1, dtype=np.int64)
    cut, left, share = np.zeros((trees, size)), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        sample = rng.integers(0, len(y), len(y))
        todo, used = [(0, sample, 0)], 1
        while todo:
            node, rows, level = todo.pop()
            share[t, node] = y[rows].mean()
            if level == depth or share[t, node] in (0.0, 1.0):
                continue
            found = [(*_best_cut(x[rows, f], y[rows], least), f) for f in rng.choice(x.shape[1], width, replace=False)]
            impurity, at, f = min(found)
            if not np.isfinite(impurity):
                continue
            feature[t, node], cut[t, node], left[t, node] = f, at, used
            high = x[rows, f] > at
            todo += [(used, rows[~high], level + 1), (used + 1, rows[high], level + 1)]
            used += 2
    return Forest(feature, cut, left, share)
