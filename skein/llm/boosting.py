"""Gradient-boosted trees for two classes, on histograms, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete trees of one depth in heap order; a node sends rows with value <= at to the left."""

    feature: np.ndarray  # trees x inner nodes
    at: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    start: float
    #: Calibration of the margin m to a probability: 1 / (1 + exp(-(slope * m + shift))).
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, at, leaf in zip(self.feature, self.at, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosting by Newton steps on the logistic loss; splits at quantiles of each feature."""
    rows, features = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if rows else np.zeros(0) for f in range(features)]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rate_y = (y.sum() + 0.5) / (rows + 1)
    start = float(np.log(rate_y / (1 - rate_y)))
    margin = np.full(rows, start)
    inner = 2**depth - 1
    all_feature, all_at, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, at = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = node - first
            best = np.full(n, 1e-6)
            for f in range(features):
                m = len(cuts[f])
                if not m:
                    continue
                key = local * (m + 1) + code[:, f]
                G, H, C = (np.bincount(key, w, n * (m + 1)).reshape(n, m + 1) for w in (g, h, None))
                gl, hl, cl = (np.cumsum(a, axis=1)[:, :-1] for a in (G, H, C))
                gt, ht, ct = (a.sum(axis=1)[:, None] for a in (G, H, C))
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(n), k]
                for i in np.flatnonzero(top > best):
                    best[i], feature[first + i], at[first + i] = top[i], f, cuts[f][k[i]]
            node = 2 * node + 1 + (x[np.arange(rows), feature[node]] > at[node])
        leaf_of = node - inner
        leaf = -rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + ridge)
        margin += leaf[leaf_of]
        all_feature.append(feature)
        all_at.append(at)
        all_leaf.append(leaf)
    return Trees(np.array(all_feature), np.array(all_at), np.array(all_leaf), start)


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """Platt scaling on rows that the model has not seen."""
    m = np.clip(model.margin(x), -30, 30)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * m).sum(), (p - target).sum()])
        hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return model._replace(slope=float(a), shift=float(b))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds whose F1 on held-out rows is the best but for a thousandth."""
    tries = np.linspace(0.05, 0.95, 91)
    hit = np.array([((p >= t) & (y > 0)).sum() for t in tries])
    said = np.array([(p >= t).sum() for t in tries])
    f1 = 2 * hit / np.maximum(said + y.sum(), 1)
    return float(np.median(tries[f1 >= f1.max() - 1e-3]))
