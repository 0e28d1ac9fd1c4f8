"""Small gradient-boosted trees over binned features, fitted on a bounded sample and evaluated inside tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 16


@dataclass
class Trees:
    """Additive trees of fixed depth: at node k, feature[k] <= cut[k] goes left. calibration: slope and offset of the log odds."""

    depth: int
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    calibration: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        slope, offset = self.calibration
        return sigmoid(slope * self.raw(x) + offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Log-loss boosting with second-order leaf values."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    z = np.full(len(x), model.start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    for _ in range(n_trees):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(x), int)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best = 1e-6
            total_g, total_h = g[here].sum(), h[here].sum()
            for f, e in enumerate(edges):
                if not len(e) or not len(here):
                    continue
                left_g = np.cumsum(np.bincount(binned[here, f], g[here], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[here, f], h[here], len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - total_g**2 / (total_h + penalty)
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, feature[k], cut[k] = gain[at], f, e[at]
            node[here] = 2 * k + 1 + (x[here, feature[k]] > cut[k])
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + penalty)
        z += leaf[at]
        model.trees.append((feature, cut, leaf))
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
    """Slope and offset of the log odds by Newton steps on rows that the trees haven't seen; targets are drawn in from 0 and 1."""
    z = model.raw(x)
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    design = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(steps):
        p = sigmoid(design @ w)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w -= np.clip(step, -2, 2)
    model.calibration = (float(w[0]), float(w[1]))


def precise_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold at and above which the share of positives is at least the given one; 1.01 if there is none."""
    order = np.argsort(-p)
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((share >= precision) & np.append(p[order][1:] < p[order][:-1], True))
    return float(p[order][good[-1]]) if len(good) else 1.01
