"""Gradient-boosted trees for a binary label, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth; node k's children are 2k+1 and 2k+2."""

    depth: int
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Fit on logistic loss with second-order gains over quantile bins."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    edges = [np.unique(np.append(e, x[x[:, j] > 0, j].min() / 2)) if (x[:, j] > 0).any() else e for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    out = Trees(depth, float(np.log(mean / (1 - mean))))
    margin = np.full(n, out.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, c, v = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(n, np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            if len(rows) > 1:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j in range(m):
                    left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], width))[: len(edges[j])]
                    left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], width))[: len(edges[j])]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    if len(gain) and gain.max() > best:
                        best, f[k], c[k] = gain.max(), j, edges[j][int(gain.argmax())]
            node[rows] = 2 * k + 1 + (x[rows, f[k]] > c[k])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += v[leaf]
        out.features.append(f)
        out.cuts.append(c)
        out.leaves.append(v)
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function of x nearest to y, by pooling adjacent violators; interpolate between them."""
    order = np.argsort(x, kind="stable")
    values, weights, lows, highs = [], [], [], []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        values.append(b)
        weights.append(1.0)
        lows.append(a)
        highs.append(a)
        while len(values) > 1 and values[-2] >= values[-1]:
            w = weights[-2] + weights[-1]
            values[-2] = (values[-2] * weights[-2] + values[-1] * weights[-1]) / w
            weights[-2], highs[-2] = w, highs[-1]
            for s in (values, weights, lows, highs):
                s.pop()
    xs = np.array([p for pair in zip(lows, highs) for p in pair])
    ys = np.repeat(np.array(values), 2)
    keep = np.concatenate([[True], np.diff(xs) > 0]) if len(xs) else np.zeros(0, bool)
    return xs[keep], ys[keep]
