"""Gradient-boosted trees for binary targets on small tables, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth, grown level by level on the logistic loss; a split is on one column's value."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.25, penalty: float = 1.0, cuts: int = 16):
        self.trees, self.depth, self.rate, self.penalty, self.cuts = trees, depth, rate, penalty, cuts
        self.start = 0.0
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, self.cuts))) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        z = np.full(len(y), self.start)
        width = self.cuts + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            columns, limits = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                n, first = 2**level, 2**level - 1
                best = np.full(n, 1e-9)
                for k, e in enumerate(edges):
                    at = leaf * width + binned[:, k]
                    gs = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                    score = lambda a, b: a * a / (b + self.penalty)
                    gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                    gain = gain[:, : len(e)]
                    if gain.shape[1]:
                        cut = gain.argmax(1)
                        better = gain[np.arange(n), cut] > best
                        best = np.where(better, gain[np.arange(n), cut], best)
                        columns[first : first + n] = np.where(better, k, columns[first : first + n])
                        limits[first : first + n] = np.where(better, e[cut], limits[first : first + n])
                node = first + leaf
                leaf = 2 * leaf + (x[np.arange(len(y)), columns[node]] > limits[node])
            total_g, total_h = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            values = self.rate * total_g / (total_h + self.penalty)
            z += values[leaf]
            self.grown.append((columns, limits, values))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z, at = np.full(len(x), self.start), np.arange(len(x))
        for columns, limits, values in self.grown:
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[at, columns[node]] > limits[node])
            z += values[leaf]
        return z


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt's a, b: the chance is 1 / (1 + exp(-(a * margin + b)))."""
    a, b = 1.0, 0.0
    t = (y * (y.sum() + 1) + (1 - y)) / (y * (y.sum() + 2) + (1 - y) * (len(y) - y.sum() + 2))  # smoothed targets
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        e, w = p - t, p * (1 - p) + 1e-6
        g = np.array([(e * margin).sum(), e.sum()])
        h = np.array([[(w * margin**2).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
    return float(a), float(b)


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least chance from which on the precision is reached, in held-out cases; 1 if it isn't."""
    order = np.argsort(-p, kind="stable")
    ok = np.flatnonzero(np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision)
    return float(p[order][ok[-1]]) if len(ok) else 1.0
