"""Logistic regression on sparse rows, for bounded samples."""

from __future__ import annotations

import numpy as np


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, dim: int, l1: float = 0.0, l2: float = 1e-6, steps: int = 300, rate: float = 0.5, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept for targets y in 0..1, by Adam steps with soft thresholds at l1. rows, cols, vals: the entries of the matrix."""
    n = len(y)
    w, b = np.zeros(dim), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    weight = np.ones(n) if weight is None else weight / weight.mean()
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, vals * w[cols], n)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        g = np.bincount(cols, vals * e[rows], dim) + l2 * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / t**0.5 * 0.3
        size = np.sqrt(v / (1 - 0.99**t)) + 1e-8
        w = w - step * m / (1 - 0.9**t) / size
        if l1:
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1 / size)
        b -= step * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b
