"""Logistic regression in NumPy for the small models of this subpackage."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Sparse:
    """Rows of a matrix as (row, column, value) sorted by row."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.shape[1])

    def take(self, keep: np.ndarray) -> Sparse:
        to = np.cumsum(keep) - 1
        at = keep[self.row]
        return Sparse(to[self.row[at]], self.column[at], self.value[at], (int(keep.sum()), self.shape[1]))


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.shape = x, x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return (self.x @ w.astype(self.x.dtype)).astype(float)

    def back(self, r: np.ndarray) -> np.ndarray:
        return (r.astype(self.x.dtype) @ self.x).astype(float)

    def take(self, keep: np.ndarray) -> Dense:
        return Dense(self.x[keep])


def fit(x: Sparse | Dense, more: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (of x's columns, of ``more``'s columns, bias) for labels y in 0..1, by accelerated gradient descent.

    One class only: no weights, the bias says the share.
    """
    n, d, m = len(y), x.shape[1], more.shape[1]
    w = np.zeros(d + m + 1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.001
    w[-1] = np.log(share / (1 - share))
    if not n or y.max() == y.min():
        return w
    # The step: an upper bound of the largest eigenvalue of X'X / n by power iteration.
    v = np.random.default_rng(5).normal(size=d + m + 1)
    for _ in range(12):
        v /= np.linalg.norm(v) + 1e-12
        r = x.dot(v[:d]) + more @ v[d : d + m] + v[-1]
        v = np.concatenate([x.back(r), r @ more, [r.sum()]]) / n
    step = 4 / (1.3 * np.linalg.norm(v) + 1e-9)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        r = sigmoid(x.dot(ahead[:d]) + more @ ahead[d : d + m] + ahead[-1]) - y
        g = np.concatenate([x.back(r), r @ more, [r.sum()]]) / n
        g[:-1] += penalty * ahead[:-1]
        new = ahead - step * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def margins(x: Sparse | Dense, more: np.ndarray, w: np.ndarray) -> np.ndarray:
    d, m = x.shape[1], more.shape[1]
    return x.dot(w[:d]) + more @ w[d : d + m] + w[-1]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of p with the best F1, midway between neighbours; 1.01 (nothing passes) without positives."""
    if not y.any():
        return 1.01
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    cut = np.append(p[order][1:] < p[order][:-1], True)
    i = int(np.flatnonzero(cut)[np.argmax(f1[cut])])
    low = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + low) / 2)
