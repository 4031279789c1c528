"""Small linear models on hashed features: fitted with numpy on a bounded sample, applied to flat feature arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Features that one step of a fit works on.
BLOCK = 1 << 20


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over [at[i], at[i + 1])."""
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Rows:
    """Sparse rows: row i has features idx[at[i]:at[i + 1]] with these values."""

    at: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def take(self, which: np.ndarray) -> Rows:
        sizes = (self.at[1:] - self.at[:-1])[which]
        at = np.concatenate([[0], np.cumsum(sizes)])
        pick = np.repeat(self.at[:-1][which] - at[:-1], sizes) + np.arange(at[-1])
        return Rows(at, self.idx[pick], self.val[pick])


def fit(rows: Rows, y: np.ndarray, width: int, extra: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 60, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch Adam: feature weights, weights of the dense extra columns, bias."""
    extra = np.zeros((len(y), 0)) if extra is None else extra
    k = extra.shape[1]
    cuts = [0]  # whole rows, about BLOCK features at a time: working arrays don't grow with the sample
    while cuts[-1] < len(y):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(rows.at, rows.at[cuts[-1]] + BLOCK, side="right")) - 1))
    blocks = [(a, b, slice(rows.at[a], rows.at[b])) for a, b in zip(cuts, cuts[1:])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(width + k + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = extra @ w[width : width + k] + w[-1]
        for a, b, own in blocks:
            z[a:b] += sums(w[rows.idx[own]] * rows.val[own], rows.at[a : b + 1] - rows.at[a])
        miss = (sigmoid(z) - y) / len(y)
        slope = np.zeros(width)
        for a, b, own in blocks:
            slope += np.bincount(rows.idx[own], np.repeat(miss[a:b], np.diff(rows.at[a : b + 1])) * rows.val[own], minlength=width)
        g = np.concatenate([slope, extra.T @ miss, [miss.sum()]])
        g[:-1] += l2 * w[:-1] / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:width], w[width : width + k], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on few dense columns by Newton steps: weights, then bias. With one column, Platt's scaling."""
    x = np.column_stack([x, np.ones(len(y))])
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    goal = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    w, pull = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(50):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (p - goal) + pull * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def folds(ids: np.ndarray, n: int) -> np.ndarray:
    """A fold of each row by its id, so that copies of a row share it."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
