"""Small linear models, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


#: Numbers of a matrix that may be kept as doubles.
WIDEN = 50_000_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(
    x: np.ndarray,
    sign: np.ndarray,
    weight: np.ndarray | None = None,
    loss: str = "logistic",
    l2: float = 1e-3,
    rounds: int = 150,
) -> np.ndarray:
    """Weights, the last for the constant, by accelerated gradient descent.

    ``sign`` is 1 or -1.  ``loss`` is "logistic" (a logistic regression) or
    "hinge" (a linear support vector machine with squared hinge loss).
    """
    n, d = x.shape
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    if x.size <= WIDEN:
        x = x.astype(np.float64)  # once, instead of in every product
    weight = np.ones(n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-9)
    curve = 0.25 if loss == "logistic" else 2.0
    # the largest eigenvalue of the weighted second moments, by power iteration
    v = np.ones(d + 1)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v = v / max(top, 1e-12)
    step = 1.0 / (curve * top * 1.05 + l2)
    penalty = np.full(d + 1, l2)
    penalty[-1] = 0.0
    w, ahead, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    for _ in range(rounds):
        margin = sign * (x @ ahead)
        if loss == "logistic":
            slope = -sign * sigmoid(-margin)
        else:
            slope = -2.0 * sign * np.maximum(0.0, 1.0 - margin)
        nxt = ahead - step * (x.T @ (weight * slope) + penalty * ahead)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = nxt + (before - 1) / t * (nxt - w)
        w = nxt
    return w


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
