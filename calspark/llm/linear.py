"""Small learners shared by the classifiers: hinge loss by dual coordinate descent, and calibration."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine (L1 hinge loss) over sparse rows (indices, values); labels are -1 and 1.

    Each step solves one dual variable exactly, between 0 and its row's cost.
    """
    rng, w, alpha = np.random.default_rng(seed), np.zeros(dimensions), np.zeros(len(rows))
    norms = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            if norms[i] == 0:
                continue
            gradient = labels[i] * float(w[at] @ values) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * labels[i] * values
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a and b such that 1 / (1 + exp(-(a * margin + b))) is the chance of label 1 (Newton steps, smoothed targets)."""
    positive, negative = int((labels > 0).sum()), int((labels <= 0).sum())
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = float(np.abs(margins).max()) or 1.0
    x, theta = np.stack([margins / scale, np.ones(len(margins))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * theta)
        theta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return float(theta[0]) / scale, float(theta[1])


def chance(margins: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
