"""Logistic regression with few features, fitted by Newton's method."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Logistic(NamedTuple):
    centre: tuple
    spread: tuple
    weights: tuple

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.centre)) / np.array(self.spread)
        return z @ np.array(self.weights[1:]) + self.weights[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[Logistic, float]:
    """The model and its mean loss; features are standardised, and the penalty keeps separable labels finite."""
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack((np.ones(len(x)), (x - centre) / spread))
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gradient = z.T @ (p - y) + ridge @ w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -35, 35))), 1e-12, 1 - 1e-12)
    loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    return Logistic(tuple(centre), tuple(spread), tuple(w)), loss
