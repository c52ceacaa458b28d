"""Linear classifiers as columns of one coefficient matrix (M2, M4): logistic and smoothed hinge loss, l1, l2 or no penalty.

All columns advance together by accelerated proximal gradient steps whose step sizes come from a diagonal bound of the
curvature, so one pass over the rows serves every penalty.  A column's path is read off at each (tol, max_iter) stop:
the first step at which the largest change of a coefficient is at most ``tol`` times the largest coefficient, or
``max_iter`` steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

HINGE_WIDTH = 0.5  # of the quadratic part that smooths the hinge
CURVATURE = {"logistic": 0.25, "hinge": 1.0 / HINGE_WIDTH}


@dataclass(frozen=True)
class Objective:
    """mean loss + strength × penalty, strength = 1 / (C n) as sums and means of the loss are weighed."""

    loss: str  # logistic or hinge
    penalty: str | None  # l1, l2 or None
    c: float


def loss_slope(loss: str, margin: np.ndarray) -> np.ndarray:
    """Derivative of the loss by the signed margin."""
    if loss == "logistic":
        return -1.0 / (1.0 + np.exp(np.clip(margin, -50, 50)))
    return -np.clip((1.0 - margin) / HINGE_WIDTH, 0.0, 1.0)


def gradient(x: np.ndarray, sign: np.ndarray, w: np.ndarray, losses: list[str]) -> np.ndarray:
    """Sum over the rows of ``x`` (last column 1) of the loss gradients: one column per column of ``w``."""
    margin = (x @ w.astype(x.dtype)).astype(np.float64) * sign[:, None]
    slope = np.empty_like(margin)
    for loss in set(losses):
        cols = [k for k, name in enumerate(losses) if name == loss]
        slope[:, cols] = loss_slope(loss, margin[:, cols])
    return (x.T @ (slope * sign[:, None]).astype(x.dtype)).astype(np.float64)


def curvature_bound(x: np.ndarray) -> np.ndarray:
    """Per coefficient, sum over rows of |x_j| × sum_k |x_k|: a diagonal matrix above x^T x."""
    a = np.abs(x)
    return a.T @ a.sum(axis=1)


def with_intercept(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)


def solve(x: np.ndarray, y: np.ndarray, objectives: list[Objective], stops: list[tuple[float, int]]) -> np.ndarray:
    """Coefficients (objectives, stops, features + 1), the last one the intercept, which is not penalized."""
    whole = [(with_intercept(x), np.where(y > 0, 1.0, -1.0))]
    return solve_parts(lambda: whole, len(x), objectives, stops)


def solve_parts(parts: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], n: int, objectives: list[Objective],
                stops: list[tuple[float, int]]) -> np.ndarray:
    """``solve`` on ``n`` rows that come in parts (rows with intercept, signs of the labels), anew for each step."""
    n = max(n, 1)
    bound = sum(curvature_bound(x).astype(np.float64) for x, _ in parts()) / n + 1e-12
    width = len(bound)
    out = np.zeros((len(objectives), len(stops), width))
    done = np.zeros((len(objectives), len(stops)), dtype=bool)
    live = np.arange(len(objectives))
    w = np.zeros((width, len(objectives)))
    ahead, t = w.copy(), np.ones(len(objectives))
    for step in range(1, max(m for _, m in stops) + 1):
        obj = [objectives[k] for k in live]
        size = np.stack([1.0 / (bound * CURVATURE[o.loss]) for o in obj], axis=1)
        strength = np.array([0.0 if o.penalty is None else 1.0 / (o.c * n) for o in obj])
        slope = sum(gradient(x, sign, ahead, [o.loss for o in obj]) for x, sign in parts())
        new = ahead - size * (slope / n)
        l1 = np.array([o.penalty == "l1" for o in obj])
        l2 = np.array([o.penalty == "l2" for o in obj])
        shrink = size[:-1] * strength
        new[:-1] = np.where(l1, np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - shrink, 0.0), new[:-1])
        new[:-1] = np.where(l2, new[:-1] / (1.0 + shrink), new[:-1])
        move = new - w
        # momentum starts anew where it points uphill
        uphill = ((ahead - new) * move / size).sum(axis=0) > 0
        t = np.where(uphill, 1.0, t)
        t_next = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        ahead = new + np.where(uphill, 0.0, (t - 1.0) / t_next) * move
        change, largest = np.abs(move).max(axis=0), np.abs(new).max(axis=0)
        w, t = new, t_next
        for s, (tol, most) in enumerate(stops):
            hit = ~done[live, s] & ((change <= tol * largest) | (step >= most))
            out[live[hit], s] = w[:, hit].T
            done[live[hit], s] = True
        going = ~done[live].all(axis=1)
        if not going.any():
            break
        live, w, ahead, t = live[going], w[:, going], ahead[:, going], t[going]
    return out


def decision(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Signed distances; ``w`` has the intercept last."""
    return x @ w[:-1] + w[-1]
