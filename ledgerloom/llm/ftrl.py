"""Follow-the-regularised-leader (proximal, per coordinate) for logistic loss on sparse rows.

McMahan et al., "Ad click prediction: a view from the trenches", 2013.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1
    epochs: int = 4


class Ftrl:
    """State z, n for each feature, and for the bias in the last place, which has no penalty."""

    def __init__(self, params: FtrlParams) -> None:
        self.p = params
        self.z = np.zeros((1 << params.bits) + 1)
        self.n = np.zeros((1 << params.bits) + 1)

    def weights(self, ids: np.ndarray) -> np.ndarray:
        p, z = self.p, self.z[ids]
        l1 = np.where(ids == len(self.z) - 1, 0.0, p.l1)
        w = -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(self.n[ids])) / p.alpha + p.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, ids: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        square = gradient * gradient
        n = self.n[ids]
        self.z[ids] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.p.alpha * weights
        self.n[ids] = n + square

    def dense(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train_rows(state: Ftrl, rows, labels: np.ndarray, epochs: int, seed: int, contrasts=None, penalty: float = 0.0) -> None:
    """Passes over sparse rows in a seeded order.

    ``contrasts``: for a row's place, the (features, values) of row minus counterfactual row; the
    step adds the gradient of penalty / 2 * (weights . contrast) ** 2.
    """
    ptr, ids, value = rows
    bias = len(state.z) - 1
    for epoch in range(epochs):
        for i in np.random.default_rng([seed, epoch]).permutation(len(labels)):
            f = np.append(ids[ptr[i] : ptr[i + 1]], bias)
            v = np.append(value[ptr[i] : ptr[i + 1]], np.float32(1))
            w = state.weights(f)
            state.step(f, (sigmoid(w @ v) - labels[i]) * v, w)
            if contrasts and i in contrasts:
                f, v = contrasts[i]
                w = state.weights(f)
                state.step(f, penalty * (w @ v) * v, w)
