"""Sparse multinomial logistic regression, trained by follow-the-regularised-leader.

Every coordinate keeps the sum of its gradients (shifted by past weights) and
of their squares; its weight is the closed-form minimum of that linear sum plus
an elastic-net penalty, so the L1 part holds weights at exactly zero. One
temperature, fitted afterwards on examples that training has not seen, scales
the logits to calibrated probabilities.
"""

from __future__ import annotations

import numpy as np

ALPHA, BETA = 0.5, 1.0    # learning rate and its damping
L1, L2 = 0.02, 0.001      # elastic net
EPOCHS = 4


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Weights of ``features`` features (the last one is the bias) for ``classes`` classes."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example: distinct feature rows and their values."""
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p
        old = self.n[rows]
        new = old + g * g
        self.z[rows] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[rows] = new


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, classes: int,
          epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """The weights after ``epochs`` shuffled rounds over all examples."""
    model, order = Ftrl(features, classes), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)).tolist():
            model.learn(*examples[i], int(labels[i]))
    return model.weights()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss (golden section on its logarithm);
    1 without examples. It stays within [0.05, 20]."""
    if not labels.size:
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(labels.size), labels], 1e-300)).mean())

    lo, hi = np.log(0.05), np.log(20.0)
    ratio = (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
