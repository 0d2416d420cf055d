"""Sparse multinomial logistic regression: follow-the-regularised-leader with elastic net, and temperature."""

from __future__ import annotations

import numpy as np

Example = tuple[np.ndarray, np.ndarray, int]  # feature indices, values, class


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal for `classes` softmax outputs over `features` inputs and a bias."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, features

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def fit(self, examples: list[Example], epochs: int = 3, seed: int = 1) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(examples)).tolist():
                index, value, label = examples[k]
                at = np.append(index, self.bias)
                x = np.append(value, 1.0)
                w = self.weights(at)
                error = softmax(x @ w)
                error[label] -= 1.0
                g = x[:, None] * error
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        return self

    def logits(self, index: np.ndarray, value: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        w = self.weights() if w is None else w
        return value @ w[index] + w[self.bias]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm; 1 without examples."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.1), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
