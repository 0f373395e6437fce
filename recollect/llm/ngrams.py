"""Hashed byte n-gram features of whole texts, and logistic regression on them in numpy."""

from __future__ import annotations

import numpy as np

#: Buckets of a byte trigram's hash.
BUCKETS = 4096


def trigrams(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each byte trigram of raw, padded by a space on either side."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - buckets.bit_length() + 1)


def features(raws: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """A row for each text: square roots of the trigrams' shares, a vector of length 1."""
    x = np.zeros((len(raws), buckets), np.float32)
    for row, raw in zip(x, raws):
        row += np.bincount(trigrams(raw, buckets), minlength=buckets)
        row /= max(1, len(raw))
    return np.sqrt(x, out=x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 120, rate: float = 30.0, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts for targets y (a column for each model, 0 to 1), by gradient descent with momentum."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    weight = np.ones((len(x), 1), np.float32) if weight is None else weight.reshape(-1, 1).astype(np.float32)
    total = float(weight.sum()) or 1.0
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        error = (sigmoid(x @ w + b) - y) * weight / total
        dw = 0.9 * dw + x.T @ error + l2 * w
        db = 0.9 * db + error.sum(0)
        w -= rate * 0.1 * dw
        b -= 0.1 * db
    return w, b
