"""Learned embedding projections: full (y = W x) and low-rank (y = x + U V x), trained on triples by margin ascent."""

from __future__ import annotations

import numpy as np

from ..functions.vectors import lcg

RANK, RATE, L2, EPOCHS, MARGIN, SEED, SCALE = 16, 0.05, 0.01, 30, 0.1, 1234567, 0.01


def identity(dim: int) -> dict:
    return {"dim": dim, "m": np.eye(dim).ravel().tolist()}


def identity_lowrank(dim: int, rank: int = RANK) -> dict:
    return {"kind": "lowrank", "dim": dim, "rank": rank, "U": [0.0] * (dim * rank), "V": [0.0] * (dim * rank)}


def raw(weights: dict | None, x: np.ndarray) -> np.ndarray:
    if not weights or weights.get("dim") != len(x):
        return x
    if weights.get("kind") == "lowrank":
        u, v = np.reshape(weights["U"], (len(x), -1)), np.reshape(weights["V"], (-1, len(x)))
        return x + u @ (v @ x)
    return np.reshape(weights["m"], (len(x), len(x))) @ x


def apply(weights: dict | None, x: np.ndarray) -> np.ndarray:
    y = raw(weights, x)
    size = float(np.linalg.norm(y))
    return y / size if size and y is not x else y


def loss(weights: dict, triples: list[tuple], margin: float = MARGIN) -> float:
    """Mean hinge of (W q)(W p) - (W q)(W n) under the margin, over (query, positive, negatives)."""
    gaps = [max(0.0, margin - float(raw(weights, q) @ (raw(weights, p) - raw(weights, n)))) for q, p, negatives in triples for n in negatives]
    return float(np.mean(gaps)) if gaps else 0.0


def train(triples: list[tuple], dim: int, rate: float = RATE, l2: float = L2, epochs: int = EPOCHS, margin: float = MARGIN) -> dict:
    """Full matrix, from the identity and drawn back to it; steps go in the order of the triples."""
    w, eye = np.eye(dim), np.eye(dim)
    for _ in range(epochs):
        for q, p, negatives in triples:
            for n in negatives:
                d = p - n
                if (w @ q) @ (w @ d) < margin:
                    w = w + rate * (np.outer(w @ q, d) + np.outer(w @ d, q)) - rate * l2 * (w - eye)
    return {"dim": dim, "m": w.ravel().tolist()}


def train_lowrank(triples: list[tuple], dim: int, rank: int = RANK, rate: float = RATE, l2: float = 0.001, epochs: int = EPOCHS, margin: float = MARGIN, seed: int = SEED) -> dict:
    """The same for I + U V; both factors start from small numbers of lcg(seed)."""
    rand = lcg(seed)
    u = np.array([(next(rand) - 0.5) * 2 * SCALE for _ in range(dim * rank)]).reshape(dim, rank)
    v = np.array([(next(rand) - 0.5) * 2 * SCALE for _ in range(dim * rank)]).reshape(rank, dim)
    for _ in range(epochs):
        for q, p, negatives in triples:
            for n in negatives:
                d, hq = p - n, v @ q
                hd = v @ d
                zq, zd = q + u @ hq, d + u @ hd
                if zq @ zd < margin:
                    du, dv = np.outer(zd, hq) + np.outer(zq, hd), np.outer(u.T @ zd, q) + np.outer(u.T @ zq, d)
                    u, v = u + rate * (du - l2 * u), v + rate * (dv - l2 * v)
    return {"kind": "lowrank", "dim": dim, "rank": rank, "U": u.ravel().tolist(), "V": v.ravel().tolist()}
