"""Hashed features and linear models trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from zlib import crc32

import numpy as np


def hashed(tokens: list[str], bits: int) -> np.ndarray:
    """Bucket numbers of feature strings."""
    mask = (1 << bits) - 1
    return np.fromiter((crc32(t.encode()) & mask for t in tokens), dtype=np.int64, count=len(tokens))


def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ragged rows as flat buckets and row starts."""
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each ragged row; empty rows give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


class Logistic:
    """Binary logistic regression over hashed features (AdaGrad steps, L2)."""

    def __init__(self, bits: int = 18):
        self.bits, self.w = bits, np.zeros(1 << bits, dtype=np.float32)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 5, rate: float = 0.3, l2: float = 1e-6,
            batch: int = 256, seed: int = 7) -> Logistic:
        rng = np.random.default_rng(seed)
        seen = np.full(len(self.w), 1e-6, dtype=np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                flat, starts = pack([rows[i] for i in part])
                p = 1 / (1 + np.exp(-row_sums(self.w[flat], starts)))
                err = np.repeat((p - y[part]).astype(np.float32), np.diff(starts))
                touched, inv = np.unique(flat, return_inverse=True)
                g = np.bincount(inv, weights=err).astype(np.float32) / len(part) ** 0.5 + l2 * self.w[touched]
                seen[touched] += g * g
                self.w[touched] -= rate * g / np.sqrt(seen[touched])
        return self

    def proba(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, starts = pack(rows)
        return 1 / (1 + np.exp(-row_sums(self.w[flat], starts)))
