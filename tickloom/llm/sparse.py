"""Follow-the-regularised-leader for sparse linear models, and where letters are."""

from __future__ import annotations

import numpy as np

from tickloom.llm.textops import U

LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])


class Ftrl:
    """FTRL-proximal with elastic net over a dense table of accumulators; a row touches only its own features."""

    def __init__(self, shape: tuple[int, ...], alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, w: np.ndarray, grad: np.ndarray) -> None:
        n = self.n[at]
        sigma = (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.alpha
        self.z[at] += grad - sigma * w
        self.n[at] = n + grad * grad


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def bucket(h: np.ndarray, size: int) -> np.ndarray:
    return (h % U(size)).astype(np.int64)
