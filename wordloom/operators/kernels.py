"""Kernel feature maps (M3): TensorSketch for the polynomial kernel, orthogonal random features for the rbf kernel.

The inner product of two mapped rows approximates the kernel; ``kernel_error`` measures by how much on given rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

COMPONENTS = 512
DEGREE = 3  # of the polynomial kernel (gamma <x, y>) ** 3
SEED = 666


@lru_cache(maxsize=4)
def _arrays(kind: str, dim: int, components: int, seed: int) -> tuple[np.ndarray, ...]:
    """Hashes and signs of the count sketches, or orthogonal directions; a function of the seed alone."""
    r = np.random.default_rng(seed)
    if kind == "poly":
        return r.integers(0, components, (DEGREE, dim)), r.choice([-1.0, 1.0], (DEGREE, dim))
    half = components // 2
    blocks = []
    for _ in range(-(-half // dim)):
        # orthonormal directions, each as long as a Gaussian vector would be
        q = np.linalg.qr(r.normal(size=(dim, min(half, dim))))[0]
        blocks.append(q * np.sqrt(r.chisquare(dim, q.shape[1])))
    return (np.concatenate(blocks, axis=1)[:, :half],)


@dataclass(frozen=True)
class KernelMap:
    kind: str  # rbf or poly
    gamma: float
    dim: int
    components: int = COMPONENTS
    seed: int = SEED

    def base(self, x: np.ndarray) -> np.ndarray:
        """What does not depend on ``gamma``: projections on the directions, or the sketch of the tensor product."""
        arrays = _arrays(self.kind, self.dim, self.components, self.seed)
        if self.kind == "rbf":
            return x @ arrays[0]
        product = None
        row, col = np.nonzero(x)
        value, first = x[row, col], row * self.components
        for h, s in zip(*arrays, strict=True):
            # count sketch: coordinate j is added to bucket h[j] with sign s[j]
            sketch = np.bincount(first + h[col], weights=value * s[col], minlength=len(x) * self.components)
            f = np.fft.rfft(sketch.reshape(len(x), self.components), axis=1)
            product = f if product is None else product * f
        # the convolution of the sketches is the sketch of the tensor product
        return np.fft.irfft(product, n=self.components, axis=1)

    def of_base(self, base: np.ndarray) -> np.ndarray:
        if self.kind == "rbf":
            angle = base * math.sqrt(2.0 * self.gamma)
            return np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / math.sqrt(self.components // 2)
        return base * self.gamma ** (DEGREE / 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.of_base(self.base(x))


def exact_kernel(kind: str, gamma: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if kind == "poly":
        return (gamma * (x @ y.T)) ** DEGREE
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.exp(-gamma * np.maximum(square, 0.0))


def kernel_error(mapping: KernelMap, x: np.ndarray) -> float:
    """Error of the approximated kernel matrix of ``x`` relative to the exact one (Frobenius norms)."""
    z = mapping(x)
    exact = exact_kernel(mapping.kind, mapping.gamma, x, x)
    return float(np.linalg.norm(z @ z.T - exact) / max(np.linalg.norm(exact), 1e-300))


def gamma_of(setting: str | float, x: np.ndarray) -> float:
    """``scale``: 1 / (features × variance of all entries); ``auto``: 1 / features; a number: itself."""
    if setting == "auto":
        return 1.0 / x.shape[1]
    if setting == "scale":
        variance = float(x.var()) if x.size else 0.0
        return 1.0 / (x.shape[1] * variance) if variance > 0 else 1.0
    return float(setting)
