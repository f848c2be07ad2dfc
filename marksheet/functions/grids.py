"""Fixed quadrature grids, used as literals in column expressions."""
from __future__ import annotations

import numpy as np


def normal_grid(size: int = 40, low: float = -6.0, high: float = 6.0,
                weights: str = "normal") -> tuple[list[float], list[float]]:
    """Equally spaced nodes and weights that sum to 1."""
    nodes = np.linspace(low, high, size)
    if weights == "uniform":
        mass = np.ones(size)
    elif weights == "normal":
        mass = np.exp(-nodes ** 2 / 2)
    else:
        raise ValueError(f"unknown weights {weights!r}")
    return nodes.tolist(), (mass / mass.sum()).tolist()


def hermite_grid(size: int = 11) -> tuple[list[float], list[float]]:
    """Gauss-Hermite nodes and weights for a standard normal ability."""
    x, w = np.polynomial.hermite.hermgauss(size)
    return (x * np.sqrt(2)).tolist(), (w / np.sqrt(np.pi)).tolist()
