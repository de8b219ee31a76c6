"""Priors of parameters and densities of abilities on a grid."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from latentia.functions.special import normal_cdf


@dataclass(frozen=True)
class Prior:
    """log_density of a value, and the value it is highest at."""

    log_density: Callable[[float], float]
    mode: float | None = None

    def density(self, x: float) -> float:
        return math.exp(self.log_density(x))


def normal(mean: float = 0.0, sd: float = 1.0) -> Prior:
    if sd <= 0:
        raise ValueError("sd must be positive")
    return Prior(lambda x: -0.5 * ((x - mean) / sd) ** 2 - math.log(sd) - 0.5 * math.log(2 * math.pi), mean)


def truncated_normal(mean: float, sd: float, low: float = -math.inf, high: float = math.inf) -> Prior:
    inside = normal_cdf((high - mean) / sd) - normal_cdf((low - mean) / sd)
    base = normal(mean, sd)
    return Prior(lambda x: base.log_density(x) - math.log(inside) if low <= x <= high else -math.inf, min(max(mean, low), high))


def log_normal(mean: float = 0.0, sd: float = 1.0) -> Prior:
    base = normal(mean, sd)
    return Prior(lambda x: base.log_density(math.log(x)) - math.log(x) if x > 0 else -math.inf, math.exp(mean - sd * sd))


def beta(a: float, b: float) -> Prior:
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return Prior(lambda x: scale + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x) if 0 < x < 1 else -math.inf, (a - 1) / (a + b - 2) if a > 1 and b > 1 else None)


def uniform(low: float, high: float) -> Prior:
    return Prior(lambda x: -math.log(high - low) if low <= x <= high else -math.inf)


def gamma(shape: float, rate: float) -> Prior:
    scale = shape * math.log(rate) - math.lgamma(shape)
    return Prior(lambda x: scale + (shape - 1) * math.log(x) - rate * x if x > 0 else -math.inf, (shape - 1) / rate if shape >= 1 else None)


#: What a calibration may assume where nothing is known, and where little is.
DEFAULT = {"a": log_normal(0.0, 0.5), "b": normal(0.0, 2.0), "c": beta(5.0, 17.0)}
WEAK = {"a": log_normal(0.0, 1.0), "b": normal(0.0, 5.0), "c": beta(2.0, 8.0)}


def log_prior(priors: dict[str, Prior], values: dict[str, float]) -> float:
    """The sum over the parameters that have a prior."""
    return sum(priors[k].log_density(v) for k, v in values.items() if k in priors)


# densities of abilities: weights of grid points, adding up to 1


def normal_weights(grid: np.ndarray, mean: float = 0.0, sd: float = 1.0) -> np.ndarray:
    w = np.exp(-0.5 * ((grid - mean) / sd) ** 2)
    return w / w.sum()


def histogram(counts: np.ndarray) -> np.ndarray:
    """The empirical histogram: expected persons at each point."""
    return counts / counts.sum()


def standardised_histogram(grid: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The histogram moved to mean 0 and deviation 1, each point's share split between its new neighbours on the grid."""
    w = counts / counts.sum()
    mean = (w * grid).sum()
    sd = math.sqrt((w * (grid - mean) ** 2).sum())
    place = np.clip(((grid - mean) / sd - grid[0]) / (grid[1] - grid[0]), 0, len(grid) - 1)
    low = np.minimum(np.floor(place).astype(int), len(grid) - 2)
    out = np.zeros(len(grid))
    np.add.at(out, low, w * (1 - (place - low)))
    np.add.at(out, low + 1, w * (place - low))
    return out


def mixture(grid: np.ndarray, shares: list[float], means: list[float], sds: list[float]) -> np.ndarray:
    w = sum(s / d * np.exp(-0.5 * ((grid - m) / d) ** 2) for s, m, d in zip(shares, means, sds, strict=True))
    return w / w.sum()


def polynomial_curve(grid: np.ndarray, coefficients: list[float]) -> np.ndarray:
    """A normal density times the square of a polynomial."""
    w = np.polynomial.polynomial.polyval(grid, coefficients) ** 2 * np.exp(-0.5 * grid**2)
    return w / w.sum()
