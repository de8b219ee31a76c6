"""Tails of the normal and chi-square distributions, and quadrature, for small results on the driver."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail: a series below df + 2, a continued fraction above."""
    if x <= 0:
        return 1.0
    a, t = df / 2, x / 2
    scale = math.exp(-t + a * math.log(t) - math.lgamma(a))
    if t < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= t / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = t + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def normal_quadrature(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of Gauss-Hermite quadrature for the standard normal density."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return x * math.sqrt(2), w / math.sqrt(math.pi)


def erfc_column(x):
    """erfc of a column x >= 0, by a Chebyshev form with relative error under 1.2e-7."""
    from pyspark.sql import functions as F

    t = 1 / (1 + 0.5 * x)
    # coefficients of a known rational approximation, fixed values
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for v in reversed(c[:-1]):
        poly = v + t * poly
    return t * F.exp(-x * x + poly)


def chi2_sf_column(x, df: int):
    """Upper tail of chi-square with one (error under 1.2e-7 of it) or two degrees of freedom, as a column."""
    from pyspark.sql import functions as F

    if df == 2:
        return F.exp(-F.greatest(x, F.lit(0.0)) / 2)
    return erfc_column(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))
