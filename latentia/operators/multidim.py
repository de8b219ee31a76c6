"""Several traits: discrimination and difficulty over all, directions, weights, rotation and matching of loadings.

Banks have an array of slopes; loadings are items x factors on the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.functions.families import dot


def overall(bank: DataFrame) -> DataFrame:
    """item_id, discrimination (length of the slopes), difficulty (-d over it) and the cosines of its direction; bank: item_id, slopes, d."""
    length = F.sqrt(dot(F.col("slopes"), F.col("slopes")))
    safe = F.greatest(length, F.lit(1e-10))
    return bank.select("item_id", length.alias("discrimination"), (-F.col("d") / safe).alias("difficulty"), F.transform("slopes", lambda a: a / safe).alias("cosines"))


def composite_weights(bank: DataFrame) -> DataFrame:
    """trait (from 0) and its weight in the composite that the items measure best on the whole: the sum of slopes, of length 1."""
    sums = bank.select(F.posexplode("slopes").alias("trait", "a")).groupBy("trait").agg(F.sum("a").alias("s"))
    length = sums.agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    return sums.join(F.broadcast(length)).select("trait", F.try_divide(F.col("s"), F.col("length")).alias("weight"))


def simplicity(method: str, n: int, k: int, gamma: float):
    """Criterion and its gradient, for gradient projection."""
    if method in ("varimax", "quartimax"):
        g = 1.0 if method == "varimax" else 0.0

        def f(x):
            sq = x * x
            centred = sq - g * sq.mean(0)
            return -float((sq * centred).sum()) / 4, -x * centred

        return f
    if method == "oblimin":
        off = np.ones((k, k)) - np.eye(k)
        part = np.eye(n) - gamma * np.ones((n, n)) / n

        def f(x):
            sq = x * x
            m = part @ sq @ off
            return float((sq * m).sum()) / 4, x * m

        return f
    if method == "geomin":

        def f(x):
            sq = x * x + 0.01
            pro = np.exp(np.log(sq).mean(1))
            return float(pro.sum()), (2 / k) * x / sq * pro[:, None]

        return f
    raise ValueError(f"unknown rotation {method}")


def rotate(loadings: np.ndarray, method: str = "varimax", gamma: float = 0.0, max_iter: int = 1000, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated loadings, the rotation and the factors' correlations: varimax and quartimax keep factors apart, oblimin, geomin and promax let them correlate."""
    a = np.asarray(loadings, float)
    n, k = a.shape
    if method == "promax":
        x, t, _ = rotate(a, "varimax", max_iter=max_iter, tol=tol)
        target = np.sign(x) * np.abs(x) ** 4
        u = np.linalg.lstsq(x, target, rcond=None)[0]
        u = u @ np.diag(np.sqrt(np.diag(np.linalg.inv(u.T @ u))))
        whole = t @ u
        inverse = np.linalg.inv(whole)
        return a @ whole, whole, inverse @ inverse.T
    f, oblique = simplicity(method, n, k, gamma), method in ("oblimin", "geomin")
    t, step = np.eye(k), 1.0

    def at(t):
        x = a @ np.linalg.inv(t).T if oblique else a @ t
        value, g = f(x)
        return x, value, -(x.T @ g @ np.linalg.inv(t)).T if oblique else a.T @ g

    x, value, g = at(t)
    for _ in range(max_iter):
        if oblique:
            gp = g - t * (t * g).sum(0)
        else:
            m = t.T @ g
            gp = g - t @ (m + m.T) / 2
        size = float(np.sqrt((gp * gp).sum()))
        if size < tol:
            break
        step *= 2
        for _ in range(30):
            y = t - step * gp
            if oblique:
                new = y / np.sqrt((y * y).sum(0))
            else:
                u, _, v = np.linalg.svd(y)
                new = u @ v
            nx, nv, ng = at(new)
            if nv < value - 0.5 * size * size * step:
                break
            step /= 2
        t, x, value, g = new, nx, nv, ng
    return x, t, (t.T @ t if oblique else np.eye(k))


def procrustes(source: np.ndarray, target: np.ndarray, oblique: bool = False) -> np.ndarray:
    """The matrix that brings source closest to target: orthogonal, or by least squares with columns of length 1."""
    if oblique:
        m = np.linalg.lstsq(source, target, rcond=None)[0]
        return m / np.sqrt((m * m).sum(0))
    u, _, v = np.linalg.svd(source.T @ target)
    return u @ v


def congruence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines between the factors of two loadings."""
    length = lambda m: np.sqrt((m * m).sum(0))
    return x.T @ y / np.maximum(np.outer(length(x), length(y)), 1e-300)


def matched(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """For each factor of x the one of y and its sign, by the greatest sum of absolute cosines; up to eight factors are tried out in full."""
    c = congruence(x, y)
    k = len(c)
    if k <= 8:
        best = max(itertools.permutations(range(k)), key=lambda p: sum(abs(c[i, j]) for i, j in enumerate(p)))
    else:
        best, free = [], set(range(k))
        for i in range(k):
            j = max(free, key=lambda j: abs(c[i, j]))
            best.append(j)
            free.remove(j)
    return list(best), [1 if c[i, j] >= 0 else -1 for i, j in enumerate(best)]


def link_traits(old: np.ndarray, new: np.ndarray, d_old: np.ndarray, d_new: np.ndarray, oblique: bool = False) -> dict:
    """Rotation and shift that bring slopes and intercepts of common items to the old scale, and how well they fit."""
    r = procrustes(new, old, oblique)
    slopes = new @ r
    shift = np.linalg.lstsq(slopes, d_old - d_new, rcond=None)[0]
    return {"rotation": r, "shift": shift, "rms_slopes": float(np.sqrt(((slopes - old) ** 2).mean())), "rms_intercepts": float(np.sqrt(((d_new + slopes @ shift - d_old) ** 2).mean())), "congruence": np.diag(congruence(slopes, old))}


def transform_traits(theta: DataFrame, rotation: np.ndarray, shift: np.ndarray) -> DataFrame:
    """Abilities (array thetas) on the old scale: the inverse rotation less the shift."""
    m = np.linalg.inv(rotation)
    rows = [F.aggregate(F.zip_with("thetas", F.array(*[F.lit(float(v)) for v in m[j]]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - float(shift[j]) for j in range(len(m))]
    return theta.withColumn("thetas", F.array(*rows))


def reliability_parts(general: np.ndarray, specific: np.ndarray, groups: np.ndarray) -> dict[str, float]:
    """Of a bifactor model's loadings: omega, its part of the general factor, and the share of common variance that this explains."""
    g = general.sum() ** 2
    s = sum(specific[groups == k].sum() ** 2 for k in np.unique(groups))
    unique = (1 - general**2 - specific**2).sum()
    return {"omega": float((g + s) / (g + s + unique)), "omega_general": float(g / (g + s + unique)), "common_variance": float((general**2).sum() / ((general**2).sum() + (specific**2).sum()))}
