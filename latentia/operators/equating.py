"""Linking of calibrations and equating of scores. Banks have a row for each item; what is solved on the driver is their anchors, bounded in number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentia.functions import irf

#: Most anchors of a linking that is solved on the driver.
MAX_ANCHORS = 100_000


def anchors(old: DataFrame, new: DataFrame) -> np.ndarray:
    """a and b of the items that both calibrations have: columns a_old, b_old, a_new, b_new."""
    both = old.select("item_id", "a", "b").join(new.select("item_id", F.col("a").alias("an"), F.col("b").alias("bn")), "item_id")
    rows = both.select("a", "b", "an", "bn").orderBy("item_id").limit(MAX_ANCHORS + 1).collect()
    if len(rows) > MAX_ANCHORS:
        raise ValueError(f"more than {MAX_ANCHORS} anchors")
    return np.array([tuple(r) for r in rows], float).reshape(-1, 4)


def curves(theta: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * (theta[:, None] - b), -700, 700)))


def grid_weights(low: float = -4.0, high: float = 4.0, n: int = 61) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(low, high, n)
    w = np.exp(-0.5 * x * x)
    return x, w / w.sum()


def criterion(table: np.ndarray, slope: float, shift: float, method: str, grid: tuple[np.ndarray, np.ndarray]) -> float:
    """haebara: weighted squared gaps of item curves; stocking_lord: of test curves; the new form moved to the old scale."""
    x, w = grid
    gap = curves(x, table[:, 0], table[:, 1]) - curves(x, table[:, 2] / slope, slope * table[:, 3] + shift)
    return float((w[:, None] * gap * gap).sum() if method == "haebara" else (w * gap.sum(1) ** 2).sum())


def simplex(f, start: np.ndarray, size: float = 0.1, steps: int = 400) -> np.ndarray:
    """Nelder and Mead's downhill simplex."""
    points = [start] + [start + size * e for e in np.eye(len(start))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if np.max(np.abs(points[-1] - points[0])) < 1e-10:
            break
        centre = np.mean(points[:-1], 0)
        move = lambda k: centre + k * (points[-1] - centre)  # noqa: B023, E731
        trial = move(-1.0)
        v = f(trial)
        if v < values[0]:
            far = move(-2.0)
            fv = f(far)
            points[-1], values[-1] = (far, fv) if fv < v else (trial, v)
        elif v < values[-2]:
            points[-1], values[-1] = trial, v
        else:
            near = move(-0.5) if v < values[-1] else move(0.5)
            nv = f(near)
            if nv < min(v, values[-1]):
                points[-1], values[-1] = near, nv
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def constants(table: np.ndarray, method: str = "mean_sigma", robust: bool = False) -> tuple[float, float]:
    """Slope and shift that bring the new scale to the old one: b_old = slope * b_new + shift.

    mean_sigma, mean_mean, haebara or stocking_lord. robust: medians and absolute deviations instead of means and
    deviations. Anchors whose difficulties do not vary give slope 1.
    """
    if not len(table):
        raise ValueError("no anchors")
    ao, bo, an, bn = table.T
    centre = np.median if robust else np.mean
    if method == "mean_mean":
        slope = float(centre(an) / centre(ao))
    else:
        spread = (lambda x: 1.4826 * np.median(np.abs(x - np.median(x)))) if robust else (lambda x: np.std(x, ddof=1) if len(x) > 1 else 0.0)
        slope = float(spread(bo) / spread(bn)) if spread(bn) > 1e-10 and spread(bo) > 0 else 1.0
    shift = float(centre(bo) - slope * centre(bn))
    if method in ("haebara", "stocking_lord"):
        grid = grid_weights()
        best = simplex(lambda p: criterion(table, float(np.exp(p[0])), float(p[1]), method, grid), np.array([np.log(slope), shift]))
        return float(np.exp(best[0])), float(best[1])
    return slope, shift


def link(old: DataFrame, new: DataFrame, method: str = "mean_sigma", robust: bool = False) -> DataFrame:
    """slope, shift, n_anchors, and the root mean square gaps of slopes, difficulties and curves after linking."""
    table = anchors(old, new)
    slope, shift = constants(table, method, robust)
    x, w = grid_weights()
    gaps = [np.sqrt(np.mean((table[:, 0] - table[:, 2] / slope) ** 2)), np.sqrt(np.mean((table[:, 1] - slope * table[:, 3] - shift) ** 2)), np.sqrt(criterion(table, slope, shift, "haebara", (x, w)) / len(table))]
    return old.sparkSession.createDataFrame([(method, slope, shift, len(table), *map(float, gaps))], "method string, slope double, shift double, n_anchors long, rms_a double, rms_b double, rms_curve double")


def bootstrap_errors(old: DataFrame, new: DataFrame, method: str = "mean_sigma", n: int = 200, seed: int = 0) -> tuple[float, float]:
    """Standard errors of slope and shift over resampled anchors."""
    table, rng = anchors(old, new), np.random.default_rng(seed)
    got = np.array([constants(table[rng.integers(0, len(table), len(table))], method) for _ in range(n)])
    return float(got[:, 0].std(ddof=1)), float(got[:, 1].std(ddof=1))


def transform(bank: DataFrame, slope: float, shift: float) -> DataFrame:
    """Parameters on the old scale; thresholds, if there are any, move with b."""
    out = bank.withColumns({"a": F.col("a") / slope, "b": slope * F.col("b") + shift})
    return out.withColumn("steps", F.transform("steps", lambda s: slope * s + shift)) if "steps" in bank.columns else out


def transform_scores(scores: DataFrame, slope: float, shift: float) -> DataFrame:
    out = scores.withColumn("theta", slope * F.col("theta") + shift)
    return out.withColumn("se", abs(slope) * F.col("se")) if "se" in scores.columns else out


def purified(old: DataFrame, new: DataFrame, threshold: float = 2.7, least: int = 3, method: str = "mean_sigma") -> tuple[list[int], float, float]:
    """Anchors that stay, slope and shift: the worst drifting item goes, by the robust z of its gap, until none is over the threshold."""
    both = old.select("item_id", "a", "b").join(new.select("item_id", F.col("a").alias("an"), F.col("b").alias("bn")), "item_id").orderBy("item_id").limit(MAX_ANCHORS + 1).collect()
    if len(both) > MAX_ANCHORS:
        raise ValueError(f"more than {MAX_ANCHORS} anchors")
    ids, table = [r["item_id"] for r in both], np.array([(r["a"], r["b"], r["an"], r["bn"]) for r in both], float)
    while True:
        slope, shift = constants(table, method, robust=method == "mean_sigma")
        d = np.hypot(table[:, 0] - table[:, 2] / slope, table[:, 1] - slope * table[:, 3] - shift)
        mad = 1.4826 * np.median(np.abs(d - np.median(d)))
        z = (d - np.median(d)) / mad if mad > 1e-10 else np.where(d - np.median(d) > 1e-10, np.inf, 0.0)
        worst = int(np.argmax(z))
        if len(ids) <= least or z[worst] <= threshold:
            slope, shift = constants(table, method)
            return ids, slope, shift
        ids.pop(worst)
        table = np.delete(table, worst, 0)


def chain(pairwise: list[tuple[float, float]], reference: int = 0) -> list[tuple[float, float]]:
    """Constants of each form to the reference form, from those of each form to the one before it (one fewer than forms)."""
    n = len(pairwise) + 1
    out = [(1.0, 0.0)] * n
    for k in range(reference + 1, n):  # theta of form k on the scale of k - 1, and on from there
        a, b = pairwise[k - 1]
        pa, pb = out[k - 1]
        out[k] = (pa * a, pa * b + pb)
    for k in range(reference - 1, -1, -1):
        a, b = pairwise[k]
        pa, pb = out[k + 1]
        out[k] = (pa / a, pb - pa * b / a)
    return out


def chain_link(banks: list[DataFrame], reference: int = 0, method: str = "mean_sigma") -> DataFrame:
    """form, slope and shift to the reference form, over common items of neighbouring forms."""
    found = chain([constants(anchors(banks[k - 1], banks[k]), method) for k in range(1, len(banks))], reference)
    return banks[0].sparkSession.createDataFrame([(k, *map(float, c)) for k, c in enumerate(found)], "form int, slope double, shift double")


def longitudinal_drift(banks: list[DataFrame], reference: int = 0, threshold: float = 0.3) -> DataFrame:
    """Items whose difficulty on the reference scale strays by more than the threshold from its mean over forms: item_id, n_forms, n_flagged, largest."""
    found = chain([constants(anchors(banks[k - 1], banks[k])) for k in range(1, len(banks))], reference)
    rows = None
    for k, (bank, (slope, shift)) in enumerate(zip(banks, found, strict=True)):
        part = transform(bank.select("item_id", "a", "b"), slope, shift).select("item_id", "b", F.lit(k).alias("form"))
        rows = part if rows is None else rows.unionByName(part)
    gap = F.abs(F.col("b") - F.avg("b").over(Window.partitionBy("item_id")))
    return rows.withColumn("gap", gap).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_forms"), F.count(F.when(F.col("gap") > threshold, 1)).alias("n_flagged"), F.max("gap").alias("largest"))


# scores


def test_curve(bank: DataFrame, low: float = -6.0, high: float = 6.0, n: int = 241) -> DataFrame:
    """theta, expected score and its variance."""
    grid = bank.sparkSession.range(n).select((F.lit(low) + (high - low) * F.col("id") / (n - 1)).alias("theta"))
    p = irf.p_2pl(F.col("theta"), F.col("a"), F.col("b"))
    return grid.join(F.broadcast(bank)).groupBy("theta").agg(F.sum(p).alias("expected"), F.sum(p * (1 - p)).alias("variance"))


def pieces(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Neighbouring points of a curve: x0, y0, x1, y1. A curve has as many points as a grid."""
    order = Window.partitionBy(F.lit(0)).orderBy(x, y)
    return curve.select(F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1")).where("x1 is not null")


def interpolate(points: DataFrame, at: str, curve: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """y at the points by straight lines between those of the curve, level outside."""
    ends = curve.agg(F.min_by(F.struct(x, y), x).alias("lo"), F.max_by(F.struct(x, y), x).alias("hi"))
    p = pieces(curve, x, y)
    inside = points.join(F.broadcast(p), (F.col(at) >= F.col("x0")) & (F.col(at) < F.col("x1")), "left").join(F.broadcast(ends))
    line = F.col("y0") + (F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    value = F.when(F.col("x0").isNotNull(), line).when(F.col(at) <= F.col(f"lo.{x}"), F.col(f"lo.{y}")).otherwise(F.col(f"hi.{y}"))
    return inside.select(*points.columns, value.alias(out))


def scores_to_theta(bank: DataFrame, scores: DataFrame) -> DataFrame:
    """theta at which the expected score is the score."""
    return interpolate(scores, "score", test_curve(bank), "expected", "theta", "theta")


def theta_to_scores(bank: DataFrame, thetas: DataFrame) -> DataFrame:
    p = irf.p_2pl(F.col("theta"), F.col("a"), F.col("b"))
    return thetas.join(F.broadcast(bank.select("a", "b"))).groupBy("theta").agg(F.sum(p).alias("score"))


def true_score_equating(old: DataFrame, new: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores on the new form to the old form's expected score at the same ability."""
    at = scores_to_theta(new, scores)
    return interpolate(at, "theta", test_curve(old), "theta", "expected", "equated")


def equating_error(old: DataFrame, new: DataFrame) -> DataFrame:
    """theta and the root of both forms' score variances."""
    o, n = test_curve(old, -4, 4, 81), test_curve(new, -4, 4, 81).select("theta", F.col("variance").alias("v"))
    return o.join(n, "theta").select("theta", F.sqrt(F.col("variance") + F.col("v")).alias("see"))


def percentiles(distribution: DataFrame) -> DataFrame:
    """score, p to score and the share below it plus half its own."""
    order = Window.partitionBy(F.lit(0)).orderBy("score")  # as many rows as scores
    total = F.sum("p").over(Window.partitionBy(F.lit(0)))
    return distribution.select("score", ((F.sum("p").over(order) - F.col("p") / 2) / total).alias("rank"))


def equipercentile(old: DataFrame, new: DataFrame) -> DataFrame:
    """From score distributions (score, p): each new score to the old one of the same percentile; old scores of one percentile stand for their mean."""
    o = percentiles(old).groupBy("rank").agg(F.avg("score").alias("old_score"))
    return interpolate(percentiles(new), "rank", o, "rank", "old_score", "equated")


def difficulty_at(bank: DataFrame, p: float = 0.5) -> DataFrame:
    """The ability at which an item is answered with probability p, from a, b and, if they are there, c and d; null out of reach."""
    c = F.col("c") if "c" in bank.columns else F.lit(0.0)
    d = F.col("d") if "d" in bank.columns else F.lit(1.0)
    share = (F.lit(p) - c) / (d - c)
    return bank.select("item_id", F.when((share > 0) & (share < 1), F.col("b") + F.log(share / (1 - share)) / F.col("a")).alias("theta"))


def information_area(bank: DataFrame, low: float = -4.0, high: float = 4.0, n: int = 81) -> DataFrame:
    """By item: the area under its information by trapezoids."""
    grid = bank.sparkSession.range(n).select((F.lit(low) + (high - low) * F.col("id") / (n - 1)).alias("theta"), F.when((F.col("id") == 0) | (F.col("id") == n - 1), 0.5).otherwise(1.0).alias("e"))
    info = irf.information_2pl(F.col("theta"), F.col("a"), F.col("b"))
    return bank.join(F.broadcast(grid)).groupBy("item_id").agg((F.sum(F.col("e") * info) * ((high - low) / (n - 1))).alias("area"))
