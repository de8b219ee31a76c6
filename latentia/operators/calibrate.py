"""Calibration of the two-parameter model by EM over collapsed patterns.

Persons with one pattern are one row with a weight. Each iteration is one pass
over the patterns that adds up expected counts by item and node in NumPy
batches; only those sums (items x nodes) reach the driver, where every item
takes damped Newton steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions.special import normal_quadrature


@dataclass
class Fit:
    items: list[int]
    a: np.ndarray
    b: np.ndarray
    se_a: np.ndarray
    se_b: np.ndarray
    log_likelihood: list[float] = field(default_factory=list)
    converged: bool = False
    n_persons: int = 0

    def bank(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.items, *[x.tolist() for x in (self.a, self.b, self.se_a, self.se_b)], strict=True))
        return spark.createDataFrame(rows, "item_id int, a double, b double, se_a double, se_b double")

    def criteria(self) -> dict[str, float]:
        ll, k, n = self.log_likelihood[-1], 2 * len(self.items), self.n_persons
        aic = -2 * ll + 2 * k
        aicc = aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else float("inf")
        return {"aic": aic, "bic": -2 * ll + k * np.log(n), "sabic": -2 * ll + k * np.log((n + 2) / 24), "aicc": aicc, "caic": -2 * ll + k * (np.log(n) + 1)}


def weighted_patterns(responses: DataFrame) -> DataFrame:
    r = responses.where("resp is not null")
    p = r.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "resp"))).alias("p"))
    return p.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.col("p.item_id").alias("items"), F.col("p.resp").alias("resps"), "n")


def expected_counts(patterns: DataFrame, items: list[int], a: np.ndarray, b: np.ndarray, nodes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected trials and successes by item and node, and the log-likelihood."""
    spark = patterns.sparkSession
    at = {k: i for i, k in enumerate(items)}
    z = np.clip(a[:, None] * (nodes[None] - b[:, None]), -30, 30)
    held = spark.sparkContext.broadcast((at, -np.logaddexp(0, -z), -np.logaddexp(0, z), np.log(weights)))
    j, q = len(items), len(nodes)

    def run(batches):
        at, lp, lq, lw = held.value
        trials, right, ll = np.zeros((j, q)), np.zeros((j, q)), 0.0
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            x = np.full((len(n), j), -1, np.int8)
            sizes = np.diff(batch.column("items").offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), sizes)
            col = np.array([at[k] for k in batch.column("items").flatten().to_pylist()], int)
            x[row, col] = batch.column("resps").flatten().to_numpy()
            one, zero = (x == 1).astype(float), (x == 0).astype(float)
            like = one @ lp + zero @ lq + lw
            top = like.max(1, keepdims=True)
            post = np.exp(like - top)
            total = post.sum(1, keepdims=True)
            ll += float((n[:, None] * (np.log(total) + top)).sum())
            post *= n[:, None] / total
            right += one.T @ post
            trials += (one + zero).T @ post
        yield pa.RecordBatch.from_pydict({"t": pa.array([trials.tobytes()], pa.binary()), "r": pa.array([right.tobytes()], pa.binary()), "ll": pa.array([ll])})

    got = patterns.mapInArrow(run, "t binary, r binary, ll double").collect()
    t = sum(np.frombuffer(r["t"]).reshape(j, q) for r in got)
    s = sum(np.frombuffer(r["r"]).reshape(j, q) for r in got)
    return t, s, sum(r["ll"] for r in got)


def newton(trials: np.ndarray, right: np.ndarray, nodes: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 8, low: float = 0.05, high: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression of each item on the nodes, as slope and intercept; the last information matrices too."""
    slope, inter = a.copy(), -a * b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope[:, None] * nodes + inter[:, None], -30, 30)))
        d, v = right - trials * p, trials * p * (1 - p) + 1e-12
        g0, g1 = d.sum(1), (d * nodes).sum(1)
        h00, h01, h11 = v.sum(1), (v * nodes).sum(1), (v * nodes * nodes).sum(1)
        det = h00 * h11 - h01 * h01 + 1e-9
        inter = inter + np.clip((h11 * g0 - h01 * g1) / det, -1, 1)
        slope = np.clip(slope + np.clip((h00 * g1 - h01 * g0) / det, -1, 1), low, high)
    info = np.stack([h00, h01, h11], 1)
    return slope, -inter / slope, info


def fit_2pl(responses: DataFrame, n_nodes: int = 21, max_iter: int = 500, tol: float = 1e-4) -> Fit:
    patterns = weighted_patterns(responses).persist()
    try:
        items = sorted(r[0] for r in responses.where("resp is not null").select("item_id").distinct().collect())
        n_persons = patterns.agg(F.sum("n")).first()[0] or 0
        nodes, weights = normal_quadrature(n_nodes)
        a, b = np.ones(len(items)), np.zeros(len(items))
        history: list[float] = []
        done = False
        for _ in range(max_iter):
            t, r, ll = expected_counts(patterns, items, a, b, nodes, weights)
            done = bool(history) and abs(ll - history[-1]) < tol * max(1.0, abs(ll) * 1e-4)
            history.append(ll)
            a, b, info = newton(t, r, nodes, a, b)
            if done:
                break
        det = np.maximum(info[:, 0] * info[:, 2] - info[:, 1] ** 2, 1e-12)
        se_a = np.sqrt(info[:, 0] / det)
        grad = np.stack([b / a, 1 / a], 1)  # of b = -intercept / slope, by slope and intercept, up to sign
        se_b = np.sqrt(np.maximum(grad[:, 0] ** 2 * info[:, 0] / det - 2 * grad[:, 0] * grad[:, 1] * info[:, 1] / det + grad[:, 1] ** 2 * info[:, 2] / det, 0))
        return Fit(items, a, b, se_a, se_b, history, done, int(n_persons))
    finally:
        patterns.unpersist()
