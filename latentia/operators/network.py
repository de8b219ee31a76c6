"""Networks of items: the Ising model by pseudo-likelihood.

Each answer is logistic in all others, with one symmetric matrix of weights.
Accelerated proximal steps need only the items x items gradient of a pass, so
nothing that grows with the persons reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.operators.calibrate import weighted_patterns
from latentia.operators.models import at_hand

MAX_NODES = 500


def fit_ising(responses: DataFrame, penalty: float = 0.0, max_iter: int = 2000, tol: float = 1e-7) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Items, thresholds and symmetric weights [item, item]. Persons who have not answered every item are left out; penalty: on the weights' absolute values, per person."""
    items = sorted(r[0] for r in responses.where("resp is not null").select("item_id").distinct().limit(MAX_NODES + 1).collect())
    if len(items) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} items")
    j = len(items)
    patterns = weighted_patterns(responses).where(F.size("items") == j).persist()

    def passed(source, work) -> np.ndarray:
        """The sum over patterns (one a row, weights n) of a matrix that work gives for a batch."""

        def run(batches):
            total = np.zeros((j, j + 1))
            for b in batches:
                x = b.column("resps").flatten().to_numpy().reshape(-1, j).astype(float)
                total += work(x, b.column("n").to_numpy().astype(float))
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

        if isinstance(source, pa.Table):
            got = [m for b in run(source.to_batches(max_chunksize=10_000)) for m in b.column("m").to_pylist()]
        else:
            got = [r["m"] for r in source.mapInArrow(run, "m binary").collect()]
        return sum((np.frombuffer(m).reshape(j, j + 1) for m in got), np.zeros((j, j + 1)))

    try:
        source = at_hand(patterns)
        moments = passed(source, lambda x, n: np.hstack([x.T @ (n[:, None] * x), (n @ x)[:, None]]))
        n = float(patterns.agg(F.sum("n")).first()[0] or 0)
        if not n:
            return items, np.zeros(j), np.zeros((j, j))
        second = np.block([[moments[:, :j] / n, moments[:, j:] / n], [moments[:, j:].T / n, np.ones((1, 1))]])
        rate = 4 / max(np.linalg.eigvalsh(second).max(), 1e-9)
        off = 1 - np.eye(j)
        v = look = np.zeros((j, j + 1))
        t = 1.0
        for _ in range(max_iter):
            w, h = look[:, :j], look[:, j]

            def slope(x, n, w=w, h=h):
                rest = (x - 1 / (1 + np.exp(-np.clip(x @ w + h, -35, 35)))) * n[:, None]
                return np.hstack([rest.T @ x, rest.sum(0)[:, None]])

            g = passed(source, slope) / n
            step = w + rate * (g[:, :j] + g[:, :j].T) * off / 2
            new = np.hstack([np.sign(step) * np.maximum(np.abs(step) - rate * penalty / 2, 0), (h + rate * g[:, j])[:, None]])
            if np.abs(new - look).max() < tol:
                v = new
                break
            if float(((look - new) * (new - v)).sum()) > 0:  # momentum points the wrong way
                t = 1.0
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look, v, t = new + (t - 1) / after * (new - v), new, after
        return items, v[:, j], v[:, :j]
    finally:
        patterns.unpersist()


def ising_edges(responses: DataFrame, **options) -> DataFrame:
    """item_a, item_b, weight of every pair; item_a = item_b: the threshold."""
    items, h, w = fit_ising(responses, **options)
    rows = [(a, b, float(h[i] if i == k else w[i, k])) for i, a in enumerate(items) for k, b in enumerate(items) if i <= k]
    return responses.sparkSession.createDataFrame(rows, "item_a int, item_b int, weight double")


def compare_networks(one: DataFrame, other: DataFrame, **options) -> DataFrame:
    """item_a, item_b, weight and other_weight, difference, for two sets of responses to the same items."""
    other_edges = ising_edges(other, **options).withColumnRenamed("weight", "other_weight")
    return ising_edges(one, **options).join(other_edges, ["item_a", "item_b"]).withColumn("difference", F.col("weight") - F.col("other_weight"))
