"""Calibration of several item models by EM over collapsed patterns.

A pass over the patterns adds up expected answers by item, category and node in
NumPy batches; only those sums reach the driver, where each item's parameters
take damped Newton steps on the expected log-likelihood, priors included. The
sums have items x categories x nodes entries, so the number of items is bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions.special import normal_quadrature
from latentia.operators.calibrate import weighted_patterns

#: Most items of a calibration.
MAX_ITEMS = 20_000
#: Patterns with fewer answers than this in all are passed over on the driver, which gives the same sums without a job for each step.
FEW_ANSWERS = 1_000_000


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def share(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(0))
    return e / e.sum(0)


@dataclass(frozen=True)
class ItemModel:
    """curve: probabilities [category, node] from parameters on the whole line; start: parameters from the share of each category; values: what they mean."""

    name: str
    curve: Callable[[np.ndarray, np.ndarray], np.ndarray]
    start: Callable[[np.ndarray], np.ndarray]
    values: Callable[[np.ndarray], dict[str, float]]
    log_prior: Callable[[np.ndarray], float] = lambda p: 0.0


def two(p: np.ndarray) -> np.ndarray:
    return np.stack([1 - p, p])


def first_b(shares: np.ndarray) -> float:
    right = float(np.clip(shares[1:].sum(), 0.02, 0.98))
    return float(np.log((1 - right) / right))


def upper_shares(shares: np.ndarray) -> np.ndarray:
    above = np.clip(1 - np.cumsum(shares)[:-1], 0.01, 0.99)
    return np.sort(np.log((1 - above) / above))


def graded(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    b = np.cumsum(np.r_[p[1], np.exp(p[2:])])  # rising thresholds
    above = logistic(np.exp(p[0]) * (t[None] - b[:, None]))
    return np.clip(-np.diff(np.vstack([np.ones_like(t), above, np.zeros_like(t)]), axis=0), 1e-10, 1)


def partial_credit(slope: float, steps: np.ndarray, t: np.ndarray) -> np.ndarray:
    return share(np.vstack([np.zeros_like(t), np.cumsum(slope * (t[None] - steps[:, None]), axis=0)]))


def named(prefix: str, values: np.ndarray) -> dict[str, float]:
    return {f"{prefix}{k}": float(v) for k, v in enumerate(values, 1)}


def graded_start(s: np.ndarray) -> np.ndarray:
    b = upper_shares(s)
    return np.r_[0.0, b[:1], np.log(np.maximum(np.diff(b), 0.05))]


def nominal(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    k = len(p) // 2
    return share(np.vstack([np.zeros_like(t), p[:k, None] * t[None] + p[k:, None]]))


MODELS = {
    m.name: m
    for m in (
        ItemModel("1PL", lambda p, t: two(logistic(t - p[0])), lambda s: np.array([first_b(s)]), lambda p: {"a": 1.0, "b": float(p[0])}),
        ItemModel("2PL", lambda p, t: two(logistic(np.exp(p[0]) * (t - p[1]))), lambda s: np.array([0.0, first_b(s)]), lambda p: {"a": float(np.exp(p[0])), "b": float(p[1])}, lambda p: -0.5 * (p[0] / 2) ** 2 - 0.5 * (p[1] / 20) ** 2),
        # the lower asymptote has a prior around 0.2, as data alone hardly tell it
        ItemModel("3PL", lambda p, t: two(logistic(p[2]) + (1 - logistic(p[2])) * logistic(np.exp(p[0]) * (t - p[1]))), lambda s: np.array([0.0, first_b(s), -1.4]), lambda p: {"a": float(np.exp(p[0])), "b": float(p[1]), "c": float(logistic(p[2]))}, lambda p: -0.5 * p[0] ** 2 - 0.5 * (p[1] / 5) ** 2 - 0.5 * ((p[2] + 1.4) / 0.5) ** 2),
        ItemModel("GRM", graded, graded_start, lambda p: {"a": float(np.exp(p[0]))} | named("b", np.cumsum(np.r_[p[1], np.exp(p[2:])])), lambda p: -0.5 * (p[0] / 2) ** 2 - 0.5 * (p[1] / 20) ** 2),
        ItemModel("GPCM", lambda p, t: partial_credit(float(np.exp(p[0])), p[1:], t), lambda s: np.r_[0.0, np.log(np.maximum(s[:-1], 0.01) / np.maximum(s[1:], 0.01))], lambda p: {"a": float(np.exp(p[0]))} | named("b", p[1:]), lambda p: -0.5 * (p[0] / 2) ** 2 - 0.5 * ((p[1:] / 20) ** 2).sum()),
        ItemModel("PCM", lambda p, t: partial_credit(1.0, p, t), lambda s: np.log(np.maximum(s[:-1], 0.01) / np.maximum(s[1:], 0.01)), lambda p: {"a": 1.0} | named("b", p), lambda p: -0.5 * ((p / 20) ** 2).sum()),
        ItemModel("NRM", nominal, lambda s: np.r_[np.arange(1, len(s)) * 0.5, np.log(np.maximum(s[1:], 0.01) / max(s[0], 0.01))], lambda p: named("slope", p[: len(p) // 2]) | named("intercept", p[len(p) // 2 :]), lambda p: -0.5 * ((p / 10) ** 2).sum()),
    )
}


def at_hand(patterns: DataFrame, tables: int = 1) -> DataFrame | pa.Table:
    """The patterns as a table of the driver where a count shows them few, else as they are; one of several such tables may have its share only."""
    answers = patterns.agg(F.coalesce(F.sum(F.size("items") + 1), F.lit(0))).first()[0]
    return patterns.select("items", "resps", "n").toArrow() if answers < FEW_ANSWERS / tables else patterns


def expected_counts(patterns: DataFrame | pa.Table, items: list[int], log_p: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected answers [item, category, node] and the log-likelihood. log_p: for each item [category, node]; patterns: items, resps, n."""
    j, k, q = len(items), max(x.shape[0] for x in log_p), len(weights)
    table = np.zeros((j, k, q))
    for i, x in enumerate(log_p):
        table[i, : x.shape[0]] = x
    given = ({v: i for i, v in enumerate(items)}, table, np.log(np.maximum(weights, 1e-300)))
    held = None if isinstance(patterns, pa.Table) else patterns.sparkSession.sparkContext.broadcast(given)

    def run(batches):
        at, table, lw = given if held is None else held.value
        counts, ll = np.zeros((j, k, q)), 0.0
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            x = np.full((len(n), j), -1, np.int32)
            sizes = np.diff(batch.column("items").offsets.to_numpy())
            x[np.repeat(np.arange(len(n)), sizes), np.array([at[v] for v in batch.column("items").flatten().to_pylist()], int)] = batch.column("resps").flatten().to_numpy()
            hits = [(x == c).astype(float) for c in range(k)]
            like = sum(h @ table[:, c] for c, h in enumerate(hits)) + lw
            top = like.max(1, keepdims=True)
            post = np.exp(like - top)
            total = post.sum(1, keepdims=True)
            ll += float((n[:, None] * (np.log(total) + top)).sum())
            post *= n[:, None] / total
            for c, h in enumerate(hits):
                counts[:, c] += h.T @ post
        yield pa.RecordBatch.from_pydict({"c": pa.array([counts.tobytes()], pa.binary()), "ll": pa.array([ll])})

    if held is None:
        got = [row for batch in run(patterns.to_batches(max_chunksize=2_000)) for row in batch.to_pylist()]
    else:
        given = None  # workers take the broadcast
        got = patterns.mapInArrow(run, "c binary, ll double").collect()  # one row a partition
    return sum((np.frombuffer(r["c"]).reshape(j, k, q) for r in got), np.zeros((j, k, q))), sum(r["ll"] for r in got)


def climb(f: Callable[[np.ndarray], float], p: np.ndarray, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Damped Newton steps upwards with finite differences; the last negative Hessian too."""
    n, h = len(p), 1e-4
    eye = np.eye(n) * h
    best = f(p)
    for _ in range(steps):
        up, down = np.array([f(p + e) for e in eye]), np.array([f(p - e) for e in eye])
        grad, hess = (up - down) / (2 * h), np.diag((up - 2 * best + down) / h**2)
        for a in range(n):
            for b in range(a):
                hess[a, b] = hess[b, a] = (f(p + eye[a] + eye[b]) - up[a] - up[b] + 2 * best - down[a] - down[b] + f(p - eye[a] - eye[b])) / (2 * h * h)
        values, vectors = np.linalg.eigh(-hess)
        move = vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-3))
        move = np.clip(move, -1, 1)
        rate = 1.0
        while rate > 1e-4 and (now := f(p + rate * move)) < best - 1e-12:
            rate /= 2
        if rate <= 1e-4:
            break
        p, gain, best = p + rate * move, now - best, now
        if gain < 1e-9:
            break
    return p, -hess


@dataclass
class Fit:
    model: str
    items: list[int]
    parameters: list[np.ndarray]
    errors: list[np.ndarray]
    log_likelihood: list[float] = field(default_factory=list)
    converged: bool = False

    @property
    def n_parameters(self) -> int:
        return sum(map(len, self.parameters))

    def table(self, spark: SparkSession) -> DataFrame:
        """item_id, parameter, value."""
        rows = [(i, k, v) for i, p in zip(self.items, self.parameters, strict=True) for k, v in MODELS[self.model].values(p).items()]
        return spark.createDataFrame(rows, "item_id int, parameter string, value double")


def fit(responses: DataFrame, model: str = "2PL", n_nodes: int = 21, max_iter: int = 500, tol: float = 1e-4) -> Fit:
    """Parameters of every item under 1PL, 2PL, 3PL, GRM, GPCM, PCM or NRM, abilities standard normal. Categories count from 0; an item's number of them is its highest plus one."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}; known are {', '.join(MODELS)}")
    kind = MODELS[model]
    patterns = weighted_patterns(responses).persist()
    try:
        counts = responses.where("resp is not null").groupBy("item_id", "resp").agg(F.count(F.lit(1)).alias("n"))
        n_items = counts.select("item_id").distinct().limit(MAX_ITEMS + 1).count()
        if n_items > MAX_ITEMS:
            raise ValueError(f"more than {MAX_ITEMS} items")
        seen: dict[int, dict[int, int]] = {}
        for r in counts.collect():
            seen.setdefault(r["item_id"], {})[r["resp"]] = r["n"]
        items = sorted(seen)
        binary = model in ("1PL", "2PL", "3PL")
        params = []
        for i in items:
            if binary and max(seen[i]) > 1:
                raise ValueError(f"item {i} has more than two categories")
            s = np.array([seen[i].get(c, 0) for c in range(2 if binary else max(max(seen[i]), 1) + 1)], float)
            params.append(kind.start(s / s.sum()))
        nodes, weights = normal_quadrature(n_nodes)
        answered = at_hand(patterns)
        history: list[float] = []
        done, infos = False, []
        for _ in range(max_iter):
            log_p = [np.log(np.clip(kind.curve(p, nodes), 1e-300, 1)) for p in params]
            expected, ll = expected_counts(answered, items, log_p, weights)
            done = bool(history) and abs(ll - history[-1]) < tol * max(1.0, abs(ll) * 1e-4)
            history.append(ll)
            if done:
                break
            infos, after = [], []
            for p, e, lp in zip(params, expected, log_p, strict=True):
                e = e[: lp.shape[0]]
                target = lambda v, e=e: float((e * np.log(np.clip(kind.curve(v, nodes), 1e-300, 1))).sum()) + kind.log_prior(v)
                p, info = climb(target, p)
                after.append(p)
                infos.append(info)
            params = after
        errors = [np.sqrt(np.maximum(np.diag(np.linalg.pinv(i)), 0)) for i in infos] or [np.zeros(len(p)) for p in params]
        return Fit(model, items, params, errors, history, done)
    finally:
        patterns.unpersist()


def compare(responses: DataFrame, models: list[str], **options) -> DataFrame:
    """model, log_likelihood, n_parameters and criteria of several models on the same answers."""
    n = responses.select("person_id").distinct().count()
    rows = []
    for m in models:
        f = fit(responses, m, **options)
        ll, k = f.log_likelihood[-1], f.n_parameters
        rows.append((m, float(ll), k, float(2 * k - 2 * ll), float(k * np.log(n) - 2 * ll)))
    return responses.sparkSession.createDataFrame(rows, "model string, log_likelihood double, n_parameters int, aic double, bic double")
