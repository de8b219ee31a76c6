"""Knowledge tracing over whole sequences: smoothed mastery, the most likely path, and sampled paths.

A sequence is a person's trials of a skill in order; sequences are independent, so they are rows of arrays and
batches of them are worked through together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequences(trials: DataFrame) -> DataFrame:
    """person_id, skill, answers: in order of ts and event_id."""
    return trials.groupBy("person_id", "skill").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "resp"))).alias("t")).select("person_id", "skill", F.col("t.resp").alias("answers"))


def forward(x: list[int], start: float, learn: float, forget: float, slip: float, guess: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Filtered states [trial, (unmastered, mastered)], transitions, and the log-likelihood."""
    move = np.array([[1 - learn, learn], [forget, 1 - forget]])
    seen = np.array([[1 - guess, guess], [slip, 1 - slip]])  # by state, wrong and right
    out, state, ll = np.zeros((len(x), 2)), np.array([1 - start, start]), 0.0
    for t, v in enumerate(x):
        if t:
            state = state @ move
        state = state * seen[:, v]
        total = state.sum()
        ll += float(np.log(total))
        state = state / total
        out[t] = state
    return out, move, ll


def smoothed(x: list[int], **p) -> np.ndarray:
    """The chance of mastery at each trial, given all trials."""
    f, move, _ = forward(x, **p)
    out = f.copy()
    for t in range(len(x) - 2, -1, -1):
        ahead = f[t] @ move
        out[t] = f[t] * (move @ (out[t + 1] / np.maximum(ahead, 1e-300)))
    return out[:, 1]


def most_likely(x: list[int], start: float, learn: float, forget: float, slip: float, guess: float) -> list[int]:
    """The path of states of the highest joint probability; of equal ones the unmastered."""
    log = lambda v: np.log(np.maximum(v, 1e-300))
    move = log(np.array([[1 - learn, learn], [forget, 1 - forget]]))
    seen = log(np.array([[1 - guess, guess], [slip, 1 - slip]]))
    best = log(np.array([1 - start, start])) + seen[:, x[0]]
    back = []
    for v in x[1:]:
        step = best[:, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + seen[:, v]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def sampled(x: list[int], rng: np.random.Generator, **p) -> list[int]:
    """A path drawn from the posterior: forwards filtered, backwards drawn."""
    f, move, _ = forward(x, **p)
    path = [int(rng.random() < f[-1, 1])]
    for t in range(len(x) - 2, -1, -1):
        w = f[t] * move[:, path[-1]]
        path.append(int(rng.random() < w[1] / w.sum()))
    return path[::-1]


def trace_back(seqs: DataFrame, start: float = 0.3, learn: float = 0.2, forget: float = 0.02, slip: float = 0.1, guess: float = 0.2) -> DataFrame:
    """person_id, skill, log_likelihood, mastery (smoothed, by trial) and path (most likely states)."""
    kinds = dict(seqs.dtypes)
    p = {"start": start, "learn": learn, "forget": forget, "slip": slip, "guess": guess}

    def run(batches):
        for batch in batches:
            xs = batch.column("answers").to_pylist()
            yield pa.RecordBatch.from_pydict({"person_id": batch.column("person_id"), "skill": batch.column("skill"), "log_likelihood": pa.array([forward(x, **p)[2] for x in xs], pa.float64()), "mastery": pa.array([smoothed(x, **p).tolist() for x in xs], pa.list_(pa.float64())), "path": pa.array([most_likely(x, **p) for x in xs], pa.list_(pa.int32()))})

    return seqs.select("person_id", "skill", "answers").mapInArrow(run, f"person_id {kinds['person_id']}, skill {kinds['skill']}, log_likelihood double, mastery array<double>, path array<int>")


def growth(persons: DataFrame, times: DataFrame, change: float | None = None) -> DataFrame:
    """theta by person and time: intercept, slope and curvature of each person, and an extra slope after the time of change."""
    t = F.col("time")
    value = F.col("intercept") + F.col("slope") * t + F.col("curve") * t * t
    if change is not None:
        value = value + F.col("extra") * F.greatest(t - change, F.lit(0.0))
    return persons.join(F.broadcast(times)).select("person_id", "time", value.alias("theta"))
