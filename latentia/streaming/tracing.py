"""Bayesian knowledge tracing: the forward filter of a two-state chain for each person and skill.

In batch it is a fold over the trials in order, as array expressions; on a
stream the state is the probability of mastery, kept by person and skill.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tracing:
    start: float = 0.3
    learn: float = 0.2
    forget: float = 0.02
    slip: float = 0.1
    guess: float = 0.25

    def step(self, known: float, right: int) -> float:
        """Mastery after a trial's answer, then the change of state."""
        up, down = (1 - self.slip, self.guess) if right else (self.slip, 1 - self.guess)
        after = known * up / (known * up + (1 - known) * down)
        return after * (1 - self.forget) + (1 - after) * self.learn


def trace(trials: DataFrame, model: Tracing = Tracing()) -> DataFrame:
    """person_id, skill, n, mastery after the last trial."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "resp")))

    def fold(known, t):
        up = F.when(t["resp"] == 1, 1 - model.slip).otherwise(model.slip)
        down = F.when(t["resp"] == 1, model.guess).otherwise(1 - model.guess)
        after = known * up / (known * up + (1 - known) * down)
        return after * (1 - model.forget) + (1 - after) * model.learn

    g = trials.groupBy("person_id", "skill").agg(ordered.alias("t"))
    return g.select("person_id", "skill", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(model.start), fold).alias("mastery"))


def trace_stream(trials: DataFrame, model: Tracing = Tracing()) -> DataFrame:
    """The same on a stream: a row for each key and micro-batch."""

    def update(key, frames, state):
        known, n = state.get if state.exists else (model.start, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for right in rows["resp"]:
            known, n = model.step(known, int(right)), n + 1
        state.update((known, n))
        yield pd.DataFrame({"person_id": [key[0]], "skill": [key[1]], "n": [n], "mastery": [known]})

    return trials.groupBy("person_id", "skill").applyInPandasWithState(update, "person_id long, skill string, n long, mastery double", "known double, n long", "update", "NoTimeout")
