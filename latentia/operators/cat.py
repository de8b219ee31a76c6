"""Adaptive testing: a session with choice, stopping, exposure and content rules, and simulated sessions over a cluster.

A session's state is small and holds no bank, so it can be kept between answers; the bank is arrays of a and b.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GRID = np.linspace(-4, 4, 81)
PRIOR = np.exp(-0.5 * GRID**2) / np.exp(-0.5 * GRID**2).sum()
#: Most items of a bank that goes to every task.
MAX_BANK = 200_000


def curve(theta, a, b):
    return 1 / (1 + np.exp(-np.clip(a * (theta - b), -35, 35)))


@dataclass
class Bank:
    item_id: np.ndarray
    a: np.ndarray
    b: np.ndarray
    area: np.ndarray | None = None

    @classmethod
    def of(cls, bank: DataFrame) -> Bank:
        cols = ["item_id", "a", "b"] + (["area"] if "area" in bank.columns else [])
        rows = bank.select(*cols).orderBy("item_id").limit(MAX_BANK + 1).collect()
        if len(rows) > MAX_BANK:
            raise ValueError(f"more than {MAX_BANK} items")
        column = lambda k: np.array([r[k] for r in rows])
        return cls(column(0), column(1).astype(float), column(2).astype(float), column(3) if len(cols) > 3 else None)

    def information(self, theta: float) -> np.ndarray:
        p = curve(theta, self.a, self.b)
        return self.a**2 * p * (1 - p)


@dataclass
class State:
    """What a session knows: places of the items given, the answers, and the posterior's mean and deviation after each."""

    given: list[int] = field(default_factory=list)
    answers: list[int] = field(default_factory=list)
    theta: float = 0.0
    se: float = 1.0
    track: list[float] = field(default_factory=list)

    def posterior(self, bank: Bank) -> np.ndarray:
        a, b, x = bank.a[self.given], bank.b[self.given], np.array(self.answers)
        p = curve(GRID[:, None], a, b)
        ll = np.log(PRIOR) + np.log(np.clip(np.where(x == 1, p, 1 - p), 1e-300, 1)).sum(1)
        w = np.exp(ll - ll.max())
        return w / w.sum()

    def record(self, bank: Bank, item: int, answer: int) -> None:
        self.given.append(item)
        self.answers.append(int(answer))
        w = self.posterior(bank)
        self.track.append(self.theta)
        self.theta = float((w * GRID).sum())
        self.se = float(np.sqrt((w * (GRID - self.theta) ** 2).sum()))


Selection = Callable[[Bank, State, np.ndarray, np.random.Generator], np.ndarray]

# choice: a value for each open item, the highest is given


def max_information(bank: Bank, s: State, open_items: np.ndarray, rng) -> np.ndarray:
    return bank.information(s.theta)[open_items]


def expected_information(bank: Bank, s: State, open_items: np.ndarray, rng) -> np.ndarray:
    """Information averaged over the posterior."""
    w = s.posterior(bank)
    p = curve(GRID[:, None], bank.a[open_items], bank.b[open_items])
    return w @ (bank.a[open_items] ** 2 * p * (1 - p))


def kullback_leibler(bank: Bank, s: State, open_items: np.ndarray, rng) -> np.ndarray:
    """Divergence from the present ability's curve, averaged over the posterior."""
    w = s.posterior(bank)
    p = np.clip(curve(GRID[:, None], bank.a[open_items], bank.b[open_items]), 1e-12, 1 - 1e-12)
    p0 = np.clip(curve(s.theta, bank.a[open_items], bank.b[open_items]), 1e-12, 1 - 1e-12)
    return w @ (p0 * np.log(p0 / p) + (1 - p0) * np.log((1 - p0) / (1 - p)))


def nearest_difficulty(bank: Bank, s: State, open_items: np.ndarray, rng) -> np.ndarray:
    return -np.abs(bank.b[open_items] - s.theta)


def at_random(bank: Bank, s: State, open_items: np.ndarray, rng) -> np.ndarray:
    return rng.random(len(open_items))


def stratified(n_strata: int, length: int) -> Selection:
    """Items in strata of rising slope; early in the test the low ones, by nearest difficulty."""

    def rule(bank: Bank, s: State, open_items: np.ndarray, rng) -> np.ndarray:
        stratum = np.argsort(np.argsort(bank.a, kind="stable"), kind="stable") * n_strata // len(bank.a)
        now = min(len(s.given) * n_strata // max(length, 1), n_strata - 1)
        here = stratum[open_items] == now
        return np.where(here | ~here.any(), 0.0, -1e6) - np.abs(bank.b[open_items] - s.theta)

    return rule


SELECTION: dict[str, Selection] = {"max_information": max_information, "expected_information": expected_information, "kullback_leibler": kullback_leibler, "nearest_difficulty": nearest_difficulty, "random": at_random}

# stopping

Stop = Callable[[State], bool]


def stop_at_error(se: float) -> Stop:
    return lambda s: bool(s.given) and s.se <= se


def stop_at_length(n: int) -> Stop:
    return lambda s: len(s.given) >= n


def stop_when_settled(change: float, least: int = 3) -> Stop:
    return lambda s: len(s.given) >= least and abs(s.theta - s.track[-1]) < change


def stop_when_classified(cut: float, z: float = 1.96) -> Stop:
    return lambda s: bool(s.given) and abs(s.theta - cut) > z * s.se


def not_before(n: int, rule: Stop) -> Stop:
    return lambda s: len(s.given) >= n and rule(s)


def any_of(*rules: Stop) -> Stop:
    return lambda s: any(r(s) for r in rules)


def all_of(*rules: Stop) -> Stop:
    return lambda s: all(r(s) for r in rules)


# exposure: picks from open items and their values

Exposure = Callable[[np.ndarray, np.ndarray, State, np.random.Generator], int]


def best(open_items: np.ndarray, values: np.ndarray, s: State, rng) -> int:
    return int(open_items[np.argmax(values)])


def one_of_best(n: int) -> Exposure:
    return lambda items, values, s, rng: int(rng.choice(items[np.argsort(-values, kind="stable")[:n]]))


def with_probability(chance: np.ndarray) -> Exposure:
    """Items in order of value, each passed over unless its own chance (by place in the bank) lets it through."""

    def rule(items, values, s, rng):
        order = items[np.argsort(-values, kind="stable")]
        through = order[rng.random(len(order)) < chance[order]]
        return int(through[0] if len(through) else order[-1])

    return rule


def progressive(length: int) -> Exposure:
    """A random part that shrinks as the test goes on."""

    def rule(items, values, s, rng):
        w = min(len(s.given) / max(length, 1), 1.0)
        return int(items[np.argmax(w * values + (1 - w) * rng.random(len(items)) * max(values.max(), 1e-12))])

    return rule


# content: which open items may be given

Content = Callable[[Bank, State, np.ndarray], np.ndarray]


def any_content(bank: Bank, s: State, open_items: np.ndarray) -> np.ndarray:
    return open_items


def blueprint(shares: dict) -> Content:
    """Items of the content area that lags furthest behind its share of the test so far."""

    def rule(bank: Bank, s: State, open_items: np.ndarray) -> np.ndarray:
        given = bank.area[s.given] if s.given else np.array([])
        lag = {k: v * (len(s.given) + 1) - float((given == k).sum()) for k, v in shares.items() if (bank.area[open_items] == k).any()}
        return open_items[bank.area[open_items] == max(lag, key=lag.get)] if lag else open_items

    return rule


def at_most(limits: dict) -> Content:
    """No more items of an area than its limit."""

    def rule(bank: Bank, s: State, open_items: np.ndarray) -> np.ndarray:
        full = [k for k, n in limits.items() if s.given and int((bank.area[s.given] == k).sum()) >= n]
        return open_items[~np.isin(bank.area[open_items], full)]

    return rule


@dataclass
class Session:
    bank: Bank
    selection: Selection = max_information
    stop: Stop = field(default_factory=lambda: any_of(stop_at_error(0.35), stop_at_length(15)))
    exposure: Exposure = best
    content: Content = any_content
    seed: int = 0
    state: State = field(default_factory=State)

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)

    def next_item(self) -> int | None:
        """The place of the next item in the bank; nothing when the test is over."""
        if self.stop(self.state):
            return None
        used = np.zeros(len(self.bank.a), bool)
        used[self.state.given] = True
        open_items = self.content(self.bank, self.state, np.flatnonzero(~used))
        if not len(open_items):
            return None
        return self.exposure(open_items, self.selection(self.bank, self.state, open_items, self.rng), self.state, self.rng)

    def answer(self, item: int, resp: int) -> None:
        if item in self.state.given:
            raise ValueError(f"item {item} has been given")
        self.state.record(self.bank, item, resp)


def simulate(persons: DataFrame, bank: DataFrame, seed: int = 0, **rules) -> DataFrame:
    """A session for each person (person_id, theta): estimate, se, number of items, and the items and answers in order. Draws hang on the person and the seed alone."""
    held = persons.sparkSession.sparkContext.broadcast(Bank.of(bank))

    def run(batches):
        for batch in batches:
            out = []
            for person, theta in zip(batch.column("person_id").to_pylist(), batch.column("theta").to_pylist(), strict=True):
                s = Session(held.value, seed=(int(person) * 1_000_003 + seed) & (2**63 - 1), **rules)
                draws = np.random.default_rng([int(person) & 0xFFFFFFFF, seed & 0xFFFFFFFF, 1])
                while (item := s.next_item()) is not None:
                    s.answer(item, int(draws.random() < curve(theta, held.value.a[item], held.value.b[item])))
                out.append((s.state.theta, s.state.se, len(s.state.given), [int(held.value.item_id[i]) for i in s.state.given], s.state.answers))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"person_id": batch.column("person_id"), "true_theta": batch.column("theta")} | {n: pa.array(list(c), k) for n, c, k in zip(("theta", "se", "n_items", "items", "answers"), cols, kinds, strict=True)})

    return persons.select("person_id", "theta").mapInArrow(run, "person_id long, true_theta double, theta double, se double, n_items int, items array<int>, answers array<int>")


def conditional_error(sessions: DataFrame) -> DataFrame:
    """By true ability: bias, mean squared error and mean length."""
    from pyspark.sql import functions as F

    d = F.col("theta") - F.col("true_theta")
    return sessions.groupBy("true_theta").agg(F.avg(d).alias("bias"), F.avg(d * d).alias("mse"), F.avg("n_items").alias("n_items"), F.count(F.lit(1)).alias("n"))


def exposure_rates(sessions: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    n = sessions.agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).select("item_id", (F.col("k") / F.col("n")).alias("rate"))
