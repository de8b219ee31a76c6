"""Calibration over other latent spaces than one normal ability.

Groups of persons with their own ability distributions and invariance between
them, mixtures of classes with their own item parameters, several traits,
profiles of mastered attributes. Each space is a finite set of points, so one
pass over the collapsed patterns gives the expected answers at every point;
the passes are those of `models`, and only their sums reach the driver.

Persons without any answer add nothing to a fit and are scored by the weights
of the points alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions.special import chi2_sf, normal_quadrature
from latentia.operators.calibrate import weighted_patterns
from latentia.operators.models import MAX_ITEMS, MODELS, at_hand, climb, expected_counts, logistic, two

#: An item that everyone answers alike, at every point: its counts are the mass of the points.
MASS = -(2**31)
MAX_GROUPS = 200
#: Most points of a latent space; a batch holds a number for each pattern and point.
MAX_POINTS = 4_096
LEVELS = ("configural", "metric", "scalar")


def with_mass(patterns: DataFrame) -> DataFrame:
    """Patterns in which everyone has given the answer 0 to the item MASS as well."""
    return patterns.select(F.concat(F.array(F.lit(MASS)), "items").alias("items"), F.concat(F.array(F.lit(0)), "resps").alias("resps"), "n")


def sums(patterns: DataFrame | pa.Table, items: list[int], log_p: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected answers [item, category, point], mass [point], log-likelihood."""
    counts, ll = expected_counts(patterns, [MASS, *items], [np.zeros((1, len(weights))), *log_p], weights)
    return counts[1:], counts[0, 0], ll


def settled(history: list[float], ll: float, tol: float) -> bool:
    done = bool(history) and abs(ll - history[-1]) < tol * max(1.0, abs(ll) * 1e-4)
    history.append(float(ll))
    return done


def log_clip(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-12, 1))


def shares(responses: DataFrame, binary: bool) -> dict[int, np.ndarray]:
    """Share of each category by item, in the order of the items; categories count from 0."""
    return counted_shares(responses.where("resp is not null").groupBy("item_id", "resp").agg(F.count(F.lit(1)).alias("n")), binary)


def counted_shares(counts: DataFrame, binary: bool) -> dict[int, np.ndarray]:
    """The same from item_id, resp, n."""
    if counts.select("item_id").distinct().limit(MAX_ITEMS + 1).count() > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    seen: dict[int, dict[int, int]] = {}
    for r in counts.collect():
        seen.setdefault(r["item_id"], {})[r["resp"]] = r["n"]
    out = {}
    for i in sorted(seen):
        if binary and max(seen[i]) > 1:
            raise ValueError(f"item {i} has more than two categories")
        s = np.array([seen[i].get(c, 0) for c in range(2 if binary else max(max(seen[i]), 1) + 1)], float)
        out[i] = s / s.sum()
    return out


def posterior(responses: DataFrame, items: list[int], log_p: list[np.ndarray], weights: np.ndarray, values: np.ndarray) -> DataFrame:
    """person_id, values: the posterior expectation of each column of `values` [point, column]. Each distinct pattern is worked out once."""
    j, k = len(items), max(x.shape[0] for x in log_p)
    table = np.zeros((j, k, len(weights)))
    for i, x in enumerate(log_p):
        table[i, : x.shape[0]] = x
    held = responses.sparkSession.sparkContext.broadcast(({v: i for i, v in enumerate(items)}, table, np.log(np.maximum(weights, 1e-300)), values))
    cell = F.when(F.col("resp").isNotNull() & F.col("item_id").isin(items), F.struct("item_id", "resp"))
    persons = responses.groupBy("person_id").agg(F.array_sort(F.collect_list(cell)).alias("p"))

    def run(batches):
        at, table, lw, values = held.value
        for batch in batches:
            p = batch.column("p")
            size = np.diff(p.offsets.to_numpy())
            cells = p.flatten()
            x = np.full((len(p), len(at)), -1, np.int32)
            x[np.repeat(np.arange(len(p)), size), np.array([at[v] for v in cells.field("item_id").to_pylist()], int)] = cells.field("resp").to_numpy()
            out = []
            for rows in np.array_split(x, max(1, len(x) // 1_000)):
                like = sum((rows == c).astype(float) @ table[:, c] for c in range(table.shape[1])) + lw
                post = np.exp(like - like.max(1, keepdims=True))
                out += ((post @ values) / post.sum(1, keepdims=True)).tolist()
            yield pa.RecordBatch.from_arrays([p, pa.array(out, pa.list_(pa.float64()))], names=["p", "values"])

    kind = persons.schema["p"].dataType.simpleString()
    scored = persons.select("p").distinct().mapInArrow(run, f"p {kind}, values array<double>")
    return persons.join(scored, "p").select("person_id", "values")


@dataclass
class GroupFit:
    model: str
    level: str
    groups: list
    sizes: list[int]
    items: list[int]
    parameters: list[list[np.ndarray]]  # by item and group
    means: np.ndarray
    sds: np.ndarray
    n_parameters: int
    log_likelihood: list[float] = field(default_factory=list)
    converged: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        """item_id, g, parameter, value."""
        rows = [(i, str(g), k, v) for i, ps in zip(self.items, self.parameters, strict=True) for g, p in zip(self.groups, ps, strict=True) for k, v in MODELS[self.model].values(p).items()]
        return spark.createDataFrame(rows, "item_id int, g string, parameter string, value double")

    def abilities(self, spark: SparkSession) -> DataFrame:
        rows = [(str(g), n, float(m), float(s)) for g, n, m, s in zip(self.groups, self.sizes, self.means, self.sds, strict=True)]
        return spark.createDataFrame(rows, "g string, n long, mean double, sd double")


def grouped_patterns(responses: DataFrame, groups: DataFrame) -> DataFrame:
    """g, items, resps, n: the distinct patterns of each group. A row of groups stands for a person, so they are never sent to all."""
    joined = responses.where("resp is not null").join(groups.where("g is not null").select("person_id", "g").hint("merge"), "person_id")
    persons = joined.groupBy("person_id", "g").agg(F.array_sort(F.collect_list(F.struct("item_id", "resp"))).alias("p"))
    return persons.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n")).select("g", F.col("p.item_id").alias("items"), F.col("p.resp").alias("resps"), "n")


def fit_groups(responses: DataFrame, groups: DataFrame, model: str = "2PL", level: str = "scalar", free: Sequence[int] = (), n_nodes: int = 21, max_iter: int = 500, tol: float = 1e-4) -> GroupFit:
    """Item parameters and the abilities' mean and deviation by group. groups: person_id, g; persons without a group are left out.

    configural: all parameters by group, abilities standard normal in each; metric: equal slopes, deviations free;
    scalar: equal parameters, means and deviations free. The first group's abilities are standard normal. Items in
    `free` have parameters by group at every level. Models without slopes have free deviations at every level, so that
    their configural and metric levels are one.
    """
    every = grouped_patterns(responses, groups).persist()
    try:
        return fit_patterns(every, model, level, free, n_nodes, max_iter, tol)
    finally:
        every.unpersist()


def fit_patterns(every: DataFrame, model: str = "2PL", level: str = "scalar", free: Sequence[int] = (), n_nodes: int = 21, max_iter: int = 500, tol: float = 1e-4) -> GroupFit:
    """fit_groups on the patterns that grouped_patterns gives."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}; known are {', '.join(LEVELS)}")
    kind = MODELS[model]
    sloped = model in ("2PL", "3PL", "GRM", "GPCM")  # their first parameter is the slope's logarithm
    counts = every.select("n", F.explode(F.arrays_zip("items", "resps")).alias("x")).groupBy(F.col("x.items").alias("item_id"), F.col("x.resps").alias("resp")).agg(F.sum("n").alias("n"))
    start = {i: kind.start(s) for i, s in counted_shares(counts, model in ("1PL", "2PL", "3PL")).items()}
    items = list(start)
    tied = {i: 0 if level == "configural" or i in free else len(p) if level == "scalar" else int(sloped) for i, p in start.items()}
    sizes = {r[0]: r[1] for r in every.groupBy("g").agg(F.sum("n")).limit(MAX_GROUPS + 1).collect()}
    names = sorted(sizes)
    if len(names) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    answered = [at_hand(with_mass(every.where(F.col("g") == F.lit(g))), len(names)) for g in names]
    x, w = normal_quadrature(n_nodes)
    means, sds = np.zeros(len(names)), np.ones(len(names))
    params = [[p.copy() for _ in names] for p in start.values()]
    history: list[float] = []
    done = False
    for _ in range(max_iter):
        nodes = [m + s * x for m, s in zip(means, sds, strict=True)]
        got = [sums(a, items, [log_clip(kind.curve(ps[g], nodes[g])) for ps in params], w) for g, a in enumerate(answered)]
        if done := settled(history, sum(s[2] for s in got), tol):
            break
        for i, item in enumerate(items):
            t = tied[item]
            size = len(params[i][0])

            def parts(v, t=t, size=size):
                return [np.r_[v[:t], v[t + g * (size - t) : t + (g + 1) * (size - t)]] for g in range(len(names))]

            def target(v, i=i, parts=parts):
                ps = parts(v)
                return sum(float((got[g][0][i, : (c := log_clip(kind.curve(p, nodes[g]))).shape[0]] * c).sum()) for g, p in enumerate(ps)) + sum(map(kind.log_prior, ps)) / len(ps)

            v, _info = climb(target, np.r_[params[i][0][:t], *[p[t:] for p in params[i]]])
            params[i] = parts(v)
        for g in range(1, len(names)):
            mass = got[g][1] / got[g][1].sum()
            mean = float(mass @ nodes[g])
            if level == "scalar":
                means[g] = mean
            if level != "configural" or not sloped:
                sds[g] = np.sqrt(max(float(mass @ (nodes[g] - (mean if level == "scalar" else 0.0)) ** 2), 1e-4))
    others = len(names) - 1
    k = sum(tied[i] + (len(p) - tied[i]) * len(names) for i, p in start.items()) + {"configural": 0 if sloped else others, "metric": others, "scalar": 2 * others}[level]
    return GroupFit(model, level, names, [int(sizes[g]) for g in names], items, params, means, sds, k, history, done)


def invariance(responses: DataFrame, groups: DataFrame, model: str = "2PL", **options) -> DataFrame:
    """level, log_likelihood, n_parameters, aic, bic, and chi2, df, p against the level before, for configural, metric, scalar."""
    rows, before = [], None
    every = grouped_patterns(responses, groups).persist()
    try:
        fits = [(level, fit_patterns(every, model, level, **options)) for level in LEVELS]
    finally:
        every.unpersist()
    for level, f in fits:
        ll, k = f.log_likelihood[-1], f.n_parameters
        chi2, df = (max(0.0, 2 * (before[0] - ll)), before[1] - k) if before else (None, None)
        rows.append((level, ll, k, 2.0 * k - 2 * ll, float(np.log(sum(f.sizes))) * k - 2 * ll, chi2, df, chi2_sf(chi2, df) if df else None, f.converged))
        before = (ll, k)
    return responses.sparkSession.createDataFrame(rows, "level string, log_likelihood double, n_parameters int, aic double, bic double, chi2 double, df int, p double, converged boolean")


def item_bias(responses: DataFrame, groups: DataFrame, model: str = "2PL", items: Sequence[int] | None = None, **options) -> DataFrame:
    """Likelihood ratio of each item with parameters by group against all items equal: item_id, chi2, df, p. One fit an item."""
    base = fit_groups(responses, groups, model, **options)
    rows = []
    for i in base.items if items is None else items:
        f = fit_groups(responses, groups, model, free=[i], **options)
        chi2, df = max(0.0, 2 * (f.log_likelihood[-1] - base.log_likelihood[-1])), f.n_parameters - base.n_parameters
        rows.append((i, chi2, df, chi2_sf(chi2, df)))
    return responses.sparkSession.createDataFrame(rows, "item_id int, chi2 double, df int, p double")


@dataclass
class SpaceFit:
    """A fit on a set of points. rows: what the parameters are; values: what is scored, by point."""

    items: list[int]
    log_p: list[np.ndarray]
    weights: np.ndarray
    values: np.ndarray
    rows: list[tuple]
    columns: str
    n_parameters: int
    log_likelihood: list[float] = field(default_factory=list)
    converged: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    def scores(self, responses: DataFrame) -> DataFrame:
        """person_id, values: expected class memberships, traits or attributes."""
        return posterior(responses, self.items, self.log_p, self.weights, self.values)


def fit_mixture(responses: DataFrame, n_classes: int = 2, model: str = "1PL", n_nodes: int = 15, starts: int = 3, max_iter: int = 500, tol: float = 1e-4, seed: int = 0) -> SpaceFit:
    """Classes of persons with item parameters of their own; abilities are standard normal in each. The best of several starts; classes by falling share.

    The table has class, share, item_id, parameter, value; scores are the memberships.
    """
    if n_classes * n_nodes > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    kind = MODELS[model]
    start = {i: kind.start(s) for i, s in shares(responses, model in ("1PL", "2PL", "3PL")).items()}
    items = list(start)
    x, w = normal_quadrature(n_nodes)
    patterns = with_mass(weighted_patterns(responses)).persist()
    best = None
    try:
        answered = at_hand(patterns)
        for attempt in range(starts):
            rng = np.random.default_rng([seed, attempt])
            params = [[p + rng.normal(0, 0.7, len(p)) * (np.arange(len(p)) == len(p) - 1) for p in start.values()] for _ in range(n_classes)]
            share, history, done = np.full(n_classes, 1 / n_classes), [], False
            for _ in range(max_iter):
                log_p = [np.hstack([log_clip(kind.curve(params[c][i], x)) for c in range(n_classes)]) for i in range(len(items))]
                weights = np.concatenate([s * w for s in share])
                counts, mass, ll = sums(answered, items, log_p, weights)
                if done := settled(history, ll, tol):
                    break
                share = np.maximum(mass.reshape(n_classes, -1).sum(1) / mass.sum(), 1e-6)
                share /= share.sum()
                for c, i in itertools.product(range(n_classes), range(len(items))):
                    e = counts[i, : log_p[i].shape[0], c * n_nodes : (c + 1) * n_nodes]
                    params[c][i], _info = climb(lambda v, e=e: float((e * log_clip(kind.curve(v, x))).sum()) + kind.log_prior(v), params[c][i])
            if best is None or history[-1] > best[0][-1]:
                best = (history, done, params, share)
    finally:
        patterns.unpersist()
    history, done, params, share = best
    order = np.argsort(-share, kind="stable")
    share, params = share[order], [params[c] for c in order]
    rows = [(c + 1, float(share[c]), i, k, v) for c in range(n_classes) for i, p in zip(items, params[c], strict=True) for k, v in kind.values(p).items()]
    log_p = [np.hstack([log_clip(kind.curve(params[c][i], x)) for c in range(n_classes)]) for i in range(len(items))]
    k = n_classes * sum(map(len, start.values())) + n_classes - 1
    return SpaceFit(items, log_p, np.concatenate([s * w for s in share]), np.repeat(np.eye(n_classes), n_nodes, axis=0), rows, "class int, share double, item_id int, parameter string, value double", k, history, done)


def fit_traits(responses: DataFrame, loads: dict[int, Sequence[int]], correlated: bool = False, n_nodes: int = 9, max_iter: int = 500, tol: float = 1e-4) -> SpaceFit:
    """Slopes and intercept of logistic items on several traits. loads: for each item a 1 for every trait that it loads on.

    Bifactor and testlet structures are patterns of loads. Traits are standard normal, with correlations to be found if
    `correlated`. The table has item_id (null for correlations), parameter (a1.., d, r12..), value; scores are the traits.
    """
    found = shares(responses, True)
    items = [i for i in found if i in loads]
    n = len(next(iter(loads.values())))
    if n_nodes**n > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points; take fewer nodes")
    x, w = normal_quadrature(n_nodes)
    grid = np.array(list(itertools.product(x, repeat=n)))
    weights = np.prod(np.array(list(itertools.product(w, repeat=n))), axis=1)
    on = [np.flatnonzero(loads[i]) for i in items]
    params = [np.r_[np.ones(len(o)), np.log(max(found[i][1], 0.02) / max(found[i][0], 0.02))] for i, o in zip(items, on, strict=True)]
    r, history, done = np.eye(n), [], False
    patterns = with_mass(weighted_patterns(responses.where(F.col("item_id").isin(items)))).persist()

    def curve(p, o, points):
        return two(logistic(points[:, o] @ p[:-1] + p[-1]))

    try:
        answered = at_hand(patterns)
        for _ in range(max_iter):
            points = grid @ np.linalg.cholesky(r).T
            log_p = [log_clip(curve(p, o, points)) for p, o in zip(params, on, strict=True)]
            counts, mass, ll = sums(answered, items, log_p, weights)
            if done := settled(history, ll, tol):
                break
            for i, o in enumerate(on):
                # a weak prior keeps slopes finite
                params[i], _info = climb(lambda v, e=counts[i, :2], o=o: float((e * log_clip(curve(v, o, points))).sum()) - 0.5 * float((v[:-1] ** 2).sum()) / 25, params[i])
            if correlated:
                cov = (points * (mass / mass.sum())[:, None]).T @ points
                sd = np.sqrt(np.diag(cov))
                r = np.clip(cov / np.outer(sd, sd), -0.98, 0.98)
                np.fill_diagonal(r, 1.0)
    finally:
        patterns.unpersist()
    rows = [(i, f"a{d + 1}", float(v)) for i, p, o in zip(items, params, on, strict=True) for d, v in zip(o, p[:-1], strict=True)]
    rows += [(i, "d", float(p[-1])) for i, p in zip(items, params, strict=True)]
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)] if correlated else []
    rows += [(None, f"r{a + 1}{b + 1}", float(r[a, b])) for a, b in pairs]
    return SpaceFit(items, log_p, weights, points, rows, "item_id int, parameter string, value double", sum(map(len, params)) + len(pairs), history, done)


def fit_profiles(responses: DataFrame, needed: dict[int, int], n_attributes: int, rule: str = "all", max_iter: int = 2000, tol: float = 1e-4) -> SpaceFit:
    """Diagnostic classification. needed: for each item the bits of the attributes that it asks for.

    rule: `all` (right with every needed attribute but for slips, else by guessing), `any` (with at least one), `each`
    (a probability for every combination of the needed attributes). Shares of all profiles are free. The table has
    item_id, has (the bits held; for `all` and `any` 0 or the needed ones), p (of a right answer); scores are the
    attributes' probabilities.
    """
    if 1 << n_attributes > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} profiles")
    if rule not in ("all", "any", "each"):
        raise ValueError(f"unknown rule {rule}")
    items = [i for i in shares(responses, True) if i in needed]
    profiles = np.arange(1 << n_attributes)
    has = [profiles & needed[i] for i in items]
    if rule != "each":
        has = [np.where(h == needed[i] if rule == "all" else h > 0, needed[i], 0) for i, h in zip(items, has, strict=True)]
    cells = [np.unique(h, return_inverse=True) for h in has]
    held = [np.array([bin(v).count("1") for v in c]) for c, _ in cells]
    p = [0.2 + 0.6 * h / max(h.max(), 1) for h in held]
    weights = np.full(len(profiles), 1 / len(profiles))
    history, done = [], False
    patterns = with_mass(weighted_patterns(responses.where(F.col("item_id").isin(items)))).persist()
    try:
        answered = at_hand(patterns)
        for _ in range(max_iter):
            log_p = [log_clip(two(v[at])) for v, (_, at) in zip(p, cells, strict=True)]
            counts, mass, ll = sums(answered, items, log_p, weights)
            if done := settled(history, ll, tol):
                break
            weights = np.maximum(mass / mass.sum(), 1e-12)
            for i, (values, at) in enumerate(cells):
                right, wrong = (np.bincount(at, counts[i, c], len(values)) for c in (1, 0))
                p[i] = np.clip((right + 1e-6) / (right + wrong + 2e-6), 1e-4, 1 - 1e-4)
    finally:
        patterns.unpersist()
    rows = [(i, int(v), float(x)) for i, (values, _), xs in zip(items, cells, p, strict=True) for v, x in zip(values, xs, strict=True)]
    bits = (profiles[:, None] >> np.arange(n_attributes) & 1).astype(float)
    return SpaceFit(items, log_p, weights, bits, rows, "item_id int, has int, p double", len(rows) + len(profiles) - 1, history, done)
