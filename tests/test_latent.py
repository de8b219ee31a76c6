import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentia.operators import latent, models, network
from latentia.sources import simulation as sim


def table(spark, x):
    """Long responses of a matrix; -1 is missing."""
    rows = [(i, j + 1, None if v < 0 else int(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "person_id long, item_id int, resp int")


def draw(rng, p):
    return (rng.random(p.shape) < p).astype(int)


def logistic(z):
    return 1 / (1 + np.exp(-z))


def test_driver_and_workers_give_the_same_sums(spark, monkeypatch):
    r = table(spark, draw(np.random.default_rng(0), np.full((300, 4), 0.5)))
    here = models.fit(r, "2PL", max_iter=5)
    monkeypatch.setattr(models, "FEW_ANSWERS", 0)
    there = models.fit(r, "2PL", max_iter=5)
    assert here.log_likelihood == pytest.approx(there.log_likelihood, rel=1e-10)


def test_groups_recover_mean_and_deviation(spark):
    bank = sim.item_parameters(spark, 8, "1PL", seed=4)
    persons = sim.abilities(spark, 3000, 1).withColumn("g", F.when(F.col("person_id") % 2 == 0, "a").otherwise("b"))
    moved = persons.withColumn("theta", F.when(F.col("g") == "b", 0.7 + 1.3 * F.col("theta")).otherwise(F.col("theta")))
    r = sim.simulate(moved.drop("g"), bank, 3)
    groups = persons.select("person_id", "g")
    f = latent.fit_groups(r, groups, "1PL")
    assert f.converged and f.groups == ["a", "b"] and sum(f.sizes) == 3000
    assert f.means == pytest.approx([0, 0.7], abs=0.12) and f.sds == pytest.approx([1, 1.3], abs=0.12)
    assert len({tuple(p) for ps in f.parameters for p in ps}) == 8
    rows = {x.level: x for x in latent.invariance(r, groups, "2PL", n_nodes=11, tol=1e-2).collect()}
    assert rows["configural"].n_parameters == 32 and rows["metric"].n_parameters == 25 and rows["scalar"].n_parameters == 18
    assert rows["configural"].log_likelihood >= rows["metric"].log_likelihood - 1 >= rows["scalar"].log_likelihood - 2
    assert rows["scalar"].df == 7
    rasch = {x.level: x for x in latent.invariance(r, groups, "1PL", n_nodes=11).collect()}
    assert rasch["metric"].df == 0 and rasch["metric"].p is None and rasch["metric"].chi2 == pytest.approx(0, abs=1e-6)
    assert rasch["scalar"].df == 7 and 0 <= rasch["scalar"].p <= 1


def test_groups_are_joined_once_and_never_broadcast(spark, monkeypatch):
    """A row of groups stands for a person, and all fits of one comparison take the same patterns."""
    x = draw(np.random.default_rng(2), np.full((200, 3), 0.5))
    r, groups = table(spark, x), spark.range(200).select(F.col("id").alias("person_id"), (F.col("id") % 2).alias("g"))
    plan = latent.grouped_patterns(r, groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    calls = []
    monkeypatch.setattr(latent, "grouped_patterns", lambda *a, f=latent.grouped_patterns: calls.append(1) or f(*a))
    assert latent.invariance(r, groups, "1PL", n_nodes=7, max_iter=3).count() == 3 and len(calls) == 1


def test_item_bias_finds_the_shifted_item(spark):
    rng = np.random.default_rng(5)
    theta = rng.normal(size=1600)
    b = np.tile(np.linspace(-1, 1, 5), (1600, 1))
    b[800:, 2] += 1.0
    r = table(spark, draw(rng, logistic(theta[:, None] - b)))
    groups = spark.range(1600).select(F.col("id").alias("person_id"), (F.col("id") >= 800).alias("g"))
    got = {x.item_id: x for x in latent.item_bias(r, groups, "1PL", items=[2, 3], n_nodes=11).collect()}
    assert got[3].df == 1 and got[3].p < 1e-4 and got[3].chi2 > 5 * got[2].chi2
    with pytest.raises(ValueError, match="unknown level"):
        latent.fit_groups(r, groups, level="strict")


def test_mixture_separates_classes(spark):
    rng = np.random.default_rng(6)
    kind = (np.arange(2400) >= 800).astype(int)
    b = np.array([[-1.5, -1.5, -1.5, 1.5, 1.5, 1.5], [1.5, 1.5, 1.5, -1.5, -1.5, -1.5]])
    r = table(spark, draw(rng, logistic(0.6 * rng.normal(size=2400)[:, None] - b[kind])))
    f = latent.fit_mixture(r, 2, "1PL", starts=2)
    shares = {x["class"]: x.share for x in f.table(spark).collect()}
    assert f.converged and shares[1] == pytest.approx(2 / 3, abs=0.06) and shares[1] + shares[2] == pytest.approx(1)
    found = {x.person_id: int(np.argmax(x["values"])) for x in f.scores(r).collect()}
    assert np.mean([found[i] == 1 - kind[i] for i in range(2400)]) > 0.9


def test_traits_and_their_correlation(spark):
    rng = np.random.default_rng(7)
    theta = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 3000)
    a = np.array([[1.5, 0], [1.2, 0], [1.4, 0], [1.3, 0], [0, 1.5], [0, 1.2], [0, 1.4], [0, 1.3]])
    d = np.linspace(-0.8, 0.8, 8)
    r = table(spark, draw(rng, logistic(theta @ a.T + d)))
    f = latent.fit_traits(r, {i + 1: tuple((a[i] > 0).astype(int)) for i in range(8)}, correlated=True)
    got = {(x.item_id, x.parameter): x.value for x in f.table(spark).collect()}
    assert f.converged and got[None, "r12"] == pytest.approx(0.5, abs=0.12)
    assert [got[i + 1, "d"] for i in range(8)] == pytest.approx(list(d), abs=0.2)
    assert [got[i + 1, "a1" if i < 4 else "a2"] for i in range(8)] == pytest.approx(list(a.sum(1)), abs=0.4)
    assert (1, "a2") not in got


@pytest.mark.parametrize("rule", ["all", "any", "each"])
def test_profiles(spark, rule):
    rng = np.random.default_rng(8)
    needed = {i + 1: m for i, m in enumerate([1, 2, 3, 1, 2, 3, 1, 2])}
    profile = rng.choice(4, 3000, p=[0.3, 0.2, 0.2, 0.3])
    has = {"all": lambda m: (profile & m) == m, "any": lambda m: (profile & m) > 0, "each": lambda m: (profile & m) == m}[rule]
    r = table(spark, draw(rng, np.stack([np.where(has(m), 0.9, 0.15) for m in needed.values()], 1)))
    f = latent.fit_profiles(r, needed, 2, rule)
    got = {(x.item_id, x.has): x.p for x in f.table(spark).collect()}
    assert f.converged and f.weights == pytest.approx([0.3, 0.2, 0.2, 0.3], abs=0.06)
    assert len(got) == (20 if rule == "each" else 16)
    assert all(got[i, 0] == pytest.approx(0.15, abs=0.07) and got[i, m] == pytest.approx(0.9, abs=0.07) for i, m in needed.items())
    assert f.log_likelihood == sorted(f.log_likelihood)
    with pytest.raises(ValueError, match="unknown rule"):
        latent.fit_profiles(r, needed, 2, "most")


def test_posterior_against_brute_force_with_missing(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 2, (60, 3))
    x[0] = -1
    log_p = [np.log(np.stack([1 - p, p])) for p in rng.uniform(0.1, 0.9, (3, 5))]
    w, values = np.full(5, 0.2), rng.normal(size=(5, 2))
    want = []
    for row in x:
        like = w * np.exp(sum((log_p[j][v] for j, v in enumerate(row) if v >= 0), np.zeros(5)))
        want.append(like @ values / like.sum())
    got = {r.person_id: r["values"] for r in latent.posterior(table(spark, x), [1, 2, 3], log_p, w, values).collect()}
    assert len(got) == 60 and all(got[i] == pytest.approx(v) for i, v in enumerate(want))


def test_ising_recovers_its_weights(spark):
    h, w = np.array([-0.5, 0.2, 0.0, 0.3]), np.zeros((4, 4))
    for a, b, v in ((0, 1, 1.2), (1, 2, -0.8), (2, 3, 0.6)):
        w[a, b] = w[b, a] = v
    states = np.array(list(itertools.product((0, 1), repeat=4)))
    p = np.exp(states @ h + 0.5 * np.einsum("ni,ij,nj->n", states, w, states))
    x = states[np.random.default_rng(10).choice(16, 20_000, p=p / p.sum())]
    x[:5, 0] = -1
    r = table(spark, x)
    items, thresholds, weights = network.fit_ising(r)
    assert items == [1, 2, 3, 4] and (weights == weights.T).all()
    assert thresholds == pytest.approx(h, abs=0.12) and weights.ravel() == pytest.approx(w.ravel(), abs=0.12)
    sparse = network.fit_ising(r, penalty=0.05)[2]
    assert sparse[0, 2] == 0 and 0 < sparse[0, 1] < weights[0, 1]
    assert all(abs(e.difference) < 1e-9 for e in network.compare_networks(r, r).collect())
