import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentia.functions import priors
from latentia.operators import cat, models, multidim
from latentia.sources import simulation as sim
from latentia.streaming import smoothing


@pytest.mark.parametrize("model", ["1PL", "2PL", "GRM"])
def test_calibration_recovers_parameters(spark, model):
    bank = sim.item_parameters(spark, 6, model, 4, 3)
    if model == "1PL":
        bank = bank.withColumn("a", F.lit(1.0))
    f = models.fit(sim.simulate(sim.abilities(spark, 2500, 1), bank, 7), model)
    true = {r.item_id: r for r in bank.collect()}
    assert f.converged and f.items == sorted(true)
    for i, p in zip(f.items, f.parameters, strict=True):
        got = models.MODELS[model].values(p)
        assert got["a"] == pytest.approx(true[i].a, abs=0.25)
        if model == "GRM":
            assert [got[f"b{k}"] for k in (1, 2, 3)] == pytest.approx(true[i].steps, abs=0.4)
        else:
            assert got["b"] == pytest.approx(true[i].b, abs=0.3)


@pytest.mark.parametrize("model", ["3PL", "GPCM", "PCM", "NRM"])
def test_calibration_climbs(spark, model):
    """The likelihood never falls (but for the prior's share), and each curve's categories add up to one."""
    bank = sim.item_parameters(spark, 4, "2PL" if model == "3PL" else "GRM", 3, 5)
    f = models.fit(sim.simulate(sim.abilities(spark, 800, 2), bank, 6), model, max_iter=25)
    assert all(b >= a - 0.5 for a, b in itertools.pairwise(f.log_likelihood)) and f.log_likelihood[-1] > f.log_likelihood[0]
    t = np.linspace(-3, 3, 7)
    for p in f.parameters:
        assert models.MODELS[model].curve(p, t).sum(0) == pytest.approx(1, abs=1e-6)


def test_unknown_models_and_categories_are_refused(spark):
    r = spark.createDataFrame([(1, 1, 2), (2, 1, 0)], "person_id long, item_id int, resp int")
    with pytest.raises(ValueError):
        models.fit(r, "6PL")
    with pytest.raises(ValueError):
        models.fit(r, "2PL")


@pytest.fixture(scope="module")
def bank():
    rng = np.random.default_rng(2)
    return cat.Bank(np.arange(1, 61), np.exp(rng.normal(0, 0.3, 60)), rng.normal(0, 1, 60), np.array(["x", "y", "z"] * 20))


def run(session, answer=lambda i: 1):
    while (i := session.next_item()) is not None:
        session.answer(i, answer(i))
    return session.state


def test_sessions_end_by_their_rules(bank):
    assert len(run(cat.Session(bank, stop=cat.stop_at_length(7))).given) == 7
    s = run(cat.Session(bank, stop=cat.any_of(cat.stop_at_error(0.4), cat.stop_at_length(60))), lambda i: int(bank.b[i] < 0))
    assert s.se <= 0.4 and len(set(s.given)) == len(s.given)
    assert len(run(cat.Session(bank, stop=cat.not_before(9, cat.stop_at_error(5.0)))).given) == 9
    done = run(cat.Session(bank, stop=cat.stop_when_classified(-1.0)))
    assert done.theta - 1.96 * done.se > -1.0
    settled = run(cat.Session(bank, stop=cat.all_of(cat.stop_when_settled(0.05), cat.stop_at_length(4))))
    assert abs(settled.theta - settled.track[-1]) < 0.05
    with pytest.raises(ValueError):
        session = cat.Session(bank)
        session.answer(3, 1)
        session.answer(3, 0)


def test_choice_exposure_and_content(bank):
    first = cat.Session(bank).next_item()
    assert first == int(np.argmax(bank.information(0.0)))
    assert cat.Session(bank, selection=cat.nearest_difficulty).next_item() == int(np.argmin(np.abs(bank.b)))
    top = set(np.argsort(-bank.information(0.0))[:5].tolist())
    picks = {cat.Session(bank, exposure=cat.one_of_best(5), seed=k).next_item() for k in range(40)}
    assert picks <= top and len(picks) > 1
    never = np.ones(60)
    never[first] = 0.0
    assert cat.Session(bank, exposure=cat.with_probability(never)).next_item() != first
    shares = run(cat.Session(bank, content=cat.blueprint({"x": 0.5, "y": 0.3, "z": 0.2}), stop=cat.stop_at_length(10)))
    assert sorted(bank.area[shares.given].tolist()) == ["x"] * 5 + ["y"] * 3 + ["z"] * 2
    limited = run(cat.Session(bank, content=cat.at_most({"x": 1, "y": 2}), stop=cat.stop_at_length(10)))
    assert (bank.area[limited.given] == "x").sum() <= 1 and (bank.area[limited.given] == "y").sum() <= 2
    low = run(cat.Session(bank, selection=cat.stratified(3, 9), stop=cat.stop_at_length(9)))
    assert bank.a[low.given[:3]].max() <= bank.a[low.given[-3:]].min()


def test_simulated_sessions_repeat_and_recover(spark):
    persons = spark.range(60).select(F.col("id").alias("person_id"), ((F.col("id") % 3) - 1).cast("double").alias("theta"))
    items = sim.item_parameters(spark, 150, "2PL", seed=4)
    one = cat.simulate(persons, items, 1, stop=cat.stop_at_length(25))
    assert sorted(one.collect()) == sorted(cat.simulate(persons.repartition(5), items, 1, stop=cat.stop_at_length(25)).collect())
    assert all(abs(r.bias) < 0.35 and r.mse < 0.3 and r.n_items == 25 for r in cat.conditional_error(one).collect())
    assert max(r.rate for r in cat.exposure_rates(one).collect()) == 1.0  # all start with one item


def test_paths_equal_brute_force():
    p = {"start": 0.3, "learn": 0.2, "forget": 0.05, "slip": 0.1, "guess": 0.25}
    move = np.array([[0.8, 0.2], [0.05, 0.95]])
    seen = np.array([[0.75, 0.25], [0.1, 0.9]])
    rng = np.random.default_rng(1)
    for _ in range(10):
        x = rng.integers(0, 2, 6).tolist()
        joint = {}
        for path in itertools.product((0, 1), repeat=6):
            v = np.array([0.7, 0.3])[path[0]] * seen[path[0], x[0]]
            for t in range(1, 6):
                v *= move[path[t - 1], path[t]] * seen[path[t], x[t]]
            joint[path] = v
        total = sum(joint.values())
        assert smoothing.most_likely(x, **p) == list(max(joint, key=joint.get))
        assert smoothing.smoothed(x, **p) == pytest.approx([sum(v for k, v in joint.items() if k[t]) / total for t in range(6)])
        assert smoothing.forward(x, **p)[2] == pytest.approx(np.log(total))
    draws = np.array([smoothing.sampled(x, rng, **p) for _ in range(4000)]).mean(0)
    assert draws == pytest.approx(smoothing.smoothed(x, **p), abs=0.04)


def test_rotations_and_matching():
    rng = np.random.default_rng(0)
    simple = np.zeros((12, 3))
    for i in range(12):
        simple[i, i % 3] = 0.7 + 0.05 * (i // 3)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    for method in ("varimax", "quartimax", "oblimin", "geomin", "promax"):
        x, t, phi = multidim.rotate(simple @ turn, method)
        order, signs = multidim.matched(simple, x)
        assert x[:, order] * signs == pytest.approx(simple, abs=0.02), method
        assert np.diag(phi) == pytest.approx(1)
    r = multidim.procrustes(simple @ turn, simple)
    assert simple @ turn @ r == pytest.approx(simple)
    found = multidim.link_traits(simple, simple @ turn, np.arange(12.0) + simple @ np.array([0.3, -0.2, 0.1]), np.arange(12.0))
    assert found["rms_slopes"] < 1e-9 and found["shift"] == pytest.approx([0.3, -0.2, 0.1]) and found["rms_intercepts"] < 1e-9


def test_overall_discrimination(spark):
    bank = spark.createDataFrame([(1, [3.0, 4.0], -2.5), (2, [0.0, 0.0], 1.0)], "item_id int, slopes array<double>, d double")
    got = {r.item_id: r for r in multidim.overall(bank).collect()}
    assert (got[1].discrimination, got[1].difficulty, got[1].cosines) == (5.0, 0.5, [0.6, 0.8]) and got[2].discrimination == 0
    assert [r.weight for r in multidim.composite_weights(bank).orderBy("trait").collect()] == pytest.approx([0.6, 0.8])


def test_densities_add_up():
    x = np.linspace(-12, 12, 200_001)
    for p, inside in ((priors.normal(1, 2), x), (priors.truncated_normal(0, 1, -1, 2), x), (priors.log_normal(0, 0.5), x), (priors.beta(5, 17), x), (priors.uniform(-1, 3), x), (priors.gamma(3, 2), x)):
        assert sum(p.density(float(v)) for v in inside[::20]) * (x[20] - x[0]) == pytest.approx(1, abs=2e-3)
    grid = np.linspace(-6, 6, 121)
    w = priors.standardised_histogram(grid, priors.normal_weights(grid, 0.7, 1.4))
    assert (w * grid).sum() == pytest.approx(0, abs=0.01) and (w * grid**2).sum() == pytest.approx(1, abs=0.03)
    assert priors.mixture(grid, [0.5, 0.5], [-1, 1], [1, 1]).sum() == pytest.approx(1) and priors.polynomial_curve(grid, [1, 0.3]).sum() == pytest.approx(1)
