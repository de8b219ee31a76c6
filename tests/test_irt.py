import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentia.functions import irf
from latentia.functions.special import chi2_sf, normal_cdf, normal_quadrature
from latentia.operators import calibrate, classical, scoring
from latentia.plans.catalogue import ORACLES, QUERIES
from latentia.sources import responses as src
from latentia.streaming import tracing

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=2e-6)
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all()


def test_special_functions():
    assert normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert chi2_sf(10, 2) == pytest.approx(math.exp(-5), rel=1e-12)
    x, w = normal_quadrature(21)
    assert w.sum() == pytest.approx(1) and (w * x * x).sum() == pytest.approx(1)


def test_category_probabilities_add_up(spark):
    from pyspark.sql import functions as F

    steps = F.array(F.lit(-0.5), F.lit(0.2), F.lit(1.0))
    row = spark.range(1).select(irf.p_graded(F.lit(0.3), F.lit(1.2), steps).alias("g"), irf.p_partial_credit(F.lit(0.3), F.lit(1.2), steps).alias("p"), irf.p_nominal(F.lit(0.3), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.5))).alias("n")).first()
    z = np.cumsum([0, *[1.2 * (0.3 - d) for d in (-0.5, 0.2, 1.0)]])
    np.testing.assert_allclose(row["p"], np.exp(z) / np.exp(z).sum())
    assert sum(row["g"]) == pytest.approx(1) and sum(row["n"]) == pytest.approx(1)


def test_calibration_recovers_and_never_loses_likelihood(spark):
    rng = np.random.default_rng(3)
    a, b, theta = np.array([0.8, 1.2, 1.6, 1.0, 1.4]), np.array([-1.0, -0.4, 0.1, 0.6, 1.1]), rng.normal(size=3000)
    x = (rng.random((3000, 5)) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))).astype(int)
    rows = [(p, i + 1, int(x[p, i])) for p in range(3000) for i in range(5)]
    fit = calibrate.fit_2pl(spark.createDataFrame(rows, "person_id long, item_id int, resp int"))
    assert all(after >= before - 1e-6 for before, after in zip(fit.log_likelihood, fit.log_likelihood[1:]))
    assert np.abs(fit.b - b).max() < 0.25 and np.abs(fit.a - a).max() < 0.4


def test_calibration_query_runs_until_it_converged(spark):
    from latentia.plans import queries

    d = "/root/testdata/sf0.001"
    got = queries.calibration(spark, d).collect()
    assert len(got) == 7 and all(r.converged for r in got)
    short = calibrate.fit_2pl(src.dichotomous(spark, d), max_iter=10)
    assert not short.converged and np.abs(short.a - np.array([r.a for r in sorted(got, key=lambda r: r.item_id)])).max() > 0.01


def test_scores_from_a_large_bank_and_without_answers(spark):
    """A bank of any size scores; who answered nothing, or only what the bank lacks, has the prior's values."""
    from latentia.operators import scoring

    bank = spark.range(10_050).selectExpr("cast(id as int) as item_id", "1.0D as a", "0.0D as b")
    r = spark.createDataFrame([(1, 10_040, 1), (2, 1, None), (3, 20_000, 1)], "person_id long, item_id int, resp int")
    got = {x.person_id: x for x in scoring.eap(r, bank).collect()}
    assert got[1].theta > 0.3 and got[2].theta == pytest.approx(0) and got[2].se == pytest.approx(1) and got[3].theta == pytest.approx(0)
    for method in ("ml", "wle"):
        out = {x.person_id: x for x in scoring.fscores(r, bank, method).collect()}
        assert out[2].theta is None and out[1].theta is not None
    assert {x.person_id: round(x.theta, 6) for x in scoring.fscores(r, bank, "map").collect()}[2] == 0


def test_smoothed_importance_weights(spark):
    """Leave-one-out of a normal mean with known variance, against the exact predictive density."""
    from latentia.operators import posterior

    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, 30)
    draws = rng.normal(y.mean(), 1 / np.sqrt(30), 2000)
    rows = [(i, k, float(-0.5 * np.log(2 * np.pi) - 0.5 * (v - m) ** 2)) for i, v in enumerate(y) for k, m in enumerate(draws)]
    got = {r.person_id: r for r in posterior.psis_loo(spark.createDataFrame(rows, "person_id long, draw int, ll double")).collect()}
    for i, v in enumerate(y):
        rest = np.delete(y, i)
        var = 1 + 1 / 29
        assert got[i].elpd == pytest.approx(-0.5 * np.log(2 * np.pi * var) - 0.5 * (v - rest.mean()) ** 2 / var, abs=0.05) and got[i].k < 0.7


def test_linking_recovers_a_transformation(spark):
    from latentia.operators import equating

    old = src.bank(spark)
    new = old.withColumns({"a": F.col("a") * 0.8, "b": (F.col("b") + 0.5) / 0.8})
    for method in ("mean_sigma", "mean_mean", "haebara", "stocking_lord"):
        assert equating.constants(equating.anchors(old, new), method) == pytest.approx((0.8, -0.5), abs=1e-4)
    odd = new.withColumn("b", F.when(F.col("item_id") == 4, F.col("b") + 2).otherwise(F.col("b")))
    stay, slope, shift = equating.purified(old, odd)
    assert stay == [1, 2, 3, 5, 6, 7] and (slope, shift) == pytest.approx((0.8, -0.5), abs=1e-6)
    assert equating.chain([(2.0, 1.0), (0.5, -1.0)], 1) == [pytest.approx((0.5, -0.5)), (1.0, 0.0), pytest.approx((0.5, -1.0))]
    drifted = {r.item_id: r.n_flagged for r in equating.longitudinal_drift([old, old, old.withColumn("b", F.when(F.col("item_id") == 1, 9.0).otherwise(F.col("b")))], 0, 1.0).collect()}
    assert drifted[1] >= 1


def test_wide_and_back_and_validation(spark):
    wide = spark.createDataFrame([(1, 0.0, 1.0), (2, -1.0, float("nan"))], "p long, x double, y double")
    long = src.from_wide(wide, "p", ["x", "y"])
    assert sorted((r.person_id, r.item_id, r.resp) for r in long.where("resp is not null").collect()) == [(1, 1, 0), (1, 2, 1)]
    with pytest.raises(src.ResponseError):
        src.validate(long, 1)


def test_missing_key_is_wrong(spark):
    r = spark.createDataFrame([(1, 1, None), (2, 1, 3)], "person_id long, item_id int, resp int")
    assert sorted(x.resp for x in classical.key_to_binary(r, {1: 3}).collect()) == [0, 1]


def test_sum_score_distribution_adds_up(spark):
    assert sum(r.p for r in scoring.sum_scores(src.bank(spark)).collect()) == pytest.approx(1)


def test_stream_equals_batch(spark, tmp_path):
    trials = src.trials(spark, DATA)
    trials.write.parquet(str(tmp_path / "in"))
    stream = tracing.trace_stream(spark.readStream.schema(trials.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("traced").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.person_id, r.skill): round(r.mastery, 9) for r in spark.table("traced").collect()}
    assert got == {(r.person_id, r.skill): round(r.mastery, 9) for r in tracing.trace(trials).collect()}
