"""Queries of groups, mixtures, several traits, profiles and networks; scores on given parameters have SQL."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from latentia.functions.special import normal_quadrature
from latentia.operators import latent, network
from latentia.operators.models import logistic, two
from latentia.plans.queries import A1, rounded
from latentia.sources import responses as src
from latentia.sources import simulation as sim

X, W = normal_quadrature(9)


def _answers(spark, d, p):
    """Answers of a person for each order to 8 items, drawn with probability p: a column of person_id, item_id, t1, t2."""
    persons = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("person_id")).withColumns({"t1": sim.normal("person_id", 31), "t2": sim.normal("person_id", 32)})
    cells = persons.withColumn("item_id", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return cells.select("person_id", "item_id", (sim.uniform("person_id", "item_id", 33) < p).cast("int").alias("resp"))


def _logistic(z):
    return 1 / (1 + F.exp(-z))


def _two_groups(spark, d):
    """The second group stands half a unit higher and spreads more."""
    second = F.col("person_id") % 2 == 1
    t = F.when(second, 0.5 + 1.2 * F.col("t1")).otherwise(F.col("t1"))
    r = _answers(spark, d, _logistic((0.8 + 0.1 * F.col("item_id")) * (t - 0.4 * (F.col("item_id") - 4))))
    return r, r.select("person_id", (F.col("person_id") % 2).cast("int").alias("g")).distinct()


def profile_posterior(spark, d):
    """Three attributes; the bits of an item's number are those it needs; slips rise with the number."""
    profiles = np.arange(8)
    log_p = [np.log(two(np.where(profiles & i == i, 0.9 - 0.01 * i, 0.2 + 0.01 * i))) for i in range(1, 8)]
    bits = (profiles[:, None] >> np.arange(3) & 1).astype(float)
    got = latent.posterior(src.dichotomous(spark, d), list(range(1, 8)), log_p, np.arange(1, 9) / 36, bits)
    return rounded(got.select("person_id", *[F.col("values")[k].alias(f"p{k}") for k in range(3)]), "p0", "p1", "p2")


def trait_scores(spark, d):
    """Two traits, on given slopes and intercepts."""
    points = np.array(list(itertools.product(X, repeat=2)))
    weights = np.array([a * b for a, b in itertools.product(W, repeat=2)])
    log_p = [np.log(two(logistic(points @ np.array([0.8 * (i % 2), 1.0]) + 0.5 - 0.2 * i))) for i in range(1, 8)]
    got = latent.posterior(src.dichotomous(spark, d), list(range(1, 8)), log_p, weights, points)
    return rounded(got.select("person_id", F.col("values")[0].alias("t1"), F.col("values")[1].alias("t2")), "t1", "t2")


def group_fit(spark, d):
    f = latent.fit_groups(*_two_groups(spark, d), "2PL", "scalar")
    return rounded(f.abilities(spark).withColumn("converged", F.lit(f.converged)), "mean", "sd", digits=3)


def invariance(spark, d):
    return rounded(latent.invariance(*_two_groups(spark, d), "1PL"), "log_likelihood", "aic", "bic", "chi2", "p", digits=2)


def mixture_fit(spark, d):
    """A third of the persons finds hard what the others find easy."""
    turned = F.when(F.col("person_id") % 3 == 0, -1.5).otherwise(1.5) * F.when(F.col("item_id") % 2 == 0, -1).otherwise(1)
    f = latent.fit_mixture(_answers(spark, d, _logistic(0.6 * F.col("t1") - turned)), 2, "1PL")
    return rounded(f.table(spark).withColumn("converged", F.lit(f.converged)), "share", "value", digits=2)


def trait_fit(spark, d):
    odd = F.col("item_id") % 2 == 1
    r = _answers(spark, d, _logistic(1.3 * F.when(odd, F.col("t1")).otherwise(0.5 * F.col("t1") + 0.866 * F.col("t2")) + 0.2 * (F.col("item_id") - 4)))
    f = latent.fit_traits(r, {i: (i % 2, 1 - i % 2) for i in range(1, 9)}, correlated=True)
    return rounded(f.table(spark).withColumn("converged", F.lit(f.converged)), "value", digits=2)


def profile_fit(spark, d):
    """Two attributes; an item needs the bits of its number modulo 3, plus one."""
    needed = F.col("item_id") % 3 + 1
    held = F.floor(4 * sim.uniform("person_id", 34)).cast("int")
    r = _answers(spark, d, F.when(held.bitwiseAND(needed) == needed, 0.9).otherwise(0.15))
    f = latent.fit_profiles(r, {i: i % 3 + 1 for i in range(1, 9)}, 2)
    return rounded(f.table(spark).withColumn("converged", F.lit(f.converged)), "p", digits=2)


def network_edges(spark, d):
    return rounded(network.ising_edges(src.dichotomous(spark, d), penalty=0.005), "weight", digits=3)


QUERIES = {f"irt_{f.__name__}": f for f in (profile_posterior, trait_scores, group_fit, invariance, mixture_fit, trait_fit, profile_fit, network_edges)}

_GRID = "quad(i, node, w) as (values " + ", ".join(f"({i}, {float(a)!r}::double, {float(b)!r}::double)" for i, (a, b) in enumerate(zip(X, W, strict=True))) + ")"
ORACLES = {
    "irt_profile_posterior": (
        f"with {A1}, "
        "x as (select person_id, k, resp, case when (k & item_id) = item_id then 0.9::double - 0.01::double * item_id else 0.2::double + 0.01::double * item_id end as p from r, range(8) t(k)), "
        "l as (select person_id, k, ln((k + 1) / 36.0::double) + sum(ln(case when resp = 1 then p else 1 - p end)) as ll from x group by 1, 2), "
        "e as (select person_id, k, exp(ll - max(ll) over (partition by person_id)) as u from l) "
        "select person_id, round(sum(u * (k & 1)) / sum(u), 6) as p0, round(sum(u * ((k >> 1) & 1)) / sum(u), 6) as p1, round(sum(u * ((k >> 2) & 1)) / sum(u), 6) as p2 from e group by 1"
    ),
    "irt_trait_scores": (
        f"with {A1}, {_GRID}, "
        "g as (select a.i * 9 + b.i as k, a.node as t1, b.node as t2, a.w * b.w as w from quad a, quad b), "
        "x as (select person_id, k, t1, t2, w, resp, 1 / (1 + exp(-(0.8::double * (item_id % 2) * t1 + t2 + 0.5::double - 0.2::double * item_id))) as p from r, g), "
        "l as (select person_id, k, max(t1) as t1, max(t2) as t2, ln(max(w)) + sum(ln(case when resp = 1 then p else 1 - p end)) as ll from x group by 1, 2), "
        "e as (select *, exp(ll - max(ll) over (partition by person_id)) as u from l) "
        "select person_id, round(sum(u * t1) / sum(u), 6) + 0.0 as t1, round(sum(u * t2) / sum(u), 6) + 0.0 as t2 from e group by 1"
    ),
}
