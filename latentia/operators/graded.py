"""Graded responses: fit under the partial credit model, scores under the graded response model, recoding, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.functions import irf
from latentia.operators.scoring import patterned, posterior_moments


def partial_credit_fit(responses: DataFrame, bank: DataFrame, theta: DataFrame) -> DataFrame:
    """n, infit and outfit by item; bank: item_id, a, steps (array). Responses with hardly any expected variance are left out of the outfit."""
    df = responses.where("resp is not null").join(F.broadcast(bank.select("item_id", "a", "steps")), "item_id").join(theta.select("person_id", "theta"), "person_id")
    df = df.withColumn("ps", irf.p_partial_credit(F.col("theta"), F.col("a"), F.col("steps")))
    ks = F.transform("ps", lambda p, k: p * k)
    df = df.withColumn("e", F.aggregate(ks, F.lit(0.0), lambda s, x: s + x))
    squares = F.aggregate(F.transform("ps", lambda p, k: p * k * k), F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("v", F.greatest(squares - F.col("e") * F.col("e"), F.lit(0.0)))
    r2 = (F.col("resp") - F.col("e")) * (F.col("resp") - F.col("e"))
    ratio = F.when(F.col("v") > 1e-10, r2 / F.greatest("v", F.lit(1e-10)))
    return df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.when(F.sum("v") > 1e-10, F.try_divide(F.sum(r2), F.sum("v"))).alias("infit"), F.avg(ratio).alias("outfit"))


def graded_eap(responses: DataFrame, bank: DataFrame, n_nodes: int = 21) -> DataFrame:
    """person_id, theta, se under the graded response model; bank: item_id, a, steps (rising thresholds). Equal patterns are scored once; a person without answers has the prior's values."""
    def log_p(t: float) -> Column:
        curve = lambda k: irf.p_2pl(F.lit(t), F.col("a"), F.get(F.col("steps"), k))
        low, high = F.coalesce(curve(F.col("resp") - 1), F.lit(1.0)), F.coalesce(curve(F.col("resp")), F.lit(0.0))
        return F.when(F.col("resp").isNotNull() & F.col("a").isNotNull(), F.log(irf.clip(low - high)))

    persons = patterned(responses)
    scored = posterior_moments(persons.select("pattern").distinct(), bank.select("item_id", "a", "steps"), log_p, n_nodes)
    return persons.join(scored, "pattern").select("person_id", "theta", "se")


def adjacent(responses: DataFrame, top: int) -> DataFrame:
    """Each graded item as `top` right-or-wrong ones: resp is at least the step. A missing response is missing in all."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(top))).alias("step")
    return responses.select("person_id", "item_id", "resp", steps).withColumn("resp", (F.col("resp") >= F.col("step")).cast("int"))


def category_counts(responses: DataFrame) -> DataFrame:
    return responses.where("resp is not null").groupBy("item_id", "resp").agg(F.count(F.lit(1)).alias("n"))
