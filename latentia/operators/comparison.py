"""Comparing models by the likelihood of persons and of held-out persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.functions import irf


def vuong(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean difference of the persons' log-likelihoods (tables of scored responses), its deviation, and z (0 if all are equal)."""
    one = first.groupBy("person_id").agg(F.sum("ll").alias("l1"))
    two = second.groupBy("person_id").agg(F.sum("ll").alias("l2"))
    d = F.col("l1") - F.col("l2")
    g = one.join(two, "person_id").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return g.select("n", "mean", "sd", F.when(F.col("sd") > 1e-10, F.sqrt("n") * F.col("mean") / F.greatest("sd", F.lit(1e-10))).otherwise(0.0).alias("z"))


def held_out_likelihood(responses: DataFrame, folds: int) -> DataFrame:
    """By fold of persons, the log-likelihood of its responses under item chances from the other folds (half each with none)."""
    fold = F.pmod("person_id", F.lit(folds)).cast("int").alias("fold")
    g = responses.where("resp is not null").groupBy("item_id", fold).agg(F.count(F.lit(1)).alias("n"), F.sum("resp").alias("right"))
    both = g.join(F.broadcast(g.groupBy("item_id").agg(F.sum("n").alias("all_n"), F.sum("right").alias("all_right"))), "item_id")
    p = irf.clip(F.coalesce(F.try_divide(F.col("all_right") - F.col("right"), F.col("all_n") - F.col("n")), F.lit(0.5)))
    return both.groupBy("fold").agg(F.sum("n").alias("n"), F.sum(F.col("right") * F.log(p) + (F.col("n") - F.col("right")) * F.log(1 - p)).alias("log_likelihood"))
