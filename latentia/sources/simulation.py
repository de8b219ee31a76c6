"""Draws that any engine can repeat: uniforms come from the MD5 digest of what they belong to."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions import irf


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1), fixed by the parts."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number from two uniforms."""
    u, v = uniform(*parts, 1), uniform(*parts, 2)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def abilities(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("person_id"), normal("id", seed).alias("theta"))


def simulate(persons: DataFrame, bank: DataFrame, seed: int = 0) -> DataFrame:
    """Answers to every item: right or wrong by up to four parameters (a, b, c, d), or graded where the bank has steps."""
    cells = persons.join(F.broadcast(bank))
    u = uniform("person_id", "item_id", seed)
    if "steps" in bank.columns:
        above = F.filter(F.transform("steps", lambda s: irf.p_2pl(F.col("theta"), F.col("a"), s)), lambda p: F.col("_u") < p)
        return cells.withColumn("_u", u).select("person_id", "item_id", F.size(above).alias("resp"))
    c = F.col("c") if "c" in bank.columns else F.lit(0.0)
    d = F.col("d") if "d" in bank.columns else F.lit(1.0)
    p = irf.p_4pl(F.col("theta"), F.col("a"), F.col("b"), c, d)
    return cells.select("person_id", "item_id", (u < p).cast("int").alias("resp"))


def item_parameters(spark: SparkSession, n_items: int, model: str = "2PL", n_categories: int = 4, seed: int = 0) -> DataFrame:
    """Parameters drawn for a model: log-normal slopes, normal difficulties, uniform asymptotes, sorted thresholds."""
    items = spark.range(1, n_items + 1).select(F.col("id").cast("int").alias("item_id"))
    a = F.lit(1.0) if model in ("1PL", "PCM") else F.exp(0.3 * normal("item_id", seed, 11))
    out = items.withColumns({"a": a, "b": normal("item_id", seed, 12)})
    if model in ("3PL", "4PL"):
        out = out.withColumn("c", 0.05 + 0.2 * uniform("item_id", seed, 13))
    if model == "4PL":
        out = out.withColumn("d", 0.9 + 0.1 * uniform("item_id", seed, 14))
    if model in ("GRM", "GPCM", "PCM"):
        out = out.withColumn("steps", F.array_sort(F.array(*[F.col("b") + normal("item_id", seed, 20 + k) for k in range(n_categories - 1)])))
    return out


def bootstrap_weights(persons: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """person_id, replicate, weight: how often a person stands in each resample, Poisson with mean 1; persons with weight 0 are left out.

    A person's weight needs nothing but its id, so no sample is shuffled and no index is joined.
    """
    u = uniform("person_id", "replicate", seed)
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    return persons.select("person_id").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("weight", weight).where("weight > 0")


def bootstrap_difficulty(responses: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """By item: the mean answer, its bootstrap standard error and the 2.5 and 97.5 percentiles."""
    w = bootstrap_weights(responses.select("person_id").distinct(), n, seed)
    per = responses.where("resp is not null").join(w, "person_id").groupBy("item_id", "replicate").agg((F.sum(F.col("weight") * F.col("resp")) / F.sum("weight")).alias("m"))
    g = per.groupBy("item_id").agg(F.stddev_samp("m").alias("se"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return responses.groupBy("item_id").agg(F.avg("resp").alias("difficulty")).join(g, "item_id")


def impute_from_model(responses: DataFrame, theta: DataFrame, bank: DataFrame, seed: int = 0, m: int = 1) -> DataFrame:
    """A row for each person, item and imputation: the answer, or a draw from the model at the person's ability."""
    cells = theta.select("person_id", "theta").join(F.broadcast(bank.select("item_id", "a", "b"))).join(responses.where("resp is not null").select("person_id", "item_id", "resp"), ["person_id", "item_id"], "left")
    cells = cells.withColumn("imputation", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    draw = (uniform("person_id", "item_id", "imputation", seed) < irf.p_2pl(F.col("theta"), F.col("a"), F.col("b"))).cast("int")
    return cells.select("person_id", "item_id", "imputation", F.coalesce("resp", draw).alias("resp"), F.col("resp").isNull().alias("imputed"))


def plausible_values(posterior: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """person_id, draw, theta: from each person's posterior over nodes (person_id, cdf: array of struct node, upto), by its inverse."""
    draws = posterior.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = uniform("person_id", "draw", seed)
    hit = F.element_at(F.filter("cdf", lambda x: x["upto"] >= F.col("_u")), 1)
    return draws.withColumn("_u", u).select("person_id", "draw", F.coalesce(hit["node"], F.element_at("cdf", -1)["node"]).alias("theta"))


def low_discrepancy(n: int, dims: int, seed: int = 0) -> np.ndarray:
    """Halton points with a seeded shift, for quadrature by quasi random numbers; dims up to 20."""
    primes = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71][:dims]
    out = np.zeros((n, dims))
    for j, base in enumerate(primes):
        for i in range(n):
            k, f, x = i + 1, 1.0, 0.0
            while k:
                f /= base
                x += f * (k % base)
                k //= base
            out[i, j] = x
    return (out + np.random.default_rng(seed).random(dims)) % 1.0
