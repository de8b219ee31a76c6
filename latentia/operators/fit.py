"""Fit of items, persons and pairs under a two-parameter bank at given abilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.functions import irf
from latentia.operators.classical import correlate


def scored(responses: DataFrame, bank: DataFrame, theta: DataFrame) -> DataFrame:
    """One row for each response with p, variance v, residual z and log-likelihood ll; the lineage that all statistics share."""
    df = responses.where("resp is not null").join(F.broadcast(bank), "item_id").join(theta.select("person_id", "theta"), "person_id")
    df = df.withColumn("p", irf.clip(irf.p_2pl(F.col("theta"), F.col("a"), F.col("b"))))
    return df.select("person_id", "item_id", "resp", "theta", "p", (F.col("p") * (1 - F.col("p"))).alias("v")).withColumns(
        {"z": (F.col("resp") - F.col("p")) / F.sqrt("v"), "ll": F.when(F.col("resp") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))}
    )


def mean_squares(df: DataFrame, key: str) -> DataFrame:
    """Infit and outfit by item or person."""
    r2 = (F.col("resp") - F.col("p")) * (F.col("resp") - F.col("p"))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(r2), F.sum("v")).alias("infit"), F.avg(r2 / F.col("v")).alias("outfit"))


def zh(df: DataFrame) -> DataFrame:
    """Standardised log-likelihood by person; null under two responses."""
    lp, lq = F.log("p"), F.log(1 - F.col("p"))
    g = df.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ll").alias("ll"), F.sum(F.col("p") * lp + (1 - F.col("p")) * lq).alias("e"), F.sum(F.col("v") * (lp - lq) * (lp - lq)).alias("var"))
    return g.select("person_id", "n", F.when((F.col("n") >= 2) & (F.col("var") > 1e-10), (F.col("ll") - F.col("e")) / F.sqrt("var")).alias("zh"))


def residual_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.avg(F.col("resp") - F.col("p")).alias("mean_raw"), F.stddev_pop("z").alias("sd_standard"), F.max(F.abs("z")).alias("max_abs"), F.count(F.when(F.abs("z") > 2, 1)).alias("n_large"))


def pairs(df: DataFrame) -> DataFrame:
    """Item pairs within persons: a self-join on the person, so a pair of items costs the persons that have both."""
    i = df.select("person_id", F.col("item_id").alias("item_i"), F.col("z").alias("zi"), F.col("resp").alias("xi"), F.col("p").alias("pi"))
    j = df.select("person_id", F.col("item_id").alias("item_j"), F.col("z").alias("zj"), F.col("resp").alias("xj"), F.col("p").alias("pj"))
    return i.join(j, "person_id").where("item_i < item_j")


def q3(df: DataFrame) -> DataFrame:
    """Correlation of standardised residuals over persons with both items; 0 for two pairs or fewer."""
    c = correlate(pairs(df), ["item_i", "item_j"], "zi", "zj", "q3")
    return c.select("item_i", "item_j", "n", F.when(F.col("n") > 2, F.col("q3")).otherwise(0.0).alias("q3"))


def ld_chi2(df: DataFrame, floor: float = 0.5, least: int = 10) -> DataFrame:
    """Local-dependence chi-square and G-square of the 2 x 2 tables; null under `least` pairs."""
    p = pairs(df)
    cells, obs, exp = [], {}, {}
    for a in (0, 1):
        for b in (0, 1):
            pa, pb = (F.col("pi") if a else 1 - F.col("pi")), (F.col("pj") if b else 1 - F.col("pj"))
            cells += [F.count(F.when((F.col("xi") == a) & (F.col("xj") == b), 1)).alias(f"o{a}{b}"), F.sum(pa * pb).alias(f"e{a}{b}")]
            obs[a, b], exp[a, b] = F.col(f"o{a}{b}"), F.greatest(F.col(f"e{a}{b}"), F.lit(floor))
    g = p.groupBy("item_i", "item_j").agg(F.count(F.lit(1)).alias("n"), *cells)
    chi2 = sum(((obs[k] - exp[k]) * (obs[k] - exp[k]) / exp[k] for k in obs), F.lit(0.0))
    g2 = 2 * sum((F.when(obs[k] > 0, obs[k] * F.log(F.greatest(obs[k], F.lit(1)) / exp[k])).otherwise(0.0) for k in obs), F.lit(0.0))
    return g.select("item_i", "item_j", "n", F.when(F.col("n") >= least, chi2).alias("chi2"), F.when(F.col("n") >= least, g2).alias("g2"))


def binned_fit(responses: DataFrame, bank: DataFrame, theta: DataFrame, n_bins: int = 5, least: int = 5) -> DataFrame:
    """Chi-square by item over bins of the sum score at its percentiles; the last bin is closed."""
    s = scored(responses, bank, theta)
    totals = s.groupBy("person_id").agg(F.sum("resp").alias("total"))
    edges = totals.agg(F.percentile("total", F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])).alias("edges"))
    binned = totals.join(F.broadcast(edges)).select("person_id", F.size(F.filter("edges", lambda e: F.col("total") >= e)).alias("bin"))
    g = s.join(binned, "person_id").groupBy("item_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("resp").alias("o"), F.avg("p").alias("e"))
    e = F.least(F.greatest(F.col("e"), F.lit(0.01)), F.lit(0.99))
    g = g.where(F.col("n") >= least).withColumn("x", F.col("n") * (F.col("o") - e) * (F.col("o") - e) / (e * (1 - e)))
    return g.groupBy("item_id").agg(F.sum("x").alias("chi2"), F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).cast("long").alias("df"))
