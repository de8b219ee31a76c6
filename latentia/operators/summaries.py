"""Model summaries: null models, information criteria, moment fit, reliability, pooling, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.functions import irf
from latentia.operators.fit import pairs


def null_models(responses: DataFrame) -> DataFrame:
    """model, log_likelihood, k, n: an own chance for each item, and one chance for all. n counts the persons."""
    items = responses.where("resp is not null").groupBy("item_id").agg(F.count(F.lit(1)).alias("seen"), F.sum("resp").alias("right"))
    pooled = items.agg((F.sum("right") / F.sum("seen")).alias("pooled"))
    persons = responses.agg(F.countDistinct("person_id").alias("n"))
    both = items.join(F.broadcast(pooled))

    def ll(p):
        return F.sum(F.col("right") * F.log(p) + (F.col("seen") - F.col("right")) * F.log(1 - p))

    sums = both.agg(ll(irf.clip(F.col("right") / F.col("seen"))).alias("own"), ll(irf.clip(F.col("pooled"))).alias("one"), F.count(F.lit(1)).alias("j"))
    rows = F.inline(F.array(F.struct(F.lit("independence").alias("model"), F.col("own").alias("log_likelihood"), F.col("j").alias("k")), F.struct(F.lit("pooled").alias("model"), F.col("one").alias("log_likelihood"), F.lit(1).cast("long").alias("k"))))
    return sums.select(rows).join(F.broadcast(persons))


def information_criteria(models: DataFrame) -> DataFrame:
    """aic, bic, sabic, aicc (null where n - k - 1 is not positive), caic and Akaike weight of each model (model, log_likelihood, k, n)."""
    k, n, dev = F.col("k"), F.col("n"), -2 * F.col("log_likelihood")
    df = models.withColumns({"aic": dev + 2 * k, "bic": dev + k * F.log(n), "sabic": dev + k * F.log((n + 2) / 24), "caic": dev + k * (F.log(n) + 1)})
    df = df.withColumn("aicc", F.when(n - k - 1 > 0, F.col("aic") + 2 * k * (k + 1) / F.greatest(n - k - 1, F.lit(1))))
    least = df.agg(F.min("aic").alias("least"))
    df = df.join(F.broadcast(least)).withColumn("raw", F.exp((F.col("least") - F.col("aic")) / 2))
    return df.join(F.broadcast(df.agg(F.sum("raw").alias("total")))).withColumn("weight", F.col("raw") / F.col("total")).drop("least", "raw", "total")


def moment_fit(scored: DataFrame, n_parameters: int) -> DataFrame:
    """Squared gaps between observed and expected first and second moments, each weighted by its responses."""
    one = scored.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), (F.avg("resp") - F.avg("p")).alias("r")).select("n", "r")
    two = pairs(scored).groupBy("item_i", "item_j").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("xi") * F.col("xj")) - F.avg(F.col("pi") * F.col("pj"))).alias("r")).select("n", "r")
    g = one.unionByName(two).agg(F.sum(F.col("n") * F.col("r") * F.col("r")).alias("statistic"), F.count(F.lit(1)).alias("m"))
    return g.select("statistic", F.greatest(F.col("m") - n_parameters, F.lit(1)).cast("long").alias("df"))


def empirical_reliability(scores: DataFrame) -> DataFrame:
    """Share of the variance of theta in itself plus the mean squared error; 0 if both vanish."""
    g = scores.agg(F.var_samp("theta").alias("v"), F.avg(F.col("se") * F.col("se")).alias("e"))
    return g.select(F.when(F.col("v") + F.col("e") > 1e-10, F.col("v") / (F.col("v") + F.col("e"))).otherwise(0.0).alias("reliability"))


def marginal_reliability(bank: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted mean of information over information plus the inverse variance of theta. nodes: node, w."""
    info = nodes.join(F.broadcast(bank)).groupBy("node", "w").agg(F.sum(irf.information_2pl(F.col("node"), F.col("a"), F.col("b"))).alias("i"))
    t, w = F.col("node"), F.col("w")
    spread = nodes.agg((F.sum(w * t * t) / F.sum(w) - F.pow(F.sum(w * t) / F.sum(w), F.lit(2))).alias("v"))
    g = info.join(F.broadcast(spread)).agg((F.sum(w * F.col("i") / (F.col("i") + 1 / F.col("v"))) / F.sum(w)).alias("r"))
    return g.select(F.least(F.greatest("r", F.lit(0.0)), F.lit(1.0)).alias("reliability"))


def rubin(estimates: DataFrame, key: str) -> DataFrame:
    """Pools estimates (key, q, u: estimate and its variance) of several imputations."""
    g = estimates.groupBy(key).agg(F.count("q").cast("double").alias("m"), F.avg("q").alias("estimate"), F.avg("u").alias("within"), F.coalesce(F.var_samp("q"), F.lit(0.0)).alias("between"))
    extra = (1 + 1 / F.col("m")) * F.col("between")
    total = F.col("within") + extra
    g = g.withColumns({"total": total, "lambda": F.when(total > 0, extra / total).otherwise(0.0)})
    g = g.withColumn("df", F.when(extra > 0, (F.col("m") - 1) * F.pow(1 + F.try_divide(F.col("within"), extra), F.lit(2))).otherwise(1e10))
    fmi = F.col("lambda") + 2 / (F.col("df") + 3) * (1 - F.col("lambda"))
    return g.select(key, "estimate", "within", "between", "total", "lambda", "df", F.least(F.greatest(fmi, F.lit(0.0)), F.lit(1.0)).alias("fmi"))


def weight_efficiency(weights: DataFrame) -> DataFrame:
    """Effective sample size and design effect of survey weights w."""
    g = weights.agg(F.count("w").alias("n"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss"))
    ess = F.try_divide(F.col("s") * F.col("s"), F.col("ss"))
    return g.select("n", ess.alias("ess"), F.try_divide(F.col("n"), ess).alias("deff"))


def completeness(responses: DataFrame, n_items: int) -> DataFrame:
    """How many persons have so many of the items: the last row's are the complete cases."""
    p = responses.groupBy("person_id").agg(F.count("resp").alias("observed"))
    return p.groupBy("observed").agg(F.count(F.lit(1)).alias("persons"), F.max((F.col("observed") == n_items).cast("int")).alias("complete"))


def empirical_bins(scored: DataFrame, n_bins: int = 5) -> DataFrame:
    """Observed and expected proportion of each item in bins of the persons' sum scores at their percentiles."""
    totals = scored.groupBy("person_id").agg(F.sum("resp").alias("total"))
    edges = totals.agg(F.percentile("total", F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])).alias("edges"))
    binned = totals.join(F.broadcast(edges)).select("person_id", F.size(F.filter("edges", lambda e: F.col("total") >= e)).alias("bin"))
    return scored.join(binned, "person_id").groupBy("item_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("resp").alias("observed"), F.avg("p").alias("expected"))
