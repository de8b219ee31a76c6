"""Posterior draws: pointwise likelihoods, information criteria, smoothed importance weights, plausible values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentia.functions import irf
from latentia.functions.special import normal_quadrature


def posterior_cdf(responses: DataFrame, bank: DataFrame, n_nodes: int = 21) -> DataFrame:
    """person_id and cdf: the nodes in order with the posterior's share up to each."""
    from latentia.operators.scoring import patterned

    x, w = normal_quadrature(n_nodes)
    persons = patterned(responses)
    cells = persons.select("pattern").distinct().select("pattern", F.explode_outer("pattern").alias("cell")).select("pattern", F.col("cell.item_id").alias("item_id"), F.col("cell.resp").alias("resp")).join(bank.select("item_id", "a", "b"), "item_id", "left")

    def log_p(t: float):
        p = irf.clip(irf.p_2pl(F.lit(t), F.col("a"), F.col("b")))
        return F.coalesce(F.sum(F.when(F.col("resp") == 1, F.log(p)).when(F.col("resp") == 0, F.log(1 - p))), F.lit(0.0))

    logs = cells.groupBy("pattern").agg(F.array(*[log_p(float(t)) + float(np.log(v)) for t, v in zip(x, w, strict=True)]).alias("ll"))
    logs = logs.withColumn("top", F.array_max("ll")).withColumn("u", F.transform("ll", lambda v: F.exp(v - F.col("top"))))
    total = F.aggregate("u", F.lit(0.0), lambda s, v: s + v)
    nodes = F.array(*[F.lit(float(t)) for t in x])
    upto = F.transform("u", lambda v, k: F.aggregate(F.slice("u", F.lit(1), k + 1), F.lit(0.0), lambda s, y: s + y) / F.col("z"))
    cdf = logs.withColumn("z", total).select("pattern", F.zip_with(nodes, upto, lambda n, c: F.struct(n.alias("node"), c.alias("upto"))).alias("cdf"))
    return persons.join(cdf, "pattern").select("person_id", "cdf")


def plausible_statistics(values: DataFrame) -> DataFrame:
    """The mean ability over draws (person_id, draw, theta), with its variance within and between draws pooled."""
    per = values.groupBy("draw").agg(F.avg("theta").alias("q"), (F.var_samp("theta") / F.count("theta")).alias("v"))
    m = F.count(F.lit(1))
    between = F.coalesce(F.var_samp("q"), F.lit(0.0))
    return per.agg(m.alias("n_draws"), F.avg("q").alias("mean"), F.avg("v").alias("within"), between.alias("between"), F.sqrt(F.avg("v") + (1 + 1 / m) * between).alias("se"))


def plausible_regression(values: DataFrame, outcome: DataFrame) -> DataFrame:
    """Least squares of y (person_id, y) on ability, by draw and pooled."""
    g = values.join(outcome, "person_id").groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "theta").alias("s"), F.regr_intercept("y", "theta").alias("i"), F.regr_syy("y", "theta").alias("syy"), F.regr_sxy("y", "theta").alias("sxy"), F.regr_sxx("y", "theta").alias("sxx"))
    g = g.withColumn("v", (F.col("syy") - F.col("s") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    m = F.count(F.lit(1))
    return g.agg(m.alias("n_draws"), F.avg("s").alias("slope"), F.avg("i").alias("intercept"), F.sqrt(F.avg("v") + (1 + 1 / m) * F.coalesce(F.var_samp("s"), F.lit(0.0))).alias("se_slope"))


def pointwise(responses: DataFrame, bank: DataFrame, draws: DataFrame) -> DataFrame:
    """person_id, draw, ll: each person's log-likelihood at its score's ability, with the bank's difficulties moved by each draw's shift."""
    r = responses.where("resp is not null").withColumn("theta", (F.sum("resp").over(Window.partitionBy("person_id")) - 1.0) / 1.5)
    cells = r.join(F.broadcast(bank), "item_id").join(F.broadcast(draws))
    p = irf.clip(irf.p_2pl(F.col("theta"), F.col("a"), F.col("b") + F.col("shift")))
    return cells.groupBy("draw", "person_id").agg(F.sum(F.when(F.col("resp") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("ll"))


def log_mean_exp(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The log of the mean of exponentials by key, the largest taken out first."""
    top = df.groupBy(key).agg(F.max(value).alias("_top"))
    return df.join(top, key).groupBy(key).agg((F.log(F.avg(F.exp(F.col(value) - F.col("_top")))) + F.max("_top")).alias(out))


def waic(pointwise_ll: DataFrame, key: str = "person_id") -> DataFrame:
    """n, lppd, p_waic, waic and its standard error, from ll by observation and draw."""
    lp = log_mean_exp(pointwise_ll, key, "ll", "lp").join(pointwise_ll.groupBy(key).agg(F.var_samp("ll").alias("v")), key)
    n = F.count(F.lit(1))
    return lp.agg(n.alias("n"), F.sum("lp").alias("lppd"), F.sum("v").alias("p_waic"), (-2 * (F.sum("lp") - F.sum("v"))).alias("waic"), (2 * F.sqrt(n * F.var_pop(F.col("lp") - F.col("v")))).alias("se"))


def dic(pointwise_ll: DataFrame, centre: int) -> DataFrame:
    """dic and its effective number of parameters, from the draws' total log-likelihood and that of the central draw."""
    t = pointwise_ll.groupBy("draw").agg(F.sum("ll").alias("ll"))
    m = t.agg(F.avg("ll").alias("a"), F.max(F.when(F.col("draw") == centre, F.col("ll"))).alias("c"))
    p = 2 * (F.col("c") - F.col("a"))
    return m.select((-2 * F.col("c") + 2 * p).alias("dic"), p.alias("p_dic"))


def tail_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution by the profile posterior mean over a grid; x sorted and positive."""
    n = len(x)
    m = 30 + int(np.sqrt(n))
    q = x[int(np.floor(n / 4 + 0.5)) - 1]
    theta = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * q)
    shape = np.array([-np.mean(np.log1p(-t * x)) for t in theta])
    level = n * (np.log(np.divide(theta, shape)) + shape - 1)
    weight = 1 / np.exp(level - level[:, None]).sum(1)
    best = float((theta * weight / weight.sum()).sum())
    k = float(-np.mean(np.log1p(-best * x)))
    return -k, k / best


def psis_loo(pointwise_ll: DataFrame, key: str = "person_id") -> DataFrame:
    """key, elpd and k (the tail's shape) by observation: leave-one-out by importance weights whose tail is smoothed.

    An observation has as many rows as draws, and those are one group.
    """
    kind = dict(pointwise_ll.dtypes)[key]
    arrays = pointwise_ll.groupBy(key).agg(F.sort_array(F.collect_list("ll")).alias("ll"))

    def run(batches):
        for batch in batches:
            elpd, shapes = [], []
            for ll in batch.column("ll").to_pylist():
                ll = np.array(ll)
                ratio = -ll - (-ll).max()
                order = np.argsort(ratio)
                n, tail, k = len(ll), int(min(0.2 * len(ll), 3 * np.sqrt(len(ll)))), np.inf
                if tail >= 5:
                    cut = ratio[order[-tail - 1]]
                    over = np.exp(ratio[order[-tail:]]) - np.exp(cut)
                    if over[0] > 0 and over[-1] > over[0]:
                        k, scale = tail_fit(over)
                        share = (np.arange(1, tail + 1) - 0.5) / tail
                        smooth = scale * (np.power(1 - share, -k) - 1) / k if abs(k) > 1e-12 else -scale * np.log(1 - share)
                        ratio[order[-tail:]] = np.minimum(np.log(np.exp(cut) + smooth), 0.0)
                w = np.exp(ratio - ratio.max())
                elpd.append(float(np.log((w * np.exp(ll - ll.max())).sum() / w.sum()) + ll.max()))
                shapes.append(float(k))
                del n
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "elpd": pa.array(elpd), "k": pa.array(shapes)})

    return arrays.mapInArrow(run, f"`{key}` {kind}, elpd double, k double")


def posterior_summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """param, n, mean, sd and the ends of the central interval, from param, draw, value."""
    tail = (1 - level) / 2
    return draws.groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", round(tail, 6)).alias("low"), F.percentile("value", round(1 - tail, 6)).alias("high"))


def compare(models: DataFrame) -> DataFrame:
    """model, criterion (lower is better): difference to the best and weight."""
    best = models.agg(F.min("criterion").alias("best"))
    d = models.join(F.broadcast(best)).withColumn("delta", F.col("criterion") - F.col("best")).withColumn("u", F.exp(-F.col("delta") / 2))
    total = d.agg(F.sum("u").alias("total"))
    return d.join(F.broadcast(total)).select("model", "criterion", "delta", (F.col("u") / F.col("total")).alias("weight"))
