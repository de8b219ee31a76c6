"""Differential functioning between groups, and linking of calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.functions import irf


def mantel_haenszel(responses: DataFrame, groups: DataFrame, stratum: DataFrame) -> DataFrame:
    """Continuity-corrected chi-square and common odds ratio by item. groups: person_id, g (0 reference, 1 focal); stratum: person_id, s."""
    df = responses.where("resp is not null").join(groups, "person_id").join(stratum, "person_id")
    cell = lambda g, x: F.count(F.when((F.col("g") == g) & (F.col("resp") == x), 1)).cast("double")
    t = df.groupBy("item_id", "s").agg(cell(0, 1).alias("a"), cell(0, 0).alias("b"), cell(1, 1).alias("c"), cell(1, 0).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    t = t.withColumn("n", n).where("n > 1")
    nr, nf, right, wrong = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("a") + F.col("c"), F.col("b") + F.col("d")
    g = t.groupBy("item_id").agg(F.sum("a").alias("sa"), F.sum(nr * right / F.col("n")).alias("ea"), F.sum(nr * nf * right * wrong / (F.col("n") * F.col("n") * (F.col("n") - 1))).alias("va"), F.sum(F.col("a") * F.col("d") / F.col("n")).alias("up"), F.sum(F.col("b") * F.col("c") / F.col("n")).alias("down"))
    gap = F.abs(F.col("sa") - F.col("ea")) - 0.5
    return g.select("item_id", F.when(F.col("va") > 0, gap * gap / F.greatest("va", F.lit(1e-300))).otherwise(0.0).alias("chi2"), F.when(F.col("down") > 0, F.col("up") / F.greatest("down", F.lit(1e-300))).otherwise(1.0).alias("odds"))


def sibtest(responses: DataFrame, groups: DataFrame) -> DataFrame:
    """Uncorrected SIBTEST beta of each item, matched on the rest of the score."""
    t = responses.where("resp is not null").join(groups, "person_id")
    total = t.groupBy("person_id").agg(F.sum("resp").alias("total"))
    m = t.join(total, "person_id").withColumn("k", F.col("total") - F.col("resp"))
    side = lambda g, f: f(F.when(F.col("g") == g, F.col("resp")))
    c = m.groupBy("item_id", "k").agg(side(0, F.avg).alias("mr"), side(1, F.avg).alias("mf"), side(0, F.count).alias("nr"), side(1, F.count).alias("nf")).where("nr > 0 and nf > 0")
    w = 2.0 * F.col("nr") * F.col("nf") / (F.col("nr") + F.col("nf"))
    return c.groupBy("item_id").agg((F.sum(w * (F.col("mr") - F.col("mf"))) / F.sum(w)).alias("beta"), F.count(F.lit(1)).alias("n_scores"))


def group_residuals(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean raw and squared residuals by item and group, and the weighted between-group statistic of the means by item."""
    r = scored.join(groups, "person_id").withColumn("r", F.col("resp") - F.col("p"))
    g = r.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mrr"), F.avg(F.col("r") * F.col("r")).alias("msr"), F.var_samp("r").alias("var"))
    centre = g.groupBy("item_id").agg((F.sum(F.col("n") * F.col("mrr")) / F.sum("n")).alias("centre"))
    both = g.join(centre, "item_id")
    d = F.col("mrr") - F.col("centre")
    return both.groupBy("item_id").agg(F.sum(F.when(F.col("var") > 0, d * d * F.col("n") / F.greatest("var", F.lit(1e-300))).otherwise(0.0)).alias("grdif_r"), F.max("msr").alias("max_msr"))


def link_mean_sigma(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slope and intercept that take the new scale to the old one by the anchors' difficulties."""
    j = old.select("item_id", F.col("b").alias("bo"), F.col("a").alias("ao")).join(new.select("item_id", F.col("b").alias("bn"), F.col("a").alias("an")), "item_id")
    s = j.agg(F.stddev_samp("bo").alias("so"), F.stddev_samp("bn").alias("sn"), F.avg("bo").alias("mo"), F.avg("bn").alias("mn"), F.avg("ao").alias("ao"), F.avg("an").alias("an"))
    slope = F.when(F.col("sn") < 1e-10, 1.0).otherwise(F.try_divide(F.col("so"), F.col("sn")))
    mm = F.col("an") / F.col("ao")
    return s.select(slope.alias("a_mean_sigma"), (F.col("mo") - slope * F.col("mn")).alias("b_mean_sigma"), mm.alias("a_mean_mean"), (F.col("mo") - mm * F.col("mn")).alias("b_mean_mean"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Robust z of each anchor's move."""
    j = old.select("item_id", F.col("a").alias("ao"), F.col("b").alias("bo")).join(new.select("item_id", F.col("a").alias("an"), F.col("b").alias("bn")), "item_id")
    d = j.withColumn("d", F.sqrt((F.col("an") - F.col("ao")) * (F.col("an") - F.col("ao")) + (F.col("bn") - F.col("bo")) * (F.col("bn") - F.col("bo"))))
    med = d.agg(F.median("d").alias("med"))
    dev = d.join(F.broadcast(med)).withColumn("dev", F.abs(F.col("d") - F.col("med")))
    mad = dev.agg(F.median("dev").alias("mad"))
    return dev.join(F.broadcast(mad)).select("item_id", "d", F.when(F.col("mad") < 1e-10, 0.0).otherwise(F.try_divide(F.col("d") - F.col("med"), 1.4826 * F.col("mad"))).alias("z"))


def area_between(old: DataFrame, new: DataFrame, low: float = -4, high: float = 4, n: int = 100) -> DataFrame:
    """Signed and unsigned area between two calibrations' curves of an item, by the trapezoidal rule on n points."""
    j = old.select("item_id", F.col("a").alias("ao"), F.col("b").alias("bo")).join(new.select("item_id", F.col("a").alias("an"), F.col("b").alias("bn")), "item_id")
    step = (high - low) / (n - 1)
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    grid = j.select("*", i).withColumn("t", low + F.col("i") * step)
    gap = irf.p_2pl(F.col("t"), F.col("ao"), F.col("bo")) - irf.p_2pl(F.col("t"), F.col("an"), F.col("bn"))
    w = F.when(F.col("i").isin(0, n - 1), step / 2).otherwise(step)
    return grid.groupBy("item_id").agg(F.sum(w * gap).alias("signed"), F.sum(w * F.abs(gap)).alias("unsigned"))


def crossing_sibtest(responses: DataFrame, groups: DataFrame) -> DataFrame:
    """Uncorrected SIBTEST beta of each item up to and above the median of its matching score, and their difference."""
    t = responses.where("resp is not null").join(groups, "person_id")
    total = t.groupBy("person_id").agg(F.sum("resp").alias("total"))
    m = t.join(total, "person_id").withColumn("k", F.col("total") - F.col("resp"))
    side = lambda g, f: f(F.when(F.col("g") == g, F.col("resp")))
    c = m.groupBy("item_id", "k").agg(F.count(F.lit(1)).alias("n"), side(0, F.avg).alias("mr"), side(1, F.avg).alias("mf"), side(0, F.count).alias("nr"), side(1, F.count).alias("nf"))
    middle = c.groupBy("item_id").agg(F.percentile("k", F.lit(0.5), F.col("n")).alias("middle"))
    w = 2.0 * F.col("nr") * F.col("nf") / (F.col("nr") + F.col("nf"))
    d = c.where("nr > 0 and nf > 0").join(F.broadcast(middle), "item_id").withColumns({"w": w, "d": F.col("mr") - F.col("mf"), "high": F.col("k") > F.col("middle")})

    def beta(high):
        own = F.when(F.col("high") == F.lit(high), F.col("w"))
        return F.coalesce(F.try_divide(F.sum(own * F.col("d")), F.sum(own)), F.lit(0.0))

    return d.groupBy("item_id").agg(beta(False).alias("beta_low"), beta(True).alias("beta_high")).withColumn("beta_crossing", F.col("beta_high") - F.col("beta_low"))
