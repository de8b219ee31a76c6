"""Fit indices, flags, differential functioning of items and tests, kernel smooths and network moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.functions import irf
from latentia.functions.special import chi2_sf_column


def item_moments(scored: DataFrame) -> DataFrame:
    """Sums by pair of items i < j over persons with both: n, x and p sums, squares and products."""
    i = scored.select("person_id", F.col("item_id").alias("item_i"), F.col("resp").cast("double").alias("xi"), F.col("p").alias("pi"))
    j = scored.select("person_id", F.col("item_id").alias("item_j"), F.col("resp").cast("double").alias("xj"), F.col("p").alias("pj"))
    c = F.col
    pairs = i.join(j, "person_id").where("item_i < item_j")
    return pairs.groupBy("item_i", "item_j").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x).alias(n) for n, x in {"sx": c("xi"), "sy": c("xj"), "sxx": c("xi") * c("xi"), "syy": c("xj") * c("xj"), "sxy": c("xi") * c("xj"), "sp": c("pi"), "sq": c("pj"), "spp": c("pi") * c("pi"), "sqq": c("pj") * c("pj"), "spq": c("pi") * c("pj")}.items()]
    )


def fit_indices(scored: DataFrame, n_parameters: int) -> DataFrame:
    """The moment statistic with its degrees of freedom, the same of the independence model, and RMSEA, CFI, TLI and SRMSR."""
    m = item_moments(scored)
    n = F.col("n")
    corr = lambda x, y, xx, yy, xy: F.try_divide(n * F.col(xy) - F.col(x) * F.col(y), F.sqrt((n * F.col(xx) - F.col(x) * F.col(x)) * (n * F.col(yy) - F.col(y) * F.col(y))))
    gap = corr("sx", "sy", "sxx", "syy", "sxy") - corr("sp", "sq", "spp", "sqq", "spq")
    two = F.col("sxy") / n - F.col("spq") / n
    base = F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n
    pair = m.agg(F.sum(n * two * two).alias("s2"), F.count(F.lit(1)).alias("k2"), F.sum(n * base * base).alias("m2_0"), F.sqrt(F.avg(gap * gap)).alias("srmsr"))
    one = scored.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), (F.avg("resp") - F.avg("p")).alias("d")).agg(F.sum(F.col("n") * F.col("d") * F.col("d")).alias("s1"), F.count(F.lit(1)).alias("k1"))
    persons = scored.agg(F.count_distinct("person_id").alias("n_persons"))
    t = pair.join(F.broadcast(one)).join(F.broadcast(persons))
    t = t.select((F.col("s1") + F.col("s2")).alias("m2"), F.greatest(F.col("k1") + F.col("k2") - n_parameters, F.lit(1)).cast("double").alias("df"), "m2_0", F.col("k2").cast("double").alias("df_0"), "srmsr", "n_persons")
    over, over_0 = F.greatest(F.col("m2") - F.col("df"), F.lit(0.0)), F.col("m2_0") - F.col("df_0")
    room = F.greatest(over_0, over, F.lit(0.0))
    ratio, ratio_0 = F.col("m2") / F.col("df"), F.try_divide(F.col("m2_0"), F.col("df_0"))
    return t.select(
        "m2", F.col("df").cast("long").alias("df"), "m2_0", F.col("df_0").cast("long").alias("df_0"),
        F.sqrt(F.greatest(F.try_divide(ratio - 1, F.col("n_persons") - 1), F.lit(0.0))).alias("rmsea"),
        F.when(room <= 0, 1.0).otherwise(F.least(F.greatest(1 - F.try_divide(over, room), F.lit(0.0)), F.lit(1.0))).alias("cfi"),
        F.when(ratio_0 <= 1, 1.0).otherwise(F.try_divide(ratio_0 - ratio, ratio_0 - 1)).alias("tli"), "srmsr",
    )


def deviance_residuals(scored: DataFrame) -> DataFrame:
    """Sign of the raw residual times the root of -2 log-likelihood."""
    raw = F.col("resp") - F.col("p")
    return scored.select("person_id", "item_id", raw.alias("raw"), F.col("z").alias("standard"), (F.signum(raw) * F.sqrt(F.greatest(-2 * F.col("ll"), F.lit(0.0)))).alias("deviance"))


def flag_persons(fit: DataFrame, infit: tuple = (0.7, 1.3), outfit: tuple = (0.7, 1.3), zh: float = -2.0) -> DataFrame:
    """Persons with any statistic outside its band, and which."""
    odd = lambda c, band: (F.col(c) < band[0]) | (F.col(c) > band[1])
    why = F.array_compact(F.array(F.when(odd("infit", infit), "infit"), F.when(odd("outfit", outfit), "outfit"), F.when(F.col("zh") < zh, "zh")))
    return fit.withColumn("flags", F.array_join(why, " ")).where("flags <> ''").select("person_id", "flags")


def flag_pairs(q3: DataFrame, ld: DataFrame, threshold: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """Pairs of items that depend: by the residual correlation, by the chi-square's tail, or both."""
    both = q3.select("item_i", "item_j", "q3").join(ld.select("item_i", "item_j", "chi2"), ["item_i", "item_j"])
    both = both.withColumn("p_value", chi2_sf_column(F.col("chi2"), 1))
    return both.withColumns({"by_q3": F.abs("q3") > threshold, "by_chi2": F.coalesce(F.col("p_value") < alpha, F.lit(False))}).where("by_q3 or by_chi2")


def parameter_dif(reference: DataFrame, focal: DataFrame) -> DataFrame:
    """Items of two calibrations (item_id, a, b, se_a, se_b): the squared differences over their variances, its tail, the shift of b and its class.

    A: not significant at 5 % or a shift under 0.426; B: under 0.638; C: more. Parameters without error are left out.
    """
    f = focal.select("item_id", *[F.col(c).alias(f"f_{c}") for c in ("a", "b", "se_a", "se_b")])
    both = reference.join(f, "item_id")
    term = lambda c: F.pow(F.col(c) - F.col(f"f_{c}"), 2) / (F.pow(F.col(f"se_{c}"), 2) + F.pow(F.col(f"f_se_{c}"), 2))
    usable = lambda c: F.pow(F.col(f"se_{c}"), 2) + F.pow(F.col(f"f_se_{c}"), 2) > 1e-10
    statistic = F.when(usable("a"), term("a")).otherwise(0.0) + F.when(usable("b"), term("b")).otherwise(0.0)
    df = usable("a").cast("int") + usable("b").cast("int")
    tail = F.when(df == 2, chi2_sf_column(statistic, 2)).otherwise(chi2_sf_column(statistic, 1))
    t = both.select("item_id", statistic.alias("statistic"), tail.alias("p_value"), F.abs(F.col("b") - F.col("f_b")).alias("effect"))
    return t.withColumn("class", F.when((F.col("p_value") > 0.05) | (F.col("effect") < 0.426), "A").when(F.col("effect") < 0.638, "B").otherwise("C"))


def flag_items(dif: DataFrame, alpha: float = 0.05, least: float = 0.0, classes: str = "BC") -> DataFrame:
    return dif.where((F.col("p_value") <= alpha) & (F.abs("effect") >= least) & F.instr(F.lit(classes), F.col("class")).cast("boolean"))


def over_grid(reference: DataFrame, focal: DataFrame, low: float = -4.0, high: float = 4.0, n: int = 81) -> DataFrame:
    """Both groups' curves of each item over a grid, with normal weights that sum to 1."""
    t = (F.lit(low) + (high - low) * F.col("id") / (n - 1)).alias("theta")
    grid = reference.sparkSession.range(n).select(t).withColumn("w", F.exp(-0.5 * F.col("theta") * F.col("theta")))
    whole = grid.agg(F.sum("w").alias("whole"))
    grid = grid.join(F.broadcast(whole)).select("theta", (F.col("w") / F.col("whole")).alias("w"))
    both = reference.select("item_id", "a", "b").join(focal.select("item_id", F.col("a").alias("fa"), F.col("b").alias("fb")), "item_id")
    th = F.col("theta")
    curves = both.join(F.broadcast(grid)).withColumns({"pr": irf.p_2pl(th, F.col("a"), F.col("b")), "pf": irf.p_2pl(th, F.col("fa"), F.col("fb"))})
    return curves.withColumns({"ir": F.col("a") * F.col("a") * F.col("pr") * (1 - F.col("pr")), "if": F.col("fa") * F.col("fa") * F.col("pf") * (1 - F.col("pf"))})


def effect_sizes(curves: DataFrame) -> DataFrame:
    """By item: signed and unsigned difference of expected scores, and the root mean square one, plain and weighted."""
    d = F.col("pf") - F.col("pr")
    return curves.groupBy("item_id").agg(F.sum(F.col("w") * d).alias("signed"), F.sum(F.col("w") * F.abs(d)).alias("unsigned"), F.sqrt(F.avg(d * d)).alias("rmsd"), F.sqrt(F.sum(F.col("w") * d * d)).alias("weighted_rmsd"))


def test_functioning(curves: DataFrame) -> DataFrame:
    """Of the whole test: weighted signed, unsigned and root mean square difference of expected scores."""
    t = curves.groupBy("theta", "w").agg((F.sum("pf") - F.sum("pr")).alias("d"))
    return t.agg(F.sum(F.col("w") * F.col("d")).alias("signed"), F.sum(F.col("w") * F.abs("d")).alias("unsigned"), F.sqrt(F.sum(F.col("w") * F.col("d") * F.col("d"))).alias("rms"))


def trapezoid(rows: DataFrame, keys: list[str], value: Column, step: float, low: float, high: float) -> DataFrame:
    ends = F.when((F.abs(F.col("theta") - low) < 1e-9) | (F.abs(F.col("theta") - high) < 1e-9), 0.5).otherwise(1.0)
    return rows.groupBy(*keys).agg((F.sum(ends * value) * step).alias("area"), F.max(value).alias("largest"))


def response_functioning(curves: DataFrame, low: float = -4.0, high: float = 4.0, n: int = 81) -> DataFrame:
    """By item: the area between both groups' information, and the largest difference."""
    return trapezoid(curves, ["item_id"], F.abs(F.col("ir") - F.col("if")), (high - low) / (n - 1), low, high)


def residual_pairs(group_stats: DataFrame) -> DataFrame:
    """From item_id, g, n, mrr, vr: by item and pair of groups the squared difference of mean residuals over its variance."""
    h = group_stats.select("item_id", *[F.col(c).alias(f"h_{c}") for c in ("g", "n", "mrr", "vr")])
    both = group_stats.join(h, "item_id").where("g < h_g")
    d = F.col("mrr") - F.col("h_mrr")
    return both.select("item_id", F.col("g").alias("g1"), F.col("h_g").alias("g2"), d.alias("difference"), F.try_divide(d * d, F.col("vr") / F.col("n") + F.col("h_vr") / F.col("h_n")).alias("statistic"))


def residual_groups(scored: DataFrame, groups: DataFrame) -> DataFrame:
    r = F.col("resp") - F.col("p")
    return scored.join(groups, "person_id").groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mrr"), F.avg(r * r).alias("msr"), F.var_samp(r).alias("vr"))


def kernel_smooth(scored: DataFrame, n_grid: int = 21, margin: float = 0.0) -> DataFrame:
    """Gaussian smooth of each item's answers over ability, with a standard error by the effective number of answers.

    Persons of one ability and answer are added up before they meet the grid, so the grid multiplies values, not persons.
    """
    people = scored.select("person_id", "theta").distinct()
    size = people.agg(F.min("theta").alias("lo"), F.max("theta").alias("hi"), (1.06 * F.stddev_pop("theta") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"))
    size = size.withColumn("h", F.when(F.col("h") > 0, F.col("h")).otherwise(F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))))
    step = (F.col("hi") - F.col("lo")) * (1 + 2 * margin) / (n_grid - 1)
    grid = size.join(scored.sparkSession.range(n_grid)).select("h", F.col("id").cast("int").alias("point"), (F.col("lo") - margin * (F.col("hi") - F.col("lo")) + F.col("id") * step).alias("at"))
    cells = scored.groupBy("item_id", "theta").agg(F.count(F.lit(1)).alias("n"), F.sum("resp").alias("s"), F.sum(F.col("resp") * F.col("resp")).alias("ss"))
    u = (F.col("at") - F.col("theta")) / F.col("h")
    rows = cells.join(F.broadcast(grid)).withColumn("w", F.exp(-0.5 * u * u))
    g = rows.groupBy("item_id", "point").agg(F.max("at").alias("theta"), F.sum(F.col("w") * F.col("n")).alias("k"), F.sum(F.col("w") * F.col("s")).alias("ks"), F.sum(F.col("w") * F.col("ss")).alias("kss"), F.sum(F.col("w") * F.col("w") * F.col("n")).alias("kk"))
    mean = F.try_divide(F.col("ks"), F.col("k"))
    var = F.greatest(F.try_divide(F.col("kss"), F.col("k")) - mean * mean, F.lit(0.0))
    return g.select("item_id", "point", "theta", mean.alias("smooth"), F.sqrt(var * F.try_divide(F.col("kk"), F.col("k") * F.col("k"))).alias("se"))


def empirical_rmsea(bins: DataFrame) -> DataFrame:
    """By item the root mean square gap of observed and expected means over bins."""
    return bins.groupBy("item_id").agg(F.sqrt(F.avg(F.pow(F.col("observed") - F.col("expected"), 2))).alias("rmsea"))


def pair_moments(responses: DataFrame) -> DataFrame:
    """By pair of items over persons with both: n, covariance (over n), correlation, and the log odds ratio with half a person in each cell.

    The covariances are the edges' moments of a Gaussian network, the log odds those of an Ising network.
    """
    r = responses.where("resp is not null")
    i, j = (r.select("person_id", F.col("item_id").alias(f"item_{k}"), F.col("resp").alias(f"x{k}")) for k in "ij")
    p = i.join(j, "person_id").where("item_i < item_j")
    cell = lambda a, b: (F.count(F.when((F.col("xi") == a) & (F.col("xj") == b), 1)) + 0.5).alias(f"c{a}{b}")
    g = p.groupBy("item_i", "item_j").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("xi", "xj").alias("cov"), F.corr("xi", "xj").alias("corr"), *[cell(a, b) for a in (0, 1) for b in (0, 1)])
    return g.select("item_i", "item_j", "n", "cov", F.coalesce("corr", F.lit(0.0)).alias("corr"), F.log(F.col("c11") * F.col("c00") / (F.col("c10") * F.col("c01"))).alias("log_odds"))


def partial_correlations(moments: DataFrame, variances: DataFrame) -> DataFrame:
    """Edges of a Gaussian network: partial correlations from the inverse of the items' covariance matrix. moments as pair_moments gives them."""
    import numpy as np

    names = sorted(r["item_id"] for r in variances.select("item_id").limit(5_001).collect())
    if len(names) > 5_000:
        raise ValueError("more than 5,000 items")
    at = {k: i for i, k in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for r in variances.collect():
        c[at[r["item_id"]], at[r["item_id"]]] = r["variance"]
    for r in moments.select("item_i", "item_j", "cov").collect():
        c[at[r[0]], at[r[1]]] = c[at[r[1]], at[r[0]]] = r[2]
    k = np.linalg.pinv(c)
    d = np.sqrt(np.diag(k))
    rows = [(names[i], names[j], float(-k[i, j] / (d[i] * d[j]))) for i in range(len(names)) for j in range(i + 1, len(names))]
    return moments.sparkSession.createDataFrame(rows, "item_i int, item_j int, partial double")


def likelihood_ratio_steps(models: DataFrame, rank_by: str = "n_parameters") -> DataFrame:
    """model, log_likelihood, n_parameters: each model against the next smaller one, by twice the gain."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy(rank_by)  # a handful of models
    gain = 2 * (F.col("log_likelihood") - F.lag("log_likelihood").over(order))
    more = F.col("n_parameters") - F.lag("n_parameters").over(order)
    return models.withColumns({"chi2": F.greatest(gain, F.lit(0.0)), "df": more}).withColumn("p_value", F.when(F.col("df") == 1, chi2_sf_column(F.col("chi2"), 1)).when(F.col("df") % 2 == 0, chi2_sf_even(F.col("chi2"), F.col("df"))))


def chi2_sf_even(x: Column, df: Column) -> Column:
    """The tail for an even number of degrees: a finite sum."""
    terms = F.aggregate(F.sequence(F.lit(0), (df / 2 - 1).cast("int")), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), lambda s, k: F.struct((s["s"] + s["t"]).alias("s"), (s["t"] * x / 2 / (k + 1)).alias("t")), lambda s: s["s"])
    return F.exp(-x / 2) * terms
