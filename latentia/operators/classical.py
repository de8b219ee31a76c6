"""Classical item statistics, reliability, missing data and recoding. A null response is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 where a side does not vary."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300)))).otherwise(0.0)


def correlate(df: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    g = df.groupBy(*keys).agg(F.count(fx * fy).cast("double").alias("n"), F.sum(fx).alias("sx"), F.sum(fy).alias("sy"), F.sum(fx * fx).alias("sxx"), F.sum(fy * fy).alias("syy"), F.sum(fx * fy).alias("sxy"))
    return g.select(*keys, F.col("n").cast("long").alias("n"), pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias(out))


def itemstats(responses: DataFrame) -> DataFrame:
    """n, mean, sd (0 for one response), least, greatest, population skewness and excess kurtosis (0 unless n > 2 and the item varies)."""
    x = F.col("resp").cast("double")
    g = responses.groupBy("item_id").agg(F.count("resp").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.min("resp").alias("least"), F.max("resp").alias("greatest"), F.var_pop(x).alias("m2"), F.avg(x * x * x).alias("s3"), F.avg(x * x * x * x).alias("s4"), F.avg(x * x).alias("s2"))
    m = F.col("mean")
    m3 = F.col("s3") - 3 * m * F.col("s2") + 2 * m * m * m
    m4 = F.col("s4") - 4 * m * F.col("s3") + 6 * m * m * F.col("s2") - 3 * m * m * m * m
    varied = (F.col("n") > 2) & (F.col("m2") > 0)
    return g.select("item_id", "n", "mean", "sd", "least", "greatest", F.when(varied, F.try_divide(m3, F.pow("m2", F.lit(1.5)))).otherwise(0.0).alias("skewness"), F.when(varied, F.try_divide(m4, F.col("m2") * F.col("m2")) - 3).otherwise(0.0).alias("kurtosis"))


def with_total(responses: DataFrame) -> DataFrame:
    return responses.withColumn("total", F.sum("resp").over(Window.partitionBy("person_id")))


def item_rest(responses: DataFrame) -> DataFrame:
    """Difficulty and the correlation of each item with the total and with the rest of the total."""
    t = with_total(responses).where("resp is not null").withColumn("rest", F.col("total") - F.col("resp"))
    a = correlate(t, ["item_id"], "resp", "total", "item_total")
    b = correlate(t, ["item_id"], "resp", "rest", "item_rest")
    d = t.groupBy("item_id").agg(F.avg("resp").alias("difficulty"))
    return a.join(b.drop("n"), "item_id").join(d, "item_id")


def alpha(responses: DataFrame) -> DataFrame:
    """Cronbach's alpha over persons with a response."""
    items = responses.groupBy("item_id").agg(F.var_samp("resp").alias("v")).agg(F.count("v").alias("n_items"), F.sum("v").alias("sum_var"))
    total = responses.groupBy("person_id").agg(F.sum("resp").alias("t")).agg(F.var_samp("t").alias("total_var"), F.count("t").alias("n_persons"))
    both = items.join(F.broadcast(total))
    j = F.col("n_items")
    return both.select("n_items", "n_persons", F.when((j < 2) | (F.col("total_var") <= 0), 0.0).otherwise(F.try_divide(j, j - 1) * (1 - F.try_divide(F.col("sum_var"), F.col("total_var")))).alias("alpha"))


def alpha_if_deleted(responses: DataFrame) -> DataFrame:
    """Alpha without each item; what a person lacks of it counts 0 in the others' total. One pass: the total's variance less the item's share."""
    persons = responses.groupBy("person_id").agg(F.sum("resp").alias("t"))
    stats = persons.agg(F.count("t").cast("double").alias("n"), F.sum("t").cast("double").alias("st"), F.sum(F.col("t") * F.col("t")).cast("double").alias("stt"))
    items = with_total(responses).where("resp is not null").groupBy("item_id").agg(F.var_samp("resp").alias("v"), F.sum("resp").cast("double").alias("sx"), F.sum(F.col("resp") * F.col("resp")).cast("double").alias("sxx"), F.sum(F.col("resp") * F.col("total")).cast("double").alias("sxt"))
    both = items.join(F.broadcast(stats)).join(F.broadcast(items.agg(F.sum("v").alias("all_v"), F.count("v").alias("j"))))
    s = F.col("st") - F.col("sx")
    ss = F.col("stt") - 2 * F.col("sxt") + F.col("sxx")
    var = (ss - s * s / F.col("n")) / (F.col("n") - 1)
    k = F.col("j") - 1
    return both.select("item_id", F.when((k < 2) | (var <= 0), 0.0).otherwise(F.try_divide(k, k - 1) * (1 - F.try_divide(F.col("all_v") - F.col("v"), var))).alias("alpha_if_deleted"))


def missing(responses: DataFrame, n_items: int, n_persons: int) -> DataFrame:
    """Observed cells and missing rates in all, by item and by person count, in one grouping-sets pass."""
    g = responses.where("resp is not null").groupingSets([[], ["item_id"]], "item_id").agg(F.count(F.lit(1)).alias("observed"), F.grouping("item_id").alias("all_items"))
    size = F.when(F.col("all_items") == 1, F.lit(n_items * n_persons)).otherwise(F.lit(n_persons))
    return g.select("item_id", "observed", (1 - F.col("observed") / size).alias("missing_rate"))


def pairwise_counts(responses: DataFrame) -> DataFrame:
    """How many persons have both items."""
    r = responses.where("resp is not null").select("person_id", "item_id")
    s = r.select("person_id", F.col("item_id").alias("item_j"))
    return r.join(s, "person_id").where("item_id <= item_j").groupBy(F.col("item_id").alias("item_i"), "item_j").agg(F.count(F.lit(1)).alias("n"))


def impute_values(responses: DataFrame) -> DataFrame:
    """Per item the rounded mean (half to even) and the least mode."""
    return responses.where("resp is not null").groupBy("item_id").agg(F.bround(F.avg("resp")).cast("int").alias("mean_value"), F.mode("resp", True).alias("mode_value"))


def patterns(responses: DataFrame) -> DataFrame:
    """Distinct response patterns (item:resp in item order) with frequency and score."""
    p = responses.where("resp is not null").groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "resp"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["resp"].cast("string"))), " ")
    return p.select(text.alias("pattern"), F.aggregate("p", F.lit(0), lambda s, x: s + x["resp"]).alias("score")).groupBy("pattern").agg(F.count(F.lit(1)).alias("freq"), F.max("score").alias("score"))


def recode(responses: DataFrame, cutoff: int) -> DataFrame:
    """Dichotomises at the cutoff; missing stays missing."""
    return responses.withColumn("resp", F.when(F.col("resp") >= cutoff, 1).when(F.col("resp").isNotNull(), 0))


def key_to_binary(responses: DataFrame, key: dict[int, int]) -> DataFrame:
    """1 where the answer is the item's key; a missing answer is wrong."""
    pairs = F.create_map(*[F.lit(x) for kv in key.items() for x in kv])
    return responses.withColumn("resp", F.coalesce((F.col("resp") == F.element_at(pairs, F.col("item_id"))).cast("int"), F.lit(0)))


def reverse(responses: DataFrame, top: int, items: list[int]) -> DataFrame:
    return responses.withColumn("resp", F.when(F.col("item_id").isin(items), top - F.col("resp")).otherwise(F.col("resp")))


def reliable_change(scores: DataFrame, reliability: float) -> DataFrame:
    """person_id, pre, post to the change index and its class."""
    sd = scores.agg(F.stddev_samp("pre").alias("sd"))
    both = scores.join(F.broadcast(sd))
    sem = F.col("sd") * (1 - reliability) ** 0.5
    rci = F.try_divide(F.col("post") - F.col("pre"), sem * 2**0.5)
    return both.select("person_id", rci.alias("rci"), F.when(rci > 1.96, "improved").when(rci < -1.96, "declined").otherwise("unchanged").alias("change"))
