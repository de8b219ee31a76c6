"""Person scores: expected a posteriori by quadrature over collapsed patterns, plus information."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions import irf
from latentia.functions.special import normal_quadrature


def quadrature(spark: SparkSession, n: int = 21) -> DataFrame:
    x, w = normal_quadrature(n)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w, strict=True))], "q int, node double, w double")


def patterned(responses: DataFrame) -> DataFrame:
    """person_id and pattern (array of item_id, resp in item order); a person whose answers are all missing has an empty one."""
    cell = F.when(F.col("resp").isNotNull(), F.struct("item_id", "resp"))
    return responses.groupBy("person_id").agg(F.array_sort(F.collect_list(cell)).alias("pattern"))


def posterior_moments(patterns: DataFrame, bank: DataFrame, log_p: Callable[[float], Column], n_nodes: int) -> DataFrame:
    """pattern to theta and se: mean and deviation of the posterior under a standard normal prior.

    Cells meet the bank in a join, so it may have any number of items, and each node's log-likelihood is a sum.
    Answers to items outside the bank do not count; without any the prior is left.
    """
    x, w = normal_quadrature(n_nodes)
    cells = patterns.select("pattern", F.explode_outer("pattern").alias("cell")).select("pattern", F.col("cell.item_id").alias("item_id"), F.col("cell.resp").alias("resp"))
    logs = cells.join(bank, "item_id", "left").groupBy("pattern").agg(*[F.coalesce(F.sum(log_p(float(t))), F.lit(0.0)).alias(f"l{k}") for k, t in enumerate(x)])
    df = logs.withColumns({f"l{k}": F.col(f"l{k}") + math.log(v) for k, v in enumerate(w)})
    df = df.withColumn("top", F.greatest(*[f"l{k}" for k in range(n_nodes)])).withColumns({f"l{k}": F.exp(F.col(f"l{k}") - F.col("top")) for k in range(n_nodes)})
    add = lambda f: sum((f(k, float(t)) for k, t in enumerate(x)), F.lit(0.0))
    df = df.withColumn("z", add(lambda k, t: F.col(f"l{k}"))).withColumn("theta", add(lambda k, t: F.col(f"l{k}") * t) / F.col("z"))
    return df.select("pattern", "theta", F.sqrt(add(lambda k, t: F.col(f"l{k}") * (F.lit(t) - F.col("theta")) * (F.lit(t) - F.col("theta"))) / F.col("z")).alias("se"))


def eap(responses: DataFrame, bank: DataFrame, n_nodes: int = 21) -> DataFrame:
    """person_id, theta, se. Persons with the same pattern are scored once; one without answers has the prior's mean and deviation."""
    def log_p(t: float) -> Column:
        p = irf.clip(irf.p_2pl(F.lit(t), F.col("a"), F.col("b")))
        return F.when(F.col("resp") == 1, F.log(p)).when(F.col("resp") == 0, F.log(1 - p))

    persons = patterned(responses)
    scored = posterior_moments(persons.select("pattern").distinct(), bank.select("item_id", "a", "b"), log_p, n_nodes)
    return persons.join(scored, "pattern").select("person_id", "theta", "se")


#: Ends of the scale on which a point estimate is looked for.
BOUNDS = (-6.0, 6.0)


def point_estimates(responses: DataFrame, bank: DataFrame, method: str = "ml", mean: float = 0.0, sd: float = 1.0, steps: int = 50) -> DataFrame:
    """person_id, theta, se under the two-parameter model by ml (maximum likelihood), map (with a normal prior) or wle (weighted likelihood).

    The derivative falls with theta; its zero is found by halving the bounds, for many patterns at once. A pattern without
    a zero inside, as all right under ml, gets the nearer bound; a person without answers the prior's values under map, else null.
    """
    if method not in ("ml", "map", "wle"):
        raise ValueError(f"unknown method {method}")
    persons = patterned(responses)
    cells = persons.select("pattern").distinct().select("pattern", F.explode_outer("pattern").alias("cell")).select("pattern", F.col("cell.item_id").alias("item_id"), F.col("cell.resp").alias("resp"))
    joined = cells.join(bank.select("item_id", "a", "b"), "item_id", "left").where("a is not null or item_id is null")
    rows = joined.groupBy("pattern").agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("item_id", "a", "b", F.col("resp").cast("double").alias("x"))))).alias("c"))
    rows = rows.select("pattern", F.col("c.a").alias("a"), F.col("c.b").alias("b"), F.col("c.x").alias("x"))

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("a").offsets.to_numpy())
            n, j = len(sizes), int(sizes.max()) if len(sizes) else 0
            at = (np.repeat(np.arange(n), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            a, b, x = np.zeros((n, j)), np.zeros((n, j)), np.zeros((n, j))
            for m, name in ((a, "a"), (b, "b"), (x, "x")):
                m[at] = batch.column(name).flatten().to_numpy()  # places without an answer keep slope 0

            def parts(theta):
                p = 1 / (1 + np.exp(-np.clip(a * (theta[:, None] - b), -700, 700)))
                info = (a * a * p * (1 - p)).sum(1)
                slope = (a * (x - p)).sum(1)
                if method == "map":
                    slope = slope - (theta - mean) / sd**2
                elif method == "wle":
                    slope = slope + np.divide((a**3 * p * (1 - p) * (1 - 2 * p)).sum(1), 2 * info, out=np.zeros(n), where=info > 0)
                return slope, info

            low, high = np.full(n, BOUNDS[0]), np.full(n, BOUNDS[1])
            for _ in range(steps):
                mid = (low + high) / 2
                up = parts(mid)[0] > 0
                low, high = np.where(up, mid, low), np.where(up, high, mid)
            theta = (low + high) / 2
            info = parts(theta)[1] + (1 / sd**2 if method == "map" else 0)
            none = (sizes == 0) & (method != "map")
            se = np.divide(1.0, np.sqrt(info), out=np.full(n, np.inf), where=info > 0)
            yield pa.RecordBatch.from_pydict({"pattern": batch.column("pattern"), "theta": pa.array(theta, mask=none), "se": pa.array(se, mask=none)})

    kind = dict(rows.dtypes)["pattern"]
    scored = rows.mapInArrow(run, f"pattern {kind}, theta double, se double")
    return persons.join(scored, "pattern").select("person_id", "theta", "se")


def fscores(responses: DataFrame, bank: DataFrame, method: str = "eap", n_nodes: int = 21) -> DataFrame:
    """person_id, theta, se by eap, map, ml, wle or eapsum (from the sum over all items of the bank)."""
    if method == "eap":
        return eap(responses, bank, n_nodes)
    if method == "eapsum":
        sums = responses.groupBy("person_id").agg(F.coalesce(F.sum("resp"), F.lit(0)).cast("int").alias("score"))
        return sums.join(F.broadcast(eap_by_sum(bank, n_nodes)), "score").select("person_id", "theta", "se")
    return point_estimates(responses, bank, method)


def information_grid(bank: DataFrame, low: float = -4, high: float = 4, n: int = 81) -> DataFrame:
    """theta, information and standard error of the test."""
    grid = bank.sparkSession.range(n).select((F.lit(low) + (high - low) * F.col("id") / (n - 1)).alias("theta"))
    return grid.join(F.broadcast(bank)).groupBy("theta").agg(F.sum(irf.information_2pl(F.col("theta"), F.col("a"), F.col("b"))).alias("information")).withColumn("se", 1 / F.sqrt("information"))


def sum_scores(bank: DataFrame, n_nodes: int = 21) -> DataFrame:
    """Score distribution of the population: the Lord-Wingersky recursion at each node, summed over nodes."""
    spark = bank.sparkSession
    items = F.broadcast(bank.agg(F.array_sort(F.collect_list(F.struct("item_id", "a", "b"))).alias("items")))
    df = quadrature(spark, n_nodes).join(items)

    def step(dist, item):
        p = irf.p_2pl(F.col("node"), item["a"], item["b"])
        stay = F.concat(F.transform(dist, lambda x: x * (1 - p)), F.array(F.lit(0.0)))
        up = F.concat(F.array(F.lit(0.0)), F.transform(dist, lambda x: x * p))
        return F.zip_with(stay, up, lambda x, y: x + y)

    df = df.withColumn("dist", F.aggregate("items", F.array(F.lit(1.0)), step))
    return df.select("w", F.posexplode("dist").alias("score", "p")).groupBy("score").agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def eap_by_sum(bank: DataFrame, n_nodes: int = 21) -> DataFrame:
    """theta and se of each sum score on all items of the bank."""
    items = F.broadcast(bank.agg(F.array_sort(F.collect_list(F.struct("item_id", "a", "b"))).alias("items")))

    def step(dist, item):
        p = irf.p_2pl(F.col("node"), item["a"], item["b"])
        return F.zip_with(F.concat(F.transform(dist, lambda x: x * (1 - p)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(dist, lambda x: x * p)), lambda x, y: x + y)

    df = quadrature(bank.sparkSession, n_nodes).join(items).withColumn("dist", F.aggregate("items", F.array(F.lit(1.0)), step))
    rows = df.select("node", "w", F.posexplode("dist").alias("score", "p")).withColumn("u", F.col("w") * F.col("p"))
    u, t = F.col("u"), F.col("node")
    g = rows.groupBy("score").agg(F.sum(u).alias("z"), F.sum(u * t).alias("m"), F.sum(u * t * t).alias("s"))
    theta = F.col("m") / F.col("z")
    return g.select("score", theta.alias("theta"), F.sqrt(F.greatest(F.col("s") / F.col("z") - theta * theta, F.lit(0.0))).alias("se"))


def characteristic_curve(bank: DataFrame, low: float = -4, high: float = 4, n: int = 81) -> DataFrame:
    """theta, the expected sum score and its standard deviation under the three-parameter bank."""
    grid = bank.sparkSession.range(n).select((F.lit(low) + (high - low) * F.col("id") / (n - 1)).alias("theta"))
    p = irf.p_3pl(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    return grid.join(F.broadcast(bank)).groupBy("theta").agg(F.sum(p).alias("expected"), F.sqrt(F.sum(p * (1 - p))).alias("sd"))
