"""Adaptive testing: the next item of each person by information at the present ability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentia.functions import irf


def next_items(sessions: DataFrame, bank: DataFrame, top: int = 1) -> DataFrame:
    """sessions: person_id, theta, used (array of item ids). The `top` unused items of most information; equal ones by id.

    The bank travels inside each row as an array, so a person costs no join rows.
    """
    items = bank.agg(F.array_sort(F.collect_list(F.struct("item_id", "a", "b"))).alias("bank"))
    df = sessions.join(F.broadcast(items))
    free = F.filter("bank", lambda i: ~F.array_contains("used", i["item_id"]))
    ranked = F.transform(free, lambda i: F.struct((-irf.information_2pl(F.col("theta"), i["a"], i["b"])).alias("minus"), i["item_id"].alias("item_id")))
    df = df.withColumn("ranked", F.slice(F.array_sort(ranked), 1, top))
    return df.select("person_id", F.posexplode("ranked").alias("pos", "x")).select("person_id", (F.col("pos") + 1).alias("place"), F.col("x.item_id").alias("item_id"), (-F.col("x.minus")).alias("information"))


def exposure(choices: DataFrame) -> DataFrame:
    """Share of persons that got each item."""
    n = choices.agg(F.countDistinct("person_id").alias("n"))
    return choices.groupBy("item_id").agg(F.count(F.lit(1)).alias("times")).join(F.broadcast(n)).select("item_id", "times", (F.col("times") / F.col("n")).alias("rate"))


def strata(bank: DataFrame, n: int) -> DataFrame:
    return bank.withColumn("stratum", F.ntile(n).over(Window.orderBy("a", "item_id")))
