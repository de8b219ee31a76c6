"""Diagnostic classification: which of a few attributes a person has mastered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mastery_posterior(responses: DataFrame, needed: dict[int, int], n_attributes: int, slip: float, guess: float, every: bool = True) -> DataFrame:
    """person_id, most likely profile (bits, the least of equal ones), its posterior, and each attribute's probability.

    needed: the bits of the attributes that an item asks for; with `every` all of them, else any. Profiles are equally
    likely at first. Each distinct pattern of responses is worked out once, as a fold inside its row.
    """
    masks = F.create_map(*[F.lit(v) for kv in needed.items() for v in kv])
    persons = responses.where("resp is not null").groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "resp"))).alias("pattern"))

    def ll(profile):
        def add(s, cell):
            has = profile.bitwiseAND(cell["mask"])
            able = has == cell["mask"] if every else has > 0
            p = F.when(able, 1 - slip).otherwise(guess)
            return s + F.log(F.when(cell["resp"] == 1, p).otherwise(1 - p))

        return F.aggregate("cells", F.lit(0.0), add)

    df = persons.select("pattern").distinct().withColumn("_m", masks)
    df = df.withColumn("cells", F.transform("pattern", lambda c: F.struct(c["resp"].alias("resp"), F.element_at(F.col("_m"), c["item_id"]).alias("mask")))).drop("_m")
    df = df.withColumn("ll", F.transform(F.array(*[F.lit(i) for i in range(1 << n_attributes)]), ll)).drop("cells")
    df = df.withColumn("top", F.array_max("ll")).withColumn("u", F.transform("ll", lambda x: F.exp(x - F.col("top")))).withColumn("z", F.aggregate("u", F.lit(0.0), lambda s, x: s + x))
    df = df.select("pattern", F.transform("u", lambda x: x / F.col("z")).alias("post")).withColumn("best", F.array_max("post"))
    marginals = [sum((F.element_at("post", i + 1) for i in range(1 << n_attributes) if i >> k & 1), F.lit(0.0)).alias(f"p{k}") for k in range(n_attributes)]
    first = F.array_position(F.transform("post", lambda x: x >= F.col("best") - 1e-9), True) - 1  # equal but for rounding
    df = df.select("pattern", first.cast("int").alias("profile"), F.col("best").alias("posterior"), *marginals)
    return persons.join(df, "pattern").drop("pattern")
