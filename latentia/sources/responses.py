"""Long response tables (person_id, item_id, resp) and an item bank, from wide data and from the sample star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResponseError(ValueError):
    """The response data break a rule of the model."""


def from_wide(df: DataFrame, person: str, items: list[str]) -> DataFrame:
    """Wide to long; item_id counts from 1 in the order given; negative codes and NaN become null."""
    cols = F.array(*[F.struct(F.lit(i).alias("item_id"), F.col(c).cast("double").alias("resp")) for i, c in enumerate(items, 1)])
    long = df.select(F.col(person).alias("person_id"), F.explode(cols).alias("x")).select("person_id", "x.*")
    return long.withColumn("resp", F.when((F.col("resp") >= 0) & ~F.isnan("resp"), F.col("resp").cast("int")))


def to_wide(responses: DataFrame, items: list[int]) -> DataFrame:
    return responses.groupBy("person_id").pivot("item_id", items).agg(F.first("resp"))


def validate(responses: DataFrame, n_categories: int = 2) -> DataFrame:
    """Raises if a response is not in 0 .. n_categories - 1."""
    bad = responses.where((F.col("resp") < 0) | (F.col("resp") >= n_categories)).limit(1).collect()
    if bad:
        raise ResponseError(f"response {bad[0]['resp']} of person {bad[0]['person_id']} is outside 0..{n_categories - 1}")
    return responses


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")


def dichotomous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as persons, line numbers as items; right if the quantity passes a hurdle that rises with the item."""
    hit = F.max(F.when(F.col("l_quantity") > 15 + 4 * F.col("l_linenumber"), 1).otherwise(0)).cast("int").alias("resp")
    return order_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("person_id"), F.col("l_linenumber").cast("int").alias("item_id")).agg(hit)


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys with categories 0 to 3."""
    level = F.least(F.floor(F.min("l_quantity") / 12.6), F.lit(3)).cast("int").alias("resp")
    return order_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("person_id"), F.col("l_linenumber").cast("int").alias("item_id")).agg(level)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, skill, ts, event_id, resp."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("person_id"), F.col("event_type").alias("skill"), "ts", "event_id", F.when(F.col("value") > 35, 1).otherwise(0).alias("resp"))


def bank(spark: SparkSession, n_items: int = 7, shift: float = 0.0) -> DataFrame:
    """A fixed bank: a rises from 0.8 by 0.2, b from -1.0 by 0.5, c is 0.1."""
    i = F.col("id").cast("double")
    return spark.range(1, n_items + 1).select(F.col("id").cast("int").alias("item_id"), (0.6 + 0.2 * i).alias("a"), (-1.5 + 0.5 * i + shift).alias("b"), F.lit(0.1).alias("c"))
