"""Tables, recoding, completing and checking of long responses. A null response, or no row, is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(mapping: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def expand_table(table: DataFrame, freq: str = "freq") -> DataFrame:
    """A row for each person of a frequency table, numbered from 1 in each pattern; frequencies of 0 or null give none."""
    return table.where(F.col(freq) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(freq).cast("int")))).drop(freq)


def recode(responses: DataFrame, mapping: dict[int, int], items: list[int] | None = None) -> DataFrame:
    """Values by the mapping, others as they are; only the items named, if any are."""
    new = F.coalesce(lookup(mapping, F.col("resp")), F.col("resp"))
    return responses.withColumn("resp", new if items is None else F.when(F.col("item_id").isin(items), new).otherwise(F.col("resp")))


def likert_to_int(answers: DataFrame, labels: list[str], column: str = "answer") -> DataFrame:
    """The place of a label, from 0; null for one that is not listed."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(column)).cast("int")
    return answers.withColumn("resp", F.when(place > 0, place - 1)).drop(column)


def dichotomise(responses: DataFrame, cutoffs: dict[int, int] | None = None) -> DataFrame:
    """1 at or above the item's cutoff, by default its median."""
    if cutoffs is None:
        medians = responses.groupBy("item_id").agg(F.median("resp").alias("cut"))
        return responses.join(F.broadcast(medians), "item_id").withColumn("resp", (F.col("resp") >= F.col("cut")).cast("int")).drop("cut")
    return responses.withColumn("resp", (F.col("resp") >= lookup(cutoffs, F.col("item_id"))).cast("int"))


def complete_rows(responses: DataFrame, n_items: int) -> DataFrame:
    """The responses of persons who answered all items."""
    whole = responses.groupBy("person_id").agg(F.count("resp").alias("n")).where(F.col("n") == n_items).select("person_id")
    return responses.join(whole, "person_id", "left_semi")


def completed(responses: DataFrame, items: DataFrame, method: str = "mean", seed: int = 0) -> DataFrame:
    """A row for each person and item; missing ones by the item's rounded mean, its least mode, or a draw from its observed answers.

    Draws come from a hash of person, item and seed, so a rerun gives the same.
    """
    seen = responses.where("resp is not null")
    values = seen.groupBy("item_id").agg(F.bround(F.avg("resp")).cast("int").alias("mean"), F.mode("resp", True).alias("mode"))
    if method == "random":
        counts = seen.groupBy("item_id", "resp").agg(F.count(F.lit(1)).alias("n")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("resp", "n"))).alias("cs"))
        values = counts.select("item_id", "cs", F.aggregate("cs", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("total"))
    cells = responses.select("person_id").distinct().join(F.broadcast(items.select("item_id"))).join(seen.select("person_id", "item_id", "resp"), ["person_id", "item_id"], "left").join(F.broadcast(values), "item_id", "left")
    if method == "random":
        at = F.pmod(F.xxhash64("person_id", "item_id", F.lit(seed)), F.col("total"))
        state = F.struct(at.alias("left"), F.lit(None).cast("int").alias("found"))
        walk = F.aggregate("cs", state, lambda s, c: F.struct((s["left"] - c["n"]).alias("left"), F.when(s["found"].isNull() & (s["left"] < c["n"]), c["resp"]).otherwise(s["found"]).alias("found")))
        return cells.select("person_id", "item_id", F.coalesce("resp", walk["found"]).alias("resp"), F.col("resp").isNull().alias("imputed"))
    return cells.select("person_id", "item_id", F.coalesce("resp", F.col(method)).alias("resp"), F.col("resp").isNull().alias("imputed"))


def check_patterns(responses: DataFrame, n_items: int, top: int) -> DataFrame:
    """Per person: answers given, rate missing, and whether all are the lowest or the highest category."""
    g = responses.groupBy("person_id").agg(F.count("resp").alias("n"), F.max("resp").alias("high"), F.min("resp").alias("low"))
    return g.select("person_id", "n", (1 - F.col("n") / n_items).alias("missing_rate"), F.coalesce(F.col("high") == 0, F.lit(False)).alias("all_low"), F.coalesce(F.col("low") == top, F.lit(False)).alias("all_high"))


def missing_by(responses: DataFrame, n_items: int) -> DataFrame:
    """Persons by their number of missing answers, and items that all persons answered, in one row each."""
    p = responses.groupBy("person_id").agg((n_items - F.count("resp")).alias("n_missing"))
    return p.groupBy("n_missing").agg(F.count(F.lit(1)).alias("persons"))


def collapse_with_groups(responses: DataFrame, groups: DataFrame) -> DataFrame:
    """Patterns by group: items and answers, frequency and the first person."""
    p = responses.where("resp is not null").groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "resp"))).alias("p")).join(groups, "person_id")
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["resp"].cast("string"))), " ")
    return p.groupBy("g", text.alias("pattern")).agg(F.count(F.lit(1)).alias("freq"), F.min("person_id").alias("first"))


def collapse_table(wide: DataFrame, items: list[str]) -> DataFrame:
    """Distinct rows of a wide table with their frequency, ascending with nulls last; nulls are equal to each other."""
    return wide.groupBy(*items).agg(F.count(F.lit(1)).alias("freq")).orderBy(*[F.col(c).asc_nulls_last() for c in items])


def weighted_sum(collapsed: DataFrame, values: DataFrame) -> DataFrame:
    """The frequency-weighted sum of values by pattern."""
    return collapsed.join(values, "pattern").agg(F.sum(F.col("freq") * F.col("value")).alias("total"))


def item_statistics(responses: DataFrame, n_persons: DataFrame) -> DataFrame:
    """n, missing answers and their share, and the answers' frequencies as a sorted array."""
    counts = responses.where("resp is not null").groupBy("item_id", "resp").agg(F.count(F.lit(1)).alias("k"))
    g = counts.groupBy("item_id").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct("resp", "k"))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["resp"].cast("string"), x["k"].cast("string"))), " ")
    return g.join(F.broadcast(n_persons)).select("item_id", "n", (F.col("persons") - F.col("n")).alias("n_missing"), ((F.col("persons") - F.col("n")) / F.col("persons")).alias("pct_missing"), text.alias("frequencies"))


def clinical_significance(scores: DataFrame, reliability: float, cutoff: float, z: float = 1.96) -> DataFrame:
    """Reliable change and the side of a cutoff: recovered, improved, unchanged or deteriorated."""
    both = scores.join(F.broadcast(scores.agg(F.stddev_samp("pre").alias("sd"))))
    change = F.try_divide(F.col("post") - F.col("pre"), F.col("sd") * (2 * (1 - reliability)) ** 0.5)
    crossed = (F.col("pre") < cutoff) & (F.col("post") >= cutoff)
    return both.select("person_id", change.alias("rci"), F.when((change > z) & crossed, "recovered").when(change > z, "improved").when(change < -z, "deteriorated").otherwise("unchanged").alias("outcome"))


def change_with_errors(scores: DataFrame) -> DataFrame:
    """The change index from the standard errors of both scores (pre, post, se_pre, se_post)."""
    return scores.select("person_id", F.try_divide(F.col("post") - F.col("pre"), F.sqrt(F.col("se_pre") * F.col("se_pre") + F.col("se_post") * F.col("se_post"))).alias("rci"))


def score_groups(totals: DataFrame, n_groups: int, score: str = "score") -> DataFrame:
    """Persons in groups of equal size by rank of the score, ties by id.

    Ranks come from counts by score and a rank within a score, so no window holds all persons.
    """
    counts = totals.groupBy(score).agg(F.count(F.lit(1)).alias("k"))
    below = counts.withColumn("below", F.coalesce(F.sum("k").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    n = totals.agg(F.count(F.lit(1)).alias("n_all"))
    ranked = totals.join(F.broadcast(below), score).join(F.broadcast(n)).withColumn("r", F.col("below") + F.row_number().over(Window.partitionBy(score).orderBy("person_id")) - 1)
    return ranked.select("person_id", F.least(F.floor(F.col("r") * n_groups / F.col("n_all")), F.lit(n_groups - 1)).cast("int").alias("grp"))


def grouped_chi2(scored: DataFrame, groups: DataFrame, least: int = 5) -> DataFrame:
    """Chi-square of observed and expected counts over groups of persons, by item."""
    c = scored.join(groups, "person_id").groupBy("item_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("resp").alias("o"), F.sum("p").alias("e"), F.sum("v").alias("v"))
    ok = (F.col("n") >= least) & (F.col("v") > 2.3e-16)
    return c.groupBy("item_id").agg(F.coalesce(F.sum(F.when(ok, (F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("v"))), F.lit(0.0)).alias("chi2"), F.greatest(F.count(F.when(ok, 1)) - 1, F.lit(1)).cast("long").alias("df"))
