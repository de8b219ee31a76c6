"""Quality rules: robust multivariate outliers by language and source.

Every document has a vector of transformed text statistics. Each language and
source has a minimum-covariance-determinant estimate of its own: from three
starts (medians with the least spread, medians with the deviations from them,
mean and covariance of all rows), the nearest share of the group's rows gives
the next centre and covariance until it gives the same again, and the end of
least determinant is taken. A step is two aggregates over the narrow table of
vectors, for all groups and starts at once, and the estimates are a table, so
neither a group's size nor the number of groups has a limit. Every covariance
has the square of a least spread added, so that groups where a statistic never
varies have an estimate too. A document is rejected whose Mahalanobis distance
is beyond what a further normal row passes with probability `tail`, the error
of an estimate from few rows included.

A group whose nearest share would have fewer than 7 rows, two more than there
are statistics, goes by its language's estimate, and a language like that by
the one of all rows; `judged_by` says which it was.

Defined results: a null or empty text has all statistics 0 and fails the base
rule; rows that fail it take no part in estimates and have no distance; null
languages and sources are groups of their own; groups without spread reject
only what is beyond the least spread; repeated rows count each; an empty table
gives no rows; ids may be null; further columns are left out. Distances are
ranked exactly in groups of fewer than 10,000 rows, to one in 10,000 above.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.llm.groups import small
from latentia.llm.kernels import WordHasher, buffers, grams, row_of, white_table
from latentia.llm.tables import forget, keep, read, small_batches
from latentia.llm.token_count import worker_store

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8


def repeat_words(h: np.ndarray, starts: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each row, its words that lie in a window of k words found twice or more in the row."""
    n_rows = len(starts) - 1
    g, rows = grams(h, starts, k)
    if not len(g):
        return np.zeros(n_rows, np.int64)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    place = starts[rows] + np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    order = np.lexsort((g, rows))
    same = (g[order][1:] == g[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(g), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    change = np.zeros(len(h) + 1, np.int32)
    np.add.at(change, place[twice], 1)
    np.add.at(change, place[twice] + k, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(row_of(starts)[covered], minlength=n_rows)


def dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.encode().split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def statistics(column: pa.Array, hasher: WordHasher) -> dict[str, np.ndarray]:
    raw, offsets = buffers(column)
    h, _, starts = hasher.words(raw, offsets)
    inside = ~white_table()[raw] & ((raw & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return total[offsets[1:]] - total[offsets[:-1]]

    return {
        "n_words": np.diff(starts),
        "word_chars": per_row(inside),
        "n_symbols": per_row(symbol[raw]),
        "n_dup_lines": np.array([dup_lines(t) for t in column.to_pylist()], np.int64),
        "n_repeat_words": repeat_words(h, starts),
    }


def vectors(s: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics: size, word length, and the shares of symbols, repeated lines and repeated words, on log scales."""
    n = np.maximum(s["n_words"].astype(float), 1.0)
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            np.log(np.maximum(s["word_chars"] / n, 0.5)),
            np.log(s["n_symbols"] / n + 0.02),
            np.log(s["n_dup_lines"] * 10 / n + 0.05),
            np.log(s["n_repeat_words"] / n + 0.05),
        ]
    )


P = 5
#: The least spread that a coordinate is given, as a standard deviation; added to every covariance, so that none is singular.
FLOOR = np.array([0.3, 0.1, 0.5, 0.5, 0.5])
#: Rows that the nearest share of a group must have for an estimate of its own.
LEAST_NEAREST = P + 2
#: Ranks of distances are exact for groups of fewer rows, and right to one in so many above.
RANKS = 10_000
STARTS = 3
MAX_STEPS = 200
LEVELS = ("group", "lang", "all")


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, t = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 1000):
        term *= t / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-t + a * math.log(t) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for k in range(1, 10_000):
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        d, c = 1 / (1 + even * d), 1 + even / c
        out *= d * c
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d, c = 1 / (1 + odd * d), 1 + odd / c
        out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def cut_distance(tail: float, p: int, h: float) -> float:
    """The squared distance that a further normal row passes with probability `tail`, where centre and covariance are from h rows."""
    m, k = h - 1, h - p  # Hotelling's: p m / k times an F value of p and k degrees, and the centre's own error
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        f = math.exp(mid)
        low, high = (mid, high) if beta_tail(k / (k + p * f), k / 2, p / 2) > tail else (low, mid)
    return p * m / k * math.exp(high) * (1 + 1 / h)


def consistency(alpha: float, p: int) -> float:
    """The factor that makes the covariance of the nearest share alpha right for normal data."""
    return alpha / chi2_cdf(chi2_quantile(alpha, p), p + 2) if alpha < 1 else 1.0


def estimates(sums: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, inverse covariances and log determinants from rows of count, sums and products."""
    n = np.maximum(sums[:, :1], 1)
    centre = sums[:, 1 : 1 + P] / n
    cov = np.zeros((len(sums), P, P))
    upper = np.triu_indices(P)
    cov[:, upper[0], upper[1]] = sums[:, 1 + P :] / n
    cov = cov + np.triu(cov, 1).transpose(0, 2, 1) - centre[:, :, None] * centre[:, None, :]
    cov = cov * factor + np.diag(FLOOR**2)
    return centre, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


XS = [f"x{i}" for i in range(P)]
MODEL = "g string, start int, n long, centre array<double>, inverse array<double>, logdet double"


def summed() -> list[Column]:
    products = [(F.col(XS[i]) * F.col(XS[j])) for i, j in zip(*np.triu_indices(P), strict=True)]
    return [F.count(F.lit(1)).cast("double").alias("m0"), *[F.sum(x).alias(f"m{k}") for k, x in enumerate([*map(F.col, XS), *products], 1)]]


def with_estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Models from rows g, start, n, m0, m1, ..."""
    width = 1 + P + P * (P + 1) // 2

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = np.column_stack([batch.column(f"m{k}").to_numpy() for k in range(width)])
                centre, inverse, logdet = estimates(m, factor)
                lists = lambda x: pa.array(x.reshape(len(m), -1).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("g", "start", "n")} | {"centre": lists(centre), "inverse": lists(inverse), "logdet": pa.array(logdet)})

    return sums.select("g", "start", "n", *[f"m{k}" for k in range(width)]).mapInArrow(run, MODEL)


def distance() -> Column:
    d = [F.col(XS[i]) - F.col("centre")[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def first_models(rows: DataFrame, alpha: float) -> DataFrame:
    """Three starts for each group: the medians with the floor as spread, the medians with the deviations from them, all rows' mean and covariance."""
    medians = keep(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5, RANKS).alias(f"c{x}") for x in XS]))
    deviations = rows.join(small(medians), "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"c{x}")), 0.5, RANKS).alias(f"s{x}") for x in XS])
    both = medians.join(deviations, "g")
    centre = F.array(*[F.col(f"c{x}").cast("double") for x in XS])
    diagonal = lambda v: F.array(*[1 / v[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    floors = [F.lit(float((f + 0.5) ** 2)) for f in FLOOR]
    spreads = [F.lit(float(f * f)) + 2.198 * F.col(f"s{x}") * F.col(f"s{x}") for f, x in zip(FLOOR, XS, strict=True)]  # 1.4826 squared
    out = both.select("g", F.lit(0).alias("start"), "n", centre.alias("centre"), diagonal(floors).alias("inverse"), F.lit(None).cast("double").alias("logdet"))
    out = out.union(both.select("g", F.lit(1), "n", centre, diagonal(spreads), F.lit(None).cast("double")))
    plain = with_estimates(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *summed()).withColumn("start", F.lit(2)), 1.0)
    return out.union(plain.withColumn("logdet", F.lit(None).cast("double")))


def fit_groups(rows: DataFrame, alpha: float) -> DataFrame:
    """g, n, centre, inverse: of each group the estimate of least determinant that concentration from the starts ends in.

    rows: g, x0, ...; each step takes the share alpha of a group's rows that is nearest, and ends where it takes the same.
    """
    factor = consistency(alpha, P)
    models, done = keep(first_models(rows, alpha)), None
    for _ in range(MAX_STEPS):
        seen = rows.join(small(models), "g").select("g", "start", "n", "logdet", *XS, distance().alias("d"))
        cuts = seen.groupBy("g", "start").agg(F.percentile_approx("d", alpha, RANKS).alias("cut"))
        nearest = seen.join(small(keep(cuts)), ["g", "start"]).where("d <= cut")
        sums = nearest.groupBy("g", "start", "n").agg(F.max("logdet").alias("was"), *summed())
        after = with_estimates(sums, factor).join(models.select("g", "start", F.col("logdet").alias("was")), ["g", "start"])
        after = keep(after.withColumn("rests", F.coalesce(F.abs(F.col("logdet") - F.col("was")) < 1e-9, F.lit(False))))
        ended = after.where("rests").drop("rests", "was")
        done = ended if done is None else done.unionByName(ended)
        forget(models)
        models = after.where("not rests").drop("rests", "was")
        if not models.limit(1).count():
            break
    done = done.unionByName(models)
    return done.groupBy("g").agg(F.min_by(F.struct("n", "centre", "inverse"), F.struct("logdet", "start")).alias("m")).select("g", "m.*")


def group_key(level: str, *names: str) -> Column:
    """One string for a level and its names, which may be null or hold any character."""
    return F.concat(F.lit(level), *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in names])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", alpha: float = 0.75, tail: float = 1e-7) -> DataFrame:
    """Per document: id, the five statistics, base_failed, distance (Mahalanobis, squared), judged_by (group, lang or all: whose estimate), outlier and kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"))
    id_kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        store = worker_store()
        if "words as they are" not in store:
            store["words as they are"] = WordHasher(False)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                s = statistics(part.column("_text"), store["words as they are"])
                x = vectors(s)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("id", "lang", "source")} | {k: pa.array(v.astype(np.int64)) for k, v in s.items()} | {f"x{j}": pa.array(x[:, j]) for j in range(P)})

    table = rows.mapInArrow(run, f"id {id_kind}, lang string, source string, " + ", ".join(f"{s} long" for s in STATS) + ", " + ", ".join(f"{x} double" for x in XS))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    keys = {"group": group_key("g", "lang", "source"), "lang": group_key("l", "lang"), "all": F.lit("a")}
    table = keep(table.withColumns({"base_failed": failed, **{f"_{k}": v for k, v in keys.items()}}))
    sound = table.where("not base_failed")
    # a group whose nearest rows are too few goes by its language, and that by all
    least = math.ceil(LEAST_NEAREST / alpha)
    counted = sound.groupBy("_group", "_lang", "_all").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(counted.groupBy("_lang").agg(F.sum("n").alias("n_lang")), "_lang")
    level = F.when(F.col("n") >= least, 0).when(F.col("n_lang") >= least, 1).otherwise(2)
    named = keep(counted.select("_group", F.element_at(F.array("_group", "_lang", "_all"), level + 1).alias("g"), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1).alias("judged_by")))
    named_small = small(named)
    wanted = small(keep(named.select("g").distinct()))
    # every row takes part in the estimates that some group goes by
    each = [sound.select(F.col(f"_{k}").alias("g"), *XS).join(wanted, "g", "left_semi") for k in LEVELS]
    models = fit_groups(keep(each[0].unionAll(each[1]).unionAll(each[2])), alpha)

    @F.pandas_udf("double")
    def limit(n: pd.Series) -> pd.Series:
        held = {k: cut_distance(tail, P, max(math.floor(alpha * k), P + 1)) for k in n.unique().tolist()}
        return n.map(held)

    models = small(keep(models.withColumn("_limit", limit("n")).withColumnRenamed("n", "_n")))
    joined = table.join(named_small, "_group", "left").join(models, "g", "left")
    out = joined.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    out = out.withColumn("outlier", F.coalesce(F.col("distance") > F.col("_limit"), F.lit(False))).withColumn("judged_by", F.when(~F.col("base_failed"), F.col("judged_by")))
    return out.select(F.col("id").alias(id_col), *STATS, "base_failed", "distance", "judged_by", "outlier", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
