"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is a number of blocks of equally many words. Blocks go to sources by
the highest quotients target / (2k + 1), then to a source's shards in the same
way by their words, which gives every shard a whole quota. In a shard the
documents stand in an order drawn from the seed; the quota is full rounds of
the shard and one run of blocks from a seeded block on, around the end. So
only the two documents at the ends of the run are taken in part, and the mix
has exactly the apportioned blocks.

Only ids, sources and sizes are shuffled. Shards hold at most about 1/20,000
of all rows, so none grows into one task's limits, and a hot source has many.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own and comes last; a null id is kept and ordered as null;
repeated rows count each; an empty table gives no rows; equal sizes, ids and
names are fine; further columns of whatever name are left out of the plan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.llm.groups import small
from latentia.llm.tables import keep, read, small_batches

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 100_000
MAX_SHARDS = 20_000
SHARD_WORDS = 250_000
SHARD_ROWS = 2_000


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share of all words, dealt by weight; none above cap times its size, the excess dealt again by weight."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def sainte_lague(weights: list[float], seats: int, limits: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients w / (2k + 1); equal quotients go to the earlier entry; none gets more than its limit.

    Found by halving the interval of the divisor, so the number of seats costs nothing.
    """
    w = np.array(weights, float)
    top = np.array(limits if limits is not None else [seats] * len(w), dtype=float)
    top = np.where(w > 0, top, 0)
    seats = int(min(seats, top.sum()))
    if not seats:
        return [0] * len(w)

    def given(divisor: float) -> np.ndarray:  # quotients above the divisor
        return np.minimum(np.maximum(np.ceil((w / divisor - 1) / 2), 0), top)

    low, high = 0.0, float(w.max()) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if given(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    out = given(high)
    while out.sum() < seats:  # quotients equal to the last divisor, within rounding
        q = np.where(out < top, w / (2 * out + 1), -1.0)
        out[int(np.argmax(q))] += 1
    return [int(x) for x in out]


def source_order(name: str | None) -> tuple:
    return (name is None, name or "")


def plan_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, cap: float, block_words: int, seed: int) -> DataFrame:
    """doc id, th (hash of the text), size, source_size, target, full (whole copies) and run_from, run_to (words taken once more, counted from 0; may wrap: a second interval run2_from, run2_to)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    base = keep(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("source"), size.alias("size")))
    spark = docs.sparkSession
    rows = base.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: source_order(r[0]))
    sizes = [int(r[1]) for r in rows]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    total_words, total_rows = sum(sizes), sum(int(r[2]) for r in rows)
    each_words, each_rows = max(SHARD_WORDS, total_words // MAX_SHARDS), max(SHARD_ROWS, total_rows // MAX_SHARDS)
    shards = [max(1, -(-int(r[1]) // each_words), -(-int(r[2]) // each_rows)) for r in rows]
    known = spark.createDataFrame(
        [(i, r[0], int(r[1]), float(t), n) for i, (r, t, n) in enumerate(zip(rows, aims, shards, strict=True))],
        "s int, source string, source_size long, target double, n_shards int",
    )
    dealt = base.join(F.broadcast(known), base["source"].eqNullSafe(known["source"])).select(
        "id", "th", "size", "s", F.pmod(F.xxhash64(F.col("id"), F.col("th"), F.lit(seed), F.lit("shard")), F.col("n_shards")).cast("int").alias("shard")
    )
    held = {(r[0], r[1]): int(r[2]) for r in dealt.groupBy("s", "shard").agg(F.sum("size")).collect()}
    blocks = math.floor(sum(aims) / block_words + 0.5)
    by_source = sainte_lague(aims, blocks, [int(cap * s) // block_words for s in sizes])
    plan, of_source = [], {}
    for k in sorted(held):
        of_source.setdefault(k[0], []).append(k)
    for i, quota in enumerate(by_source):
        own = of_source.get(i, [])
        quotas = sainte_lague([held[k] for k in own], quota, [int(cap * held[k]) // block_words for k in own])
        plan += [(i, k[1], held[k], sizes[i], aims[i], q) for k, q in zip(own, quotas, strict=True)]
    quotas = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0.0, 0)], "s int, shard int, shard_words long, source_size long, target double, quota long")
    joined = dealt.join(F.broadcast(quotas), ["s", "shard"]).withColumn("h", F.xxhash64(F.col("id"), F.col("th"), F.lit(seed), F.lit("order")))

    def lay(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("id", "ascending"), ("th", "ascending"), ("size", "ascending")])
        n = table["size"].to_numpy().astype(np.int64)
        words, quota = table["shard_words"][0].as_py(), table["quota"][0].as_py()
        taken = quota * block_words
        full = taken // words if words else 0
        run = taken - full * words
        key = (table["s"][0].as_py() * 1_000_003 + table["shard"][0].as_py()) * 7_919 + seed
        start = int(np.random.default_rng(key & (2**63 - 1)).integers(0, max(1, -(-words // block_words)))) * block_words
        at = np.cumsum(n) - n
        first = np.clip(np.array([at, at + n]), start, min(start + run, words)) - at
        rest = np.clip(np.array([at, at + n]), 0, max(0, start + run - words)) - at
        cols = {"id": table["id"], "th": table["th"], "size": n, "source_size": table["source_size"], "target": table["target"], "full": np.full(len(n), full, np.int32)}
        for name, v in (("run_from", first[0]), ("run_to", first[1]), ("run2_from", rest[0]), ("run2_to", rest[1])):
            cols[name] = np.clip(v, 0, n)
        return pa.table({k: (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v)) for k, v in cols.items()})

    kind = dict(base.dtypes)["id"]
    return joined.groupBy("s", "shard").applyInArrow(lay, f"id {kind}, th long, size long, source_size long, target double, full int, run_from long, run_to long, run2_from long, run2_to long")


def taken_words() -> Column:
    return F.col("full") * F.col("size") + F.col("run_to") - F.col("run_from") + F.col("run2_to") - F.col("run2_from")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 32, seed: int = 20) -> DataFrame:
    """Per document: id, size, source_size, target of its source, taken (words, repeats counted)."""
    return plan_mix(docs, id_col, text_col, source_col, weights, share, cap, block_words, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", taken_words().alias("taken"))


def cut_words(text: str, start: int, end: int) -> str:
    """The text from its word `start` up to before word `end`, inner white space as it was."""
    import re

    places = [m.span() for m in re.finditer(WORD, text)]
    return text[places[start][0] : places[end - 1][1]] if end > start else ""


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each whole copy and for each part of a text that is taken.

    Of rows that are equal in id and text one stands for all, as often as the mix takes them together; different texts
    may have one id, or none. n_chars, where there is such a column, is the new text's.
    """
    small_batches(docs.sparkSession)
    args = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0, "block_words": 32, "seed": 20} | options
    plan = plan_mix(docs, id_col, text_col, source_col, **args)

    @F.pandas_udf("string")
    def cut(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, a, b) for t, a, b in zip(text, start, end, strict=True)], dtype=object)

    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("full"))
    part = lambda a, b: F.when(F.col(b) > F.col(a), F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    pieces = F.concat(F.when(F.col("size") > 0, whole).otherwise(none), F.coalesce(part("run_from", "run_to"), none), F.coalesce(part("run2_from", "run2_to"), none))
    spans = plan.select("id", "th", "size", F.explode(pieces).alias("_p")).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"), ((F.col("_p.a") == 0) & (F.col("_p.b") == F.col("size"))).alias("_whole"))
    spans = keep(spans)
    cols = docs.columns
    same = lambda d, t: d[id_col].eqNullSafe(t["_id"]) & (F.xxhash64(d[text_col]) == t["_th"])
    repeated = small(keep(plan.select(F.col("id").alias("_id"), F.col("th").alias("_th")).groupBy("_id", "_th").count().where("count > 1").drop("count")))
    once = docs.join(repeated, same(docs, repeated), "left_anti").select(*cols)
    several = docs.join(repeated, same(docs, repeated), "left_semi").select(*cols, F.xxhash64(text_col).alias("_one")).dropDuplicates([id_col, "_one"]).drop("_one")
    either = once.unionByName(several)
    rows = either.join(spans, same(either, spans))
    whole_rows = rows.where("_whole").select(*cols)
    cut_rows = rows.where("not _whole").withColumn(text_col, cut(text_col, "_a", "_b"))
    if "n_chars" in cols:
        cut_rows = cut_rows.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"]))
    return whole_rows.unionByName(cut_rows.select(*cols))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
