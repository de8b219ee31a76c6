"""Document fingerprints by winnowing, as DataFrame expressions.

Words are hashed; sliding hashes of k words come from joining hashes of half as
many (k is a power of two); in every window of w of them the least is chosen,
the rightmost of equal ones, by a number that holds 33 bits of the hash and 30
of the place (a string has under 2**30 words). The choices of all windows,
repeats once, are the fingerprint: places, counted from 0, and full hashes. A
run of w + k - 1 words that two texts share is always met by a choice of each.

A character of a script that is written without spaces is a word of its own.

Defined results: a null or empty text, or one of white space, has an empty
fingerprint; with fewer than k words the whole sequence is the one hash; with
fewer than w hashes the one window is all of them; two empty fingerprints are
alike (1), an empty and another are not (0); repeated rows are kept each; with
one document the next document is itself; ids are numbers, strings, dates or
times; null ids come last; further columns are left out, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from latentia.llm.tables import read, volume

K, W = 4, 4
WHITE = r"[\x20\x09-\x0D]+"
#: Scripts written without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: Most ranges of ids; beyond so many times `each` bytes the ranges grow, and their sort spills.
MAX_RANGES = 1 << 15


def spaced(text: Column) -> Column:
    """The text with spaces around each character of an unspaced script; a text of one byte a character has none."""
    return F.when((F.octet_length(text) > F.length(text)) & F.rlike(text, F.lit(UNSPACED)), F.regexp_replace(text, UNSPACED, " $0 ")).otherwise(text)


def add_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds `out`, an array of structs (pos, hash). Each step is a projection of its own, so none is worked out twice."""
    if k & (k - 1) or w & (w - 1):
        raise ValueError("k and w must be powers of two")
    t, a = f"_{out}_t", f"_{out}_a"
    words = F.filter(F.split(spaced(F.coalesce(F.col(text), F.lit(""))), WHITE), lambda x: x != "")
    df = df.withColumn(t, words).withColumn(a, F.transform(t, lambda x: F.xxhash64(x))).drop(t)
    whole = F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.col(a))))
    df = df.withColumn(f"{a}w", F.when(F.size(a) < k, whole))
    step = 1
    while step < k:
        df = df.withColumn(a, F.when(F.size(a) > step, F.zip_with(F.slice(a, 1, F.size(a) - step), F.slice(a, step + 1, F.size(a) - step), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>")))
        step *= 2
    df = df.withColumn(a, F.coalesce(F.col(f"{a}w"), F.col(a))).drop(f"{a}w")
    m = f"_{out}_m"
    top = 1 << 30
    df = df.withColumn(m, F.transform(a, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit((1 << 33) - 1)), 30).bitwiseOR(F.lit(top - 1) - i.cast("long"))))
    df = df.withColumn(f"{m}w", F.when(F.size(m) < w, F.when(F.size(m) > 0, F.array(F.array_min(m))).otherwise(F.col(m))))
    step = 1
    while step < w:
        df = df.withColumn(m, F.when(F.size(m) > step, F.zip_with(F.slice(m, 1, F.size(m) - step), F.slice(m, step + 1, F.size(m) - step), lambda x, y: F.least(x, y))).otherwise(F.col(m)))
        step *= 2
    df = df.withColumn(m, F.array_distinct(F.coalesce(F.col(f"{m}w"), F.col(m)))).drop(f"{m}w")
    place = lambda x: (F.lit(top - 1) - x.bitwiseAND(F.lit(top - 1))).cast("int")
    return df.withColumn(out, F.transform(m, lambda x: F.struct(place(x).alias("pos"), F.get(a, place(x)).alias("hash")))).drop(a, m)


def digest(fingerprint: str) -> Column:
    """128 bits of a fingerprint, its places included, as hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(F.col(fingerprint))), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), F.col(fingerprint))), 16, "0")))


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two arrays of distinct hashes; both empty: 1."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every).cast("double")


def range_bounds(rows: DataFrame, n: int) -> list:
    """At most n - 1 ids that cut the ids into ranges of about equally many rows: quantiles of numbers, else of the ids with the least hashes."""
    if n < 2:
        return []
    kind = rows.schema["id"].dataType
    if isinstance(kind, NumericType):
        got = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
    else:
        drawn = sorted(r[0] for r in rows.where("id is not null").select("id").orderBy(F.xxhash64("id")).limit(20 * n).collect())
        got = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    return sorted(set(got or []))


def with_next(docs: DataFrame, id_col: str, text_col: str, each: int = 24 << 20) -> DataFrame:
    """id, text and next_text of the following document by descending id (of the last: the first).

    Documents are dealt to ranges of ids by bounds from a quantile sketch; the first document of a range is also
    sent to the range before it, which needs it after its last. So texts are shuffled once, and no task has all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    _, size = volume(rows)
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each)), MAX_RANGES)
    bounds = range_bounds(rows, n)
    part = F.lit(0)
    if bounds:
        rows = rows.withColumn("_bounds", F.from_json(F.lit(json.dumps(bounds, default=str)), f"array<{dict(rows.dtypes)['id']}>"))
        strides = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
        # the number of bounds under the id, by halving
        under = F.aggregate(strides, F.lit(0), lambda at, x: F.when(F.get("_bounds", at + x - 1) < F.col("id"), at + x).otherwise(at))
        part = F.when(F.col("id").isNull(), 0).otherwise(under + 1)
    rows = rows.withColumn("part", part.cast("int")).drop("_bounds")
    tops = {r[0]: r[1] for r in rows.groupBy("part").agg(F.max("id")).collect()}
    order = sorted(tops, reverse=True)
    ahead = {p: order[i - 1] for i, p in enumerate(order)}  # the part before, whose last document is followed by the first of p
    edge = spark.createDataFrame([(p, tops[p], ahead[p]) for p in order] or [(-1, None, -1)], f"part int, top {dict(rows.dtypes)['id']}, ahead int")
    joined = rows.join(F.broadcast(edge), "part")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("edge"))
    copies = F.when(F.col("id").eqNullSafe(F.col("top")), F.array(own, F.struct(F.col("ahead").alias("part"), F.lit(1).alias("edge")))).otherwise(F.array(own))
    dealt = joined.select("id", "text", F.explode(copies).alias("p")).select("id", "text", "p.part", "p.edge").repartition(n, "part")
    ordered = Window.partitionBy("part").orderBy("edge", F.desc_nulls_last("id"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(ordered)).where("edge = 0").select("id", "text", "next_text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint (digests), near_edited, near_next."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    for text, name in (("text", "fp"), ("edited", "fe"), ("next_text", "fn")):
        rows = add_fingerprint(rows, text, name)
        rows = rows.withColumn(f"{name}_set", F.array_distinct(F.col(f"{name}.hash")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        digest("fp").alias("fingerprint"),
        digest("fe").alias("edited_fingerprint"),
        likeness("fp_set", "fe_set").alias("near_edited"),
        likeness("fp_set", "fn_set").alias("near_next"),
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read(spark, sf_dir, "documents"))
