"""Near-duplicate documents: SuperMinHash signatures, banding, verification on whole sets, union-find groups.

A document's set is its distinct shingles of five words, A-Z lower-cased; with
fewer words the whole sequence is the one shingle. Documents with equal sets
are one node, so copies are never paired. Each shingle visits the registers of
a signature in an order of its own (a step through all of them from a start,
both drawn from the shingle), with rank plus a fresh fraction as its value;
since ranks grow, a signature is done as soon as all registers are filled.
Nodes that agree in all registers of a band share a bucket; see groups.py for
how pairs in buckets are settled. Links are confirmed on the full sets.

Defined results: a null or empty text, or one of white space, has an empty set
and is linked with nothing; repeated rows and rows that share an id are in one
group if their sets are near; of a group the row of the least id is kept, and
of different sets under this id the one of the least key; ids may be null, are
treated the same way and then stand last; an empty
table gives no rows; further columns are left out of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.llm.groups import Test, link_groups, shared_members, small, with_earlier
from latentia.llm.kernels import WordHasher, U, buffers, distinct, grams, mix
from latentia.llm.tables import keep, read, small_batches
from latentia.llm.token_count import worker_store

REGISTERS = 128
#: Bands are so wide at most that a pair at the threshold shares none with this probability.
MISSED = 1e-6
SHINGLE = 5
#: Words of a set's parity sketch.
PARITIES = [f"q{i}" for i in range(8)]
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row and the rows' starts."""
    h, _, starts = hasher.words(raw, offsets)
    n = np.diff(starts)
    parts = [grams(h, starts, k)]
    for short in range(1, k):
        if (n == short).any():
            g, rows = grams(h, starts, short)
            ok = n[rows] == short
            parts.append((g[ok], rows[ok]))
    values, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(rows, kind="stable")
    return distinct(values[order], rows[order], len(offsets) - 1)


def signatures(values: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash registers of each row's set, rank above fraction in 64 bits; m is a power of two."""
    n_rows = len(starts) - 1
    out = np.full(n_rows * m, FREE)
    rows = np.repeat(np.arange(n_rows), np.diff(starts))
    seed = mix(values ^ U(0x5851F42D4C957F2D))
    start, step = seed & U(m - 1), ((seed >> U(20)) & U(m - 1)) | U(1)
    live = np.arange(len(values))
    for rank in range(m):
        if not len(live):
            break
        fraction = mix(values[live] + U((rank * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> U(8)
        register = (start[live] + step[live] * U(rank)) & U(m - 1)
        np.minimum.at(out, rows[live] * m + register.astype(np.int64), (U(rank) << U(56)) | fraction)
        at = np.unique(rows[live])
        open_row = np.zeros(n_rows, bool)
        open_row[at] = (out.reshape(n_rows, m)[at] == FREE).any(1)
        live = live[open_row[rows[live]]]
    return out.reshape(n_rows, m)


def band_rows(threshold: int, m: int = REGISTERS) -> int:
    """Registers of a band for a threshold in per cent."""
    fits = [r for r in range(1, m + 1) if (1 - (threshold / 100) ** r) ** (m // r) <= MISSED]
    return max(fits, default=1)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    n = registers.shape[1] // rows
    out = np.zeros((len(registers), n), U)
    for i in range(rows):
        out = mix(out * U(0xD6E8FEB86659FD93) + registers[:, i : n * rows : rows])
    return mix(out + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def parities(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row, whether an even or odd number of its shingles falls on each of 512 bits, as 8 words.

    Two sketches differ in at most as many bits as there are shingles in one set only.
    """
    n_bits = 64 * len(PARITIES)
    n = len(starts) - 1
    at = np.repeat(np.arange(n), np.diff(starts)) * n_bits + (mix(values) % U(n_bits)).astype(np.int64)
    odd = np.bincount(at, minlength=n * n_bits) & 1
    return np.packbits(odd.astype(bool).reshape(n, n_bits), axis=1).view(np.int64)


def may_be_near(threshold: int) -> Callable:
    """A condition on both sides' sizes and parities that every pair of the threshold meets."""

    def condition(a: dict, b: dict) -> np.ndarray:
        differing = sum(np.bitwise_count((a[q] ^ b[q]).view(U)).astype(np.int64) for q in PARITIES)
        return (100 + threshold) * differing <= (100 - threshold) * (a["n_shingles"] + b["n_shingles"])

    return condition


def set_key(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash for each row's whole set."""
    sums = np.r_[U(0), np.cumsum(mix(values * U(0xA0761D6478BD642F) + U(1)), dtype=U)]
    return mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(U) * U(0xE7037ED1A0B428DB))


def signature_table(docs: DataFrame, id_col: str, text_col: str, threshold: int = 85, batch_rows: int = 256) -> DataFrame:
    """id, text_hash, n_shingles, node (the set's key, null if it is empty), buckets (one for each band) and parities of the set."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    wide = band_rows(threshold)

    def run(batches):
        store = worker_store()
        if "words in lower case" not in store:
            store["words in lower case"] = WordHasher(True)
        for batch in batches:
            for i in range(0, batch.num_rows, batch_rows):
                part = batch.slice(i, batch_rows)
                values, starts = shingles(*buffers(part.column("_text")), store["words in lower case"])
                n = np.diff(starts)
                registers = signatures(values, starts)
                keys, bits = bands(registers, wide).view(np.int64), parities(values, starts)
                at = np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]
                node = pa.array(set_key(values, starts).view(np.int64), mask=n == 0)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text_hash": part.column("text_hash"), "n_shingles": pa.array(n.astype(np.int64)), "node": node, "buckets": pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))} | {p: pa.array(bits[:, j]) for j, p in enumerate(PARITIES)})

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, text_hash long, n_shingles long, node long, buckets array<long>, " + ", ".join(f"{p} long" for p in PARITIES))


def set_table(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node and its whole sorted set as bytes, from the documents wanted (id, text_hash, node)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))).select("node", "_text")

    def run(batches):
        store = worker_store()
        if "words in lower case" not in store:
            store["words in lower case"] = WordHasher(True)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                values, starts = shingles(*buffers(part.column("_text")), store["words in lower case"])
                key = set_key(values, starts).view(np.int64)
                ok = key == part.column("node").to_numpy()  # texts of one hash may differ
                yield pa.RecordBatch.from_pydict({"node": pa.array(key[ok]), "set": pa.array([values[a:b].tobytes() for a, b, o in zip(starts[:-1], starts[1:], ok, strict=True) if o], pa.binary())})

    return rows.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def sorted_sets(data: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in data]


def likeness(threshold: int) -> Test:
    """Sorted sets that share enough of their elements: 100 * shared >= threshold * all."""

    def possible(held: list[np.ndarray], i: int, js: np.ndarray) -> np.ndarray:
        n, m = len(held[i]), np.array([len(held[j]) for j in js.tolist()])
        return 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)

    def exact(held: list[np.ndarray], i: int, j: int) -> bool:
        x, y = sorted((held[i], held[j]), key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        shared = int((y[at] == x).sum())
        return 100 * shared >= threshold * (len(x) + len(y) - shared)

    return Test(sorted_sets, possible, exact)


def judged(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """Per document: id, text_hash, n_shingles, component_id (the least id that links lead to), kept (it is that document)."""
    table = keep(signature_table(docs, id_col, text_col, threshold))
    nodes = table.where("node is not null")
    payload = ("n_shingles", *PARITIES)
    traits = nodes.select("node", "buckets", *payload).dropDuplicates(["node"])
    members = keep(shared_members(traits.select(F.explode("buckets").alias("bucket"), "node")))
    members = keep(with_earlier(members, traits.select("node", *payload)))
    some = members.select("node").distinct()
    first_row = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "text_hash"))
    wanted = nodes.groupBy("node").agg(first_row.alias("k")).select("node", "k.id", "k.text_hash").join(some, "node")
    sets = keep(set_table(docs, id_col, text_col, small(keep(wanted))))
    comps, _ = link_groups(members, sets.select("node", F.col("set").alias("data")), likeness(threshold), may_be_near(threshold), payload)
    labelled = table.select("id", "text_hash", "n_shingles", "node").join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = labelled.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "node")).alias("k"))
    out = labelled.join(first, "comp", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("k.id"))
    kept = F.col("node").isNull() | (F.col("k.id").eqNullSafe(F.col("id")) & F.col("k.node").eqNullSafe(F.col("node")))
    return out.select("id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id that links lead to), kept (it is that document)."""
    return judged(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """docs with one document of each group: that of the least id; of rows that are equal in id and set, all stay."""
    gone = judged(docs, id_col, text_col, threshold).where("not kept").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = small(keep(gone))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_hash"]), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
