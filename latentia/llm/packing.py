"""Best-fit packing of documents into sequences by a configuration linear program.

The program has a variable for each way to fill a sequence with piece lengths
and covers the histogram of lengths. It is solved by multiplicative weights:
lengths not yet covered weigh more, and a knapsack dynamic program finds the
filling of most weight. Its variables are rounded to whole multiples; the pieces
that rounding leaves over are filled by the same knapsack, the longest first.
Only the histogram (as many counts as a sequence has tokens) reaches the
driver. Pieces find their places by their rank among those of their length,
from counts by shard, so no length's pieces ever meet in one task.

Defined results: a null or empty text is its end token alone; an empty table
gives no rows; repeated rows and ids are packed each; ids may be null; further
columns are left out. A special token's string inside a text is that token.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentia.llm.tables import keep, read, small_batches
from latentia.llm.token_count import Splitter, byte_alphabet, worker_store


#: The exponent by which a long piece is worth more than its share of a sequence, so that short ones are left to fill gaps.
LONG_FIRST = 1.05


class Encoder:
    """Ids of whole texts by the vocabulary of a byte-level BPE file.

    Its merges are in the order of its ids, so the same vocabulary as ranks gives the same ids; that encoder is
    several times as fast. Texts with special strings, or with characters whose classes differ between Unicode
    versions, go to the file's own tokenizer.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.splitter = Splitter(path)
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        ranks = {bytes(byte[c] for c in k): i for k, i in vocab.items() if k not in self.splitter.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if any(x in text for x in self.splitter.special) or (not text.isascii() and self.splitter.odd(text)):
            return self.splitter.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def best_filling(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack of at most so many pieces of each length: counts by index of the filling that is worth most."""
    best = np.zeros(capacity + 1)
    items = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        room, times = min(int(count), capacity // length), 1
        while room > 0:  # 1, 2, 4, ... pieces at once
            times = min(times, room)
            size = length * times
            with_it = best[: capacity + 1 - size] + values[i] * times
            better = with_it > best[size:]
            np.copyto(best[size:], with_it, where=better)
            items.append((i, times, size, better))
            room, times = room - times, times * 2
    out: dict[int, int] = {}
    at = capacity
    for i, times, size, better in reversed(items):
        if at >= size and better[at - size]:
            out[i] = out.get(i, 0) + times
            at -= size
    return out


def worth(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The weight of a length that is not covered at all: its share of a sequence, long pieces a little more."""
    return (lengths / capacity) ** LONG_FIRST


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, eta: float = 0.1) -> dict[tuple, float]:
    """Fillings (pairs of length and copies) and how often each is used, by multiplicative weights.

    A length's weight falls by exp(-eta * covered share). Each step takes the filling of most weight as often as
    covers its scarcest length, so there are at most as many steps as lengths and every length ends covered.
    """
    cover, used, base = np.zeros(len(lengths)), {}, worth(lengths, capacity)
    while True:
        live = np.flatnonzero(cover < 1 - 1e-9)
        if not len(live):
            return used
        free = np.maximum(np.floor(counts[live] * (1 - cover[live]) + 1e-9), 1)
        filling = best_filling(base[live] * np.exp(-eta * cover[live]), lengths[live], free, capacity)
        k, a = live[list(filling)], np.array(list(filling.values()), float)
        share = (1 - cover[k]) * counts[k] / a
        cover[k] += share.min() * a / counts[k]
        cover[k[share.argmin()]] = 1.0
        key = tuple(sorted(zip(lengths[k].tolist(), a.astype(int).tolist(), strict=True), reverse=True))
        used[key] = used.get(key, 0.0) + float(share.min())


def filled(filling: tuple) -> int:
    return sum(length * copies for length, copies in filling)


def plan_sequences(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple, int]], int]:
    """Fillings (pairs of length and copies, longest first) with whole multiplicities that use every piece once, and how many come from the program.

    The program's fillings that leave no room for any piece are rounded up as far as pieces last, fullest first.
    What rounding leaves over is filled by the same knapsack around its longest piece, each filling as often as its
    pieces last; so no step hangs on the number of pieces, only on the number of lengths.
    """
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    plan: list[tuple[tuple, int]] = []

    def take(filling: tuple, times: int) -> None:
        times = min(times, *(left.get(k, 0) // a for k, a in filling))
        if times > 0:
            plan.append((filling, times))
            for k, a in filling:
                left[k] -= a * times
                if not left[k]:
                    del left[k]

    lengths = np.array(sorted(left))
    used = solve_lp(lengths, np.array([left[k] for k in lengths.tolist()], float), capacity)
    for filling, x in sorted(used.items(), key=lambda e: (-filled(e[0]), -e[1], e[0])):
        if filled(filling) + min(left, default=capacity) > capacity:
            take(filling, math.ceil(x - 1e-6))
    by_program = len(plan)
    while left:
        longest = max(left)
        rest = np.array(sorted(k for k in left if k <= capacity - longest), int)
        counts = np.array([left[k] - (k == longest) for k in rest.tolist()])
        beside = best_filling(worth(rest, capacity), rest, counts, capacity - longest)
        filling = {longest: 1}
        for i, a in beside.items():
            filling[int(rest[i])] = filling.get(int(rest[i]), 0) + a
        take(tuple(sorted(filling.items(), reverse=True)), left[longest])
    return plan, by_program


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        store = worker_store()
        key = ("token ids", path)
        if key not in store:
            store[key] = Encoder(path)
        encoder = store[key]
        for batch in batches:
            column, n = batch.column(1), batch.num_rows
            at, span = 0, 256
            while at < n:
                out: list[tuple] = []
                for i, text in enumerate(column.slice(at, span).to_pylist()):
                    data = memoryview(np.array([*encoder.ids(text), end_id], "<u4").tobytes())
                    total = len(data) // 4
                    start, length, k = 0, total % capacity or min(total, capacity), 0
                    while start < total:
                        out.append((at + i, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                        start, length, k = start + length, capacity, k + 1
                which, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0).take(pa.array(which)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc)})
                at += span

    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, plan: list[tuple[tuple, int]], id_col: str, n_shards: int) -> DataFrame:
    """Adds sequence_id and offset."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for length, copies in filling:
            slots.setdefault(length, []).append((taken.get(length, 0), sequence, copies, offset))
            taken[length] = taken.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    table = {k: np.array(v, np.int64) for k, v in slots.items()}
    held = pieces.sparkSession.sparkContext.broadcast(table)
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64(id_col, "piece"), F.lit(n_shards)).cast("int"))
    counts = sharded.groupBy("_shard", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_shard", "length", F.coalesce(before, F.lit(0)).alias("base")).groupBy("_shard").agg(F.collect_list("length").alias("lengths"), F.collect_list("base").alias("bases"))

    def lay(group: pa.Table, base: pa.Table) -> pa.Table:
        first = dict(zip(base["lengths"][0].as_py(), base["bases"][0].as_py(), strict=True))
        group = group.sort_by([("length", "ascending"), ("ids_crc32", "ascending"), (id_col, "ascending"), ("piece", "ascending")])
        length = group["length"].to_numpy()
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        values, starts = np.unique(length, return_index=True)
        for v, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(length)], strict=True):
            rank = np.arange(b - a) + first[v]
            t = held.value[v]
            k = np.searchsorted(t[:, 0], rank, "right") - 1
            nth = rank - t[k, 0]
            seq[a:b], off[a:b] = t[k, 1] + nth // t[k, 2], t[k, 3] + nth % t[k, 2] * v
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        return pa.table({n: group[n] for n in names} | {"sequence_id": seq, "offset": off})

    kind = dict(pieces.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return sharded.groupBy("_shard").cogroup(bases.groupBy("_shard")).applyInArrow(lay, schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = keep(token_pieces(docs, path, id_col, text_col, capacity, end_id))
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    shards = max(1, -(-sum(histogram.values()) // 100_000))
    shards = max(shards, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values()) // 2_000))
    return place(pieces, plan_sequences(histogram, capacity)[0], id_col, max(1, shards))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
