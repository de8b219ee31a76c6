"""Linked groups from candidate buckets, without listing the pairs of a bucket.

In each round every bucket that still has nodes of different components names a
few centres, first one, then 64 times as many each time. A centre is compared with
all nodes of its bucket that are in other components; then all its pairs in
this bucket are settled and it leaves the bucket. Confirmed links merge
components, so a bucket whose nodes hang together ends after one round and
costs as many comparisons as it has nodes. Rounds go on until no bucket is
left: every pair that shares a bucket is either confirmed, refuted or inside
one component. There is no limit on buckets or rounds.

Members that nothing of their bucket can be linked with may be left out before the
rounds (possible_members), by exact bounds on sketches.

A pair is never a row: members meet the centres of their buckets as arrays in
parts of limited size, and the centres that are left for a member are verified in
groups of limited size that give confirmed links only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentia.llm.kernels import U, mix
from latentia.llm.tables import forget, keep, parts

#: Most rows of narrow tables that are broadcast; above it Spark joins by shuffling.
SMALL_ROWS = 500_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows it to be small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows of a bucket that are held at once; a larger one is passed on in parts, under its own number.
HELD_ROWS = 200_000


def node_sets(b: np.ndarray, n: np.ndarray, keep_number: bool, sized: bool = False):
    """Batches of bucket, node: each node once in a bucket; without keep_number only buckets of two or more, under a hash of the set of their nodes.

    sized: and size, the number of nodes in the bucket; HELD_ROWS + 1 with keep_number, as others may follow.
    """
    if not len(b):
        return
    order = np.lexsort((n, b))
    b, n = b[order], n[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    b, n = b[new], n[new]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    size = np.diff(np.r_[first, len(b)])
    number = b if keep_number else np.repeat(mix(np.add.reduceat(mix(n.view(U) + U(0x9E3779B97F4A7C15)), first) + size.astype(U)), size).view(np.int64)
    several = np.repeat(size > 1, size) | keep_number
    if several.any():
        out = {"bucket": pa.array(number[several]), "node": pa.array(n[several])}
        if sized:
            out["size"] = pa.array(np.full(len(n), HELD_ROWS + 1) if keep_number else np.repeat(size, size)[several], pa.int64())
        yield pa.RecordBatch.from_pydict(out)


def shared_members(rows: DataFrame) -> DataFrame:
    """bucket, node: the members of buckets with two nodes or more, buckets of the same nodes as one.

    Rows come sorted by bucket. A bucket's new number is a hash of the set of its nodes, so those that hold the same
    nodes, as near copies share many, fall together. Should two sets have one hash, they are one bucket, and no pair is lost.
    """

    def run(batches):
        b = n = np.zeros(0, np.int64)
        in_parts = False  # some of the bucket that is held has been passed on
        for batch in batches:
            b, n = np.r_[b, batch.column(0).to_numpy()], np.r_[n, batch.column(1).to_numpy()]
            if not len(b):
                continue
            last = int(np.searchsorted(b, b[-1]))
            if last and in_parts:
                end = int(np.searchsorted(b, b[0], "right"))
                yield from node_sets(b[:end], n[:end], True)
                b, n, last, in_parts = b[end:], n[end:], last - end, False
            yield from node_sets(b[:last], n[:last], False)
            b, n = b[last:], n[last:]
            if len(b) > HELD_ROWS:
                n = np.unique(n)
                b = b[: len(n)]
                if len(b) > HELD_ROWS // 2:
                    yield from node_sets(b, n, True)
                    b, n, in_parts = b[:1], n[:1], True
        yield from node_sets(b, n, in_parts)

    split = rows.select("bucket", "node").repartition("bucket").sortWithinPartitions("bucket")
    return split.mapInArrow(run, "bucket long, node long").dropDuplicates(["bucket", "node"])


#: Keys that a mapper puts in order at once, and that a part of all keys has, about.
PACKED_KEYS, PART_KEYS = 1_000_000, 2_000_000
#: Bytes of a key, and of it in a part; of PART_KEYS keys one in 2,000 has the bytes of another one, and such buckets are ruled out like others.
KEY_BYTES, LOW_BYTES = 6, 4
#: From one step of length to the next; steps are a byte, and lengths below and above those that it tells are alike.
STEP_RATIO, FIRST_STEP = 1.02, 150


def key_bytes(keys: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each key, as rows of bytes."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :]


def numbers(raw: bytes | memoryview, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def length_steps(chars: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log(np.maximum(chars, 1)) / math.log(STEP_RATIO)) - FIRST_STEP, 0, 255).astype(np.uint8)


def steps_apart(ratio: float) -> int:
    """Most steps between two lengths of which the shorter is `ratio` of the longer at least."""
    return int(-math.log(ratio) / math.log(STEP_RATIO) + 1e-6) + 1


def shared_of_packed(lists: DataFrame, ratio: float | None = None, n_lists: int | None = None) -> DataFrame:
    """shared_members of keys (the key_bytes of each of a node's buckets) and node, without a row for each key, and size, the number of a bucket's nodes or more than HELD_ROWS.

    Keys go in order of size into parts, and a part of each mapper is one row. A part is held as a whole; where a few
    buckets fill it, their nodes are passed on under the buckets' own numbers. With a ratio, lists have chars, and two
    nodes may be linked only if the shorter has that part of the longer's; other buckets are cut where no pair does.
    n_lists: how many lists there are, about; left out, they are counted.
    """
    most_apart = 255 if ratio is None else steps_apart(ratio)
    n_parts = min(1 << 15, parts(lists.sparkSession, 16 * (lists.count() if n_lists is None else n_lists), PART_KEYS))

    def pack(batches):
        def rows(k: np.ndarray, n: np.ndarray, steps: np.ndarray):
            k = k * U(n_parts)  # 48 bits and those of the part's number
            order = np.argsort(k)
            k, n, steps = k[order], n[order], steps[order]
            part = (k >> U(48)).astype(np.int32)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            low = np.ascontiguousarray(((k & U((1 << 48) - 1)) >> U(48 - 8 * LOW_BYTES)).view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES])
            edges = np.r_[first, len(k)].astype(np.int64)
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * w).astype(np.int32)), pa.py_buffer(x)]) for x, w in ((low, LOW_BYTES), (n, 8), (steps, 1))]
            return pa.RecordBatch.from_arrays([pa.array(part[first]), *packed], names=["part", "k", "n", "l"])

        held, size = [], 0
        for batch in batches:
            keys, nodes = batch.column("keys"), batch.column("node").to_numpy()
            offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
            if offsets[-1] == offsets[0]:
                continue
            k = numbers(keys.buffers()[2][int(offsets[0]) : int(offsets[-1])], KEY_BYTES)
            count = np.diff(offsets) // KEY_BYTES
            steps = np.zeros(len(nodes), np.uint8) if ratio is None else length_steps(batch.column("chars").to_numpy())
            held.append((k, np.repeat(nodes, count), np.repeat(steps, count)))
            size += len(k)
            if size >= PACKED_KEYS:
                yield rows(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held, size = [], 0
        if held:
            yield rows(*[np.concatenate(x) for x in zip(*held, strict=True)])

    def shared(held: list, hot: set, last: bool) -> tuple[list, list]:
        """What is left to hold, and batches of members."""
        b, n, steps = (np.concatenate(x) for x in zip(*held, strict=True))
        if last:  # most keys stand once
            order = np.argsort(b)
            b, n, steps = b[order], n[order], steps[order]
            same = b[1:] == b[:-1]
            several = np.r_[same, False] | np.r_[False, same] | np.isin(b, list(hot))
            b, n, steps = b[several], n[several], steps[several]
        order = np.lexsort((n, steps, b))  # a node has one length
        b, n, steps = b[order], n[order], steps[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
        b, n, steps = b[new], n[new], steps[new]
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        hot.update(b[first[np.diff(np.r_[first, len(b)]) > HELD_ROWS]].tolist())
        is_hot = np.isin(b, list(hot))
        out = [*node_sets(mix(b[is_hot].view(U)).view(np.int64), n[is_hot], True, True)]
        b, n, steps = b[~is_hot], n[~is_hot], steps[~is_hot]
        if not last:
            return [(b, n, steps)], out
        cut = np.cumsum((b[1:] != b[:-1]) | (steps[1:].astype(np.int64) - steps[:-1] > most_apart))
        return [], out + [*node_sets(np.r_[0, cut] if len(b) else b, n, False, True)]

    def run(batches):
        held, hot, size, most, now = [], set(), 0, 2 * PART_KEYS, None
        for batch in batches:
            for part, k, n, steps in zip(batch.column("part").to_pylist(), batch.column("k"), batch.column("n"), batch.column("l"), strict=True):
                if part != now and held:
                    yield from shared(held, hot, True)[1]
                    held, hot, size, most = [], set(), 0, 2 * PART_KEYS
                now = part
                held.append(((numbers(k.as_buffer(), LOW_BYTES) | (U(part) << U(8 * LOW_BYTES))).view(np.int64), np.frombuffer(n.as_buffer(), np.int64), np.frombuffer(steps.as_buffer(), np.uint8)))
                size += len(held[-1][0])
                if size > most:
                    held, out = shared(held, hot, False)
                    yield from out
                    size = len(held[0][0])
                    most = max(2 * PART_KEYS, 2 * size)
        if held:
            yield from shared(held, hot, True)[1]

    packed = lists.select("keys", "node", *["chars"] * (ratio is not None)).mapInArrow(pack, "part int, k binary, n binary, l binary").repartition(n_parts, "part").sortWithinPartitions("part")
    return packed.mapInArrow(run, "bucket long, node long, size long").dropDuplicates(["bucket", "node"])


#: Rows that are looked at together for what is possible in a bucket, and the nodes of the largest bucket that is; pairs at once.
POSSIBLE_ROWS, POSSIBLE_NODES, POSSIBLE_PAIRS = 10_000, 1_000, 50_000


def possible_members(members: DataFrame, sketches: DataFrame, ratio: float, read: Callable[[np.ndarray, pa.Array], object], possible: Callable[[object, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """bucket, node: members (bucket, node, size) in buckets of those that possible pairs lead from one to the other.

    sketches: node, chars, sketch. A pair is possible only if the shorter has `ratio` of the longer's characters; what else their
    sketches say of pairs of places possible tells, from what read makes of lengths and sketches. Every possible pair stays in a
    common bucket. Buckets of more than POSSIBLE_NODES nodes stay as they are.
    """

    def run(table: pa.Table) -> pa.Table:
        b, chars = table["bucket"].to_numpy(), table["chars"].to_numpy().astype(np.int64)
        order = np.lexsort((chars, b))
        table, b, chars = table.take(pa.array(order)), b[order], chars[order]
        n, held = table["node"].to_numpy(), read(chars, table["sketch"].combine_chunks())
        number = np.cumsum(np.r_[False, b[1:] != b[:-1]])
        wide = int(chars.max()) * 2 + 4
        last = np.searchsorted(number * wide + chars, number * wide + np.minimum((chars / (ratio - 1e-9)).astype(np.int64) + 1, wide - 1), "right")
        count = last - np.arange(len(b)) - 1
        label = np.arange(len(b))
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        size = np.diff(np.r_[first, len(b)])
        middle = np.repeat(first + size // 2, size)
        total, at, u, v = np.cumsum(count), 0, [], []

        def look(i: np.ndarray, j: np.ndarray) -> None:
            fine = (chars[j] - chars[i] <= np.floor(chars[j] * (1 - ratio) + 1e-9)) & (label[i] != label[j])
            i, j = i[fine], j[fine]
            ok = possible(held, i, j)
            u.append(i[ok])
            v.append(j[ok])

        # all with the one in the middle of their bucket, and then only what that does not join already
        look(np.minimum(middle, np.arange(len(b))), np.maximum(middle, np.arange(len(b))))
        label = labels(len(b), u[0], v[0])
        while at < len(b):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + POSSIBLE_PAIRS, "right")))
            k = count[at:upto]
            i = np.repeat(np.arange(at, upto), k)
            look(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k))
            at = upto
        label = labels(len(b), np.concatenate(u), np.concatenate(v))
        out = [*node_sets(label, n, False)]
        return pa.Table.from_batches(out) if out else pa.table({"bucket": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})

    few = members.where(F.col("size") <= POSSIBLE_NODES)
    n = max(1, few.count() // POSSIBLE_ROWS)
    group = F.pmod(F.xxhash64("bucket", F.lit("possible")), F.lit(n)).cast("int").alias("g")
    pruned = few.join(sketches, "node").select(group, "bucket", "node", "chars", "sketch").groupBy("g").applyInArrow(run, "bucket long, node long").dropDuplicates(["bucket", "node"])
    return pruned.unionByName(members.where(F.col("size") > POSSIBLE_NODES).select("bucket", "node"))


#: Earlier buckets of a node that are told; a pair that shares later ones only may be settled in several.
TOLD = 32


def with_earlier(members: DataFrame, traits: DataFrame) -> DataFrame:
    """bucket, node, before (the node's buckets of lower number, the first of them) and the columns of traits, for link_groups."""
    held = members.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")).join(traits, "node")
    payload = [c for c in traits.columns if c != "node"]
    return held.select("node", "buckets", F.posexplode("buckets").alias("pos", "bucket"), *payload).select("bucket", "node", F.slice("buckets", F.lit(1), F.least("pos", F.lit(TOLD))).alias("before"), *payload)


#: Links that one task puts together, 16 bytes each; more go by rounds over all tasks.
ONE_TASK_LINKS = 1_000_000


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n places the least one that the links u, v lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        for x in (label[u], label[v], u, v):
            np.minimum.at(after, x, low)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            return label
        label = after


def components(batches):
    """node, comp of at most ONE_TASK_LINKS links (a, b): each round a node takes the least label beside it, and labels their own label."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = labels(len(nodes), u, v)
    for i in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[i : i + 10_000]), "comp": pa.array(nodes[label[i : i + 10_000]])})


def connected(links: DataFrame) -> DataFrame:
    """node, comp: the least node that links (a, b) lead to, for every node with a link.

    Each round every component takes the least component beside it, chains of such choices are followed, and the
    links are written anew between components; the number of components at least halves.
    """
    few = links.limit(ONE_TASK_LINKS + 1).count() <= ONE_TASK_LINKS
    if few:
        return keep(links.select("a", "b").coalesce(1).mapInArrow(components, "node long, comp long"))
    found = None
    edges = keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
        for _ in range(64):
            hop = parent.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            after = keep(parent.join(hop, "comp").select("node", F.col("above").alias("comp"), (F.col("above") != F.col("comp")).alias("moved")))
            moved = after.where("moved").limit(1).count()
            forget(parent)
            parent = after.drop("moved")
            parent._latentia_path = after._latentia_path
            if not moved:
                break
        if found is None:
            new = parent
        else:
            hop = parent.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            new = keep(found.join(hop, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp")))
            forget(found)
        cu, cv = parent.select(F.col("node").alias("u"), F.col("comp").alias("cu")), parent.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        rest = keep(edges.join(cu, "u").join(cv, "v").where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
        forget(edges)
        if found is not None:
            forget(parent)
        found, edges = new, rest
    forget(edges)
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)


#: Rows that meet in one task, pairs that one part of a bucket and one step of a task look at, and candidate rows verified together, about.
MEET_ROWS, MEET_PAIRS, STEP_PAIRS, GROUP_ROWS = 5_000, 1_000_000, 100_000, 2_000
#: Pairs of candidates and centres that are verified together, about.
GROUP_PAIRS = 40_000


def overlapping(left: pa.Array, i: np.ndarray, right: pa.Array, j: np.ndarray) -> np.ndarray:
    """Whether the lists left[i] and right[j] have a number in common; the numbers of one list differ."""
    tagged = []
    for lists, at in ((left, i), (right, j)):
        taken = lists.take(pa.array(at))
        size = np.diff(taken.offsets.to_numpy())
        pair = np.repeat(np.arange(len(at)), size)
        tagged.append((pair, mix(taken.flatten().to_numpy().view(U) + mix(pair.astype(U)))))
    pair, value = np.concatenate([tagged[0][0], tagged[1][0]]), np.concatenate([tagged[0][1], tagged[1][1]])
    order = np.argsort(value)
    same = np.flatnonzero(value[order][1:] == value[order][:-1])
    out = np.zeros(len(i), bool)
    out[pair[order[same]]] = True
    return out


def meet(active: DataFrame, centres: DataFrame, n_groups: int, may_link: Callable | None, payload: tuple[str, ...]) -> DataFrame:
    """k (a part of a bucket), a, comp, bs: each member with the centres of its bucket that it may be linked with.

    Rows of many buckets meet in one task and are matched as arrays; a large bucket is split, and its centres go to each part.
    """
    carried = ["node", "comp", "before", *payload]
    key = F.xxhash64("bucket", "part").alias("k")
    group = F.pmod(F.xxhash64("k", F.lit("meet")), F.lit(n_groups)).cast("int").alias("g")
    left = active.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("n_parts"))).select(key, *carried).select(group, "k", *carried)
    right = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1))).select(key, *[f"c_{x}" for x in carried]).select(group.alias("g2"), "k", *[f"c_{x}" for x in carried])

    def one(table: pa.Table, name: str):
        column = table[name].combine_chunks()
        return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_k, found_a, found_c, found_b, sizes = [], [], [], [], []
        if left.num_rows and right.num_rows:
            lk, rk = left["k"].to_numpy(), right["k"].to_numpy()
            order = np.argsort(rk, kind="stable")
            low, high = np.searchsorted(rk[order], lk, "left"), np.searchsorted(rk[order], lk, "right")
            count = high - low
            values = {x: (left[x].to_numpy(), right[f"c_{x}"].to_numpy()[order]) for x in ("node", "comp", *payload)}
            nodes, c_nodes = values["node"]
            tag = lambda k, n: mix(k.view(U) + mix(n.view(U)))
            is_centre = np.isin(tag(lk, nodes), tag(rk[order], c_nodes))
            before, c_before = one(left, "before"), one(right, "c_before").take(pa.array(order))
            total = np.cumsum(count)
            at = 0
            while at < len(lk):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, "right")))
                n = count[at:upto]
                i = np.repeat(np.arange(at, upto), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
                at = upto
                ok = (values["comp"][0][i] != values["comp"][1][j]) & (~is_centre[i] | (nodes[i] > c_nodes[j]))
                i, j = i[ok], j[ok]
                if may_link is not None and len(i):
                    ok = may_link({x: values[x][0][i] for x in payload}, {x: values[x][1][j] for x in payload})
                    i, j = i[ok], j[ok]
                if len(i):
                    ok = ~overlapping(before, i, c_before, j)
                    i, j = i[ok], j[ok]
                if len(i):
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    found_k.append(lk[i[first]])
                    found_a.append(nodes[i[first]])
                    found_c.append(values["comp"][0][i[first]])
                    sizes.append(np.diff(np.r_[first, len(i)]))
                    found_b.append(c_nodes[j])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(join(sizes))].astype(np.int32)), pa.array(join(found_b)))
        return pa.table({"k": pa.array(join(found_k)), "a": pa.array(join(found_a)), "comp": pa.array(join(found_c)), "bs": lists})

    return left.groupBy("g").cogroup(right.groupBy("g2")).applyInArrow(run, "k long, a long, comp long, bs array<long>")


@dataclass
class Test:
    """When two data are alike. gather: from a list of data what the others need, which name data by their places.

    possible: for one datum and an array of others, which may be alike. quick, if there is one: whether two are alike for
    certain, else nothing. exact: whether two are alike; many, if there is one: 1 or 0 for arrays
    of both places, or -1 where exact is to tell. rows: candidate rows that are verified together, about.
    """

    gather: Callable[[list], object]
    possible: Callable[[object, int, np.ndarray], np.ndarray]
    exact: Callable[[object, int, int], bool]
    quick: Callable[[object, int, int], bool] | None = None
    many: Callable[[object, np.ndarray, np.ndarray], np.ndarray] | None = None
    rows: int = GROUP_ROWS


#: Pairs that are tested at once; what they join is left out of the next ones.
MANY = 4_096


class Joined:
    """Which components are joined already, in one task."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.above.get(root, root)) != root:
            root = up
        while (up := self.above.get(x, x)) != root:
            self.above[x], x = root, up
        return root

    def join(self, x: int, y: int) -> None:
        self.above[self.find(x)] = self.find(y)


def settle(candidates: DataFrame, centres: DataFrame, data: DataFrame, test: Test) -> DataFrame:
    """Links (a, b) among candidates (k, a, comp, bs) whose data (node, data) are alike; none between components that others of the same task join.

    The candidates of one k are split into parts of limited size, and their centres (k, b, comp_b) go to each part.
    """
    shares = F.greatest(F.count(F.lit(1)) / test.rows, F.sum(F.size("bs")) / GROUP_PAIRS)
    n = max(1, int(candidates.agg(shares).first()[0] or 0))
    of_k = small(keep(candidates.groupBy("k").agg((shares + 1).cast("int").alias("n_parts"))))
    group = F.pmod(F.xxhash64("k", "part"), F.lit(n)).cast("int").alias("g")
    left = candidates.join(of_k, "k").withColumn("part", F.pmod(F.xxhash64("comp", "a", F.lit("part")), F.col("n_parts")).cast("int"))
    left = left.select(group, "a", "comp", "bs").join(data.select(F.col("node").alias("a"), F.col("data").alias("da")), "a").select("g", "a", "comp", "bs", "da")
    right = centres.join(of_k, "k").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    right = right.select(group, "b", "comp_b").distinct().join(data.select(F.col("node").alias("b"), F.col("data").alias("db")), "b").select(F.col("g").alias("g2"), "b", "comp_b", "db")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if left.num_rows:
            ids, comps, bs = left["a"].to_numpy(), left["comp"].to_pylist(), left["bs"].combine_chunks()
            centre, centre_comps = right["b"].to_numpy(), right["comp_b"].to_pylist()
            order = np.argsort(centre)
            place = order[np.searchsorted(centre[order], bs.flatten().to_numpy())]  # of each candidate's centre on the right
            ends = np.cumsum(np.diff(bs.offsets.to_numpy()))
            held, joined = test.gather(right["db"].to_pylist() + left["da"].to_pylist()), Joined()
            open_pairs = []
            for i, (start, end) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                js = place[start:end]
                open_pairs += [(i, j) for j in js[test.possible(held, len(centre) + i, js)].tolist()]
            for check in (test.quick, test.exact):  # what is cheap to see joins components first
                rest = []
                if check is test.exact and test.many is not None:
                    for at in range(0, len(open_pairs), MANY):
                        some = [(i, j) for i, j in open_pairs[at : at + MANY] if joined.find(comps[i]) != joined.find(centre_comps[j])]
                        alike = test.many(held, len(centre) + np.array([i for i, _ in some], np.int64), np.array([j for _, j in some], np.int64))
                        for (i, j), found in zip(some, alike.tolist(), strict=True):
                            if found < 0:
                                rest.append((i, j))
                            elif found and joined.find(comps[i]) != joined.find(centre_comps[j]):
                                joined.join(comps[i], centre_comps[j])
                                found_a.append(ids[i])
                                found_b.append(centre[j])
                    open_pairs, rest = rest, []
                for i, j in open_pairs:
                    if check is None or joined.find(comps[i]) == joined.find(centre_comps[j]):
                        rest.append((i, j))
                    elif check(held, len(centre) + i, j):
                        joined.join(comps[i], centre_comps[j])
                        found_a.append(ids[i])
                        found_b.append(centre[j])
                    else:
                        rest.append((i, j))
                open_pairs = rest
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return left.groupBy("g").cogroup(right.groupBy("g2")).applyInArrow(run, "a long, b long")


def link_groups(members: DataFrame, data: DataFrame, test: Test, may_link: Callable | None = None, payload: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Components (node, comp) of the nodes with a link, and confirmed links (a, b) that hold them together.

    members: bucket, node, before and the payload columns, each node once in a bucket, of buckets with two nodes or
    more. before: those of the node's buckets that stand earlier in an order that all nodes share, TOLD at most; a pair is
    settled in the first of its common buckets only, and so once, unless that one is not told.
    data: node, data. test: when data are alike. may_link: from the payload
    columns of both sides, as arrays, the pairs that are worth a look at the data.
    """
    state = members.select("bucket", "node", F.col("node").alias("comp"), "before", *payload)
    links = comps = own = None
    centres_each = 1
    carried = ["node", "comp", "before", *payload]
    while True:
        rank = F.xxhash64("node", F.lit("rank"))
        seen = state.groupBy("bucket").agg(F.min_by("comp", rank).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
        n_parts = (F.col("size") * F.least("size", F.lit(centres_each)) / MEET_PAIRS + 1).cast("long").alias("n_parts")
        active = keep(state.join(seen.select("bucket", "hub", n_parts), "bucket"))
        if own is not None:
            forget(own)
        own = active
        n_active = active.count()
        if not n_active:
            forget(active)
            break
        order = Window.partitionBy("bucket").orderBy(F.col("comp") == F.col("hub"), rank, "node")
        first = order if centres_each > 1 else Window.partitionBy("bucket").orderBy(rank, "node")
        chosen = active.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= centres_each)
        centres = keep(chosen.select("bucket", "n_parts", *[F.col(x).alias(f"c_{x}") for x in carried]))
        candidates = keep(meet(active, centres, max(1, n_active // MEET_ROWS), may_link, payload))
        if candidates.limit(1).count():
            of_parts = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1))).select(F.xxhash64("bucket", "part").alias("k"), F.col("c_node").alias("b"), F.col("c_comp").alias("comp_b"))
            good = keep(settle(candidates, of_parts, data, test))
            links = good if links is None else links.union(good)
            if good.limit(1).count():
                if comps is not None:
                    forget(comps)
                comps = connected(links)
        forget(candidates)
        left = active.drop("hub", "comp", "n_parts").join(centres.select("bucket", F.col("c_node").alias("node")), ["bucket", "node"], "left_anti")
        if comps is not None:
            state = left.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"), "before", *payload)
        else:
            state = left.select("bucket", "node", F.col("node").alias("comp"), "before", *payload)
        centres_each *= 64
    empty = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    links = empty if links is None else links
    return (comps if comps is not None else connected(links)), links
