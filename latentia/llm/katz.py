"""Language-model scores by Katz backoff over words, order two.

Counts r of one to k are discounted by Good-Turing; the mass that the seen
continuations of a history give up goes to the others in proportion to the
unigram model, with a weight that makes each history's probabilities add up to
one exactly. The unigram model backs off in the same way to one class of
unknown words. A text is scored token by token, its end included, from a begin
mark on: the bigram if it was seen, else the history's weight and the unigram.

Words are 64-bit hashes. Texts are dealt to chunks by id; counts, answers and
entries travel as compressed arrays in tables partitioned by hash:

1. chunks send the counts of their distinct words and bigrams to buckets, which
   answer with a number and the corpus count of each word asked for, and add up
   counts of counts (kept as a table; some numbers for the whole corpus go to the driver);
2. chunks send (history, word, document) entries to buckets by history, where
   counts, discounts and backoff weights are worked out and each document's
   share of the score is added up (kept as a table);
3. the shares meet by chunk.

A history with a large part of all tokens is spread over buckets by the next
word, and its weight is put together at the end; a bigram with a large part is
sent as one count for each chunk and its probability handed back. There are at
most a few hundred of either, by their definition, times the number of buckets.

Defined results: a null or empty text is its end token; with nothing to learn
from, every token is unknown and has probability one; where no count can be
discounted a history gives up 1 / (count + 1); repeated rows count each; ids
may be null; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.llm.kernels import WordHasher, U, buffers, mix
from latentia.llm.tables import forget, id_remainder, keep, parts, read, volume
from latentia.llm.token_count import worker_store

BEGIN, END = U(0x0B5E0000000000A1), U(0x0E4D0000000000B3)
TOP = 5
#: A history or bigram is frequent if it has this part of what a bucket holds on average.
FREQUENT = 0.25
LEAST_FREQUENT = 1000


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of like place together, then zstd."""
    import zstandard

    width = values.dtype.itemsize
    head = values.dtype.str.encode().ljust(8)
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def expand(data: bytes) -> np.ndarray:
    import zstandard

    kind = np.dtype(bytes(data[:8]).decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def good_turing(counts_of_counts: dict[int, int], top: int = TOP) -> np.ndarray:
    """Discounts of the counts 0 (unused) to k, k as large as the counts of counts allow; counts above have none."""
    n = lambda r: counts_of_counts.get(r, 0)
    for k in range(top, 0, -1):
        if any(n(r) == 0 for r in range(1, k + 2)):
            continue
        common = (k + 1) * n(k + 1) / n(1)
        if common >= 1:
            continue
        d = [((r + 1) * n(r + 1) / (r * n(r)) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d) and d[0] < 1:
            return np.array([1.0, *d])
    return np.array([1.0, 0.5]) if n(1) else np.array([1.0])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


class Unigram:
    """The lower order: totals and discounts, from counts of counts and the number of tokens."""

    def __init__(self, total: int, counts_of_counts: dict[int, int]):
        self.total, self.d = total, good_turing(counts_of_counts)
        lost = sum(n * r * (1 - self.d[r]) for r, n in counts_of_counts.items() if r < len(self.d))
        if not total:
            self.scale, self.unknown = 1.0, 1.0
        elif lost <= 0:
            self.scale, self.unknown = total / (total + 1), 1 / (total + 1)
        else:
            self.scale, self.unknown = 1.0, lost / total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.scale * discounted(counts, self.d) / max(self.total, 1), self.unknown)


def tokens(column: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with ends, the token before each, the row of each, and the number of tokens of each row."""
    h, _, starts = hasher.words(*buffers(column))
    n = np.diff(starts) + 1
    rows = np.repeat(np.arange(len(n)), n)
    last = np.cumsum(n) - 1
    t = np.zeros(len(rows), U)
    t[last] = END
    inner = np.ones(len(rows), bool)
    inner[last] = False
    t[inner] = h
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[last - n + 1] = BEGIN
    return t, before, rows, n


def bigram_key(before: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix(mix(before) * U(0x9E3779B97F4A7C15) + t)


def by_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets of sorted keys; they rise with the key."""
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


def hasher_of_worker() -> WordHasher:
    store = worker_store()
    if "words in lower case" not in store:
        store["words in lower case"] = WordHasher(True)
    return store["words in lower case"]


def slices(bucket: np.ndarray):
    """Runs of equal values."""
    if not len(bucket):
        return
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)


def counts_table(docs: DataFrame, n_buckets: int) -> DataFrame:
    """From chunks of documents: the answers (chunk, bucket, numbers, counts) and sums (kind 1: words, 2: bigrams)."""

    def ask(table: pa.Table) -> pa.Table:
        t, before, rows, _ = tokens(table["text"], hasher_of_worker())
        learn = ~table["held"].to_numpy(zero_copy_only=False).astype(bool)[rows]
        chunk = table["chunk"][0].as_py()
        words, where = np.unique(t, return_inverse=True)
        seen = np.bincount(where[learn], minlength=len(words))
        out = [(0, chunk, b, squeeze(words[i:j]), squeeze(seen[i:j])) for b, i, j in slices(by_bucket(words, n_buckets))]
        pairs, seen = np.unique(bigram_key(before[learn], t[learn]), return_counts=True)
        out += [(1, chunk, b, squeeze(pairs[i:j]), squeeze(seen[i:j])) for b, i, j in slices(by_bucket(pairs, n_buckets))]
        kind, chunk, bucket, keys, seen = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(seen, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        keys = [expand(x.as_py()) for x in table["keys"]]
        counts = [expand(x.as_py()) for x in table["counts"]]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        few = np.bincount(total[total <= TOP + 1], minlength=TOP + 2)
        head = [int(total.sum()), int((total > 0).sum()), *few[1:].tolist()]
        rows = [(kind + 1, -1, bucket, np.array(head, np.int64).tobytes(), b"")]
        if kind == 0:
            rank = np.empty(len(every), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(every))
            number = rank * n_buckets + bucket
            at = 0
            for chunk, k in zip(table["chunk"].to_pylist(), keys, strict=True):
                own = where[at : at + len(k)]
                rows.append((0, chunk, bucket, squeeze(number[own]), squeeze(total[own])))
                at += len(k)
        else:
            often = np.argsort(-total, kind="stable")[:64]  # of a bucket's share, no more than a few can be frequent
            rows.append((3, -1, bucket, every[often].tobytes(), total[often].tobytes()))
        kind, chunk, bucket, keys, seen = zip(*rows, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "numbers": pa.array(keys, pa.binary()), "counts": pa.array(seen, pa.binary())})

    asked = docs.groupBy("chunk").applyInArrow(ask, "kind int, chunk int, bucket int, keys binary, counts binary")
    return asked.groupBy("kind", "bucket").applyInArrow(answer, "kind int, chunk int, bucket int, numbers binary, counts binary")


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score. `held`: true for those that nothing is learned from."""
    spark = docs.sparkSession
    _, size = volume(docs, text_col)
    n_chunks, n_buckets = parts(spark, size, 8 << 20), parts(spark, size, 6 << 20)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(n_chunks)).cast("int"))
    id_kind = dict(rows.dtypes)["id"]
    table = keep(counts_table(rows, n_buckets))
    sums = {1: np.zeros(TOP + 3, np.int64), 2: np.zeros(TOP + 3, np.int64)}
    often: dict[int, int] = {}
    for r in table.where("kind > 0").select("kind", "numbers", "counts").collect():
        if r[0] < 3:
            sums[r[0]] += np.frombuffer(r[1], np.int64)
        else:
            often.update(zip(np.frombuffer(r[1], U).tolist(), np.frombuffer(r[2], np.int64).tolist(), strict=True))
    total, distinct = int(sums[1][0]), int(sums[1][1])
    low = Unigram(total, dict(enumerate(sums[1][2:].tolist(), 1)))
    d2 = good_turing(dict(enumerate(sums[2][2:].tolist(), 1)))
    hot = max(LEAST_FREQUENT, FREQUENT * total / n_buckets)
    hot_pairs = np.sort(np.array([k for k, c in often.items() if c >= hot], U))
    n_learned = rows.where("not held").count()
    cast = {"id": id_kind, "held": "boolean", "n_tokens": "long", "n_known": "long", "base": "double"}
    fields = "kind int, chunk int, bucket int, doc int, " + ", ".join(f"{k} {v}" for k, v in cast.items()) + ", blobs array<binary>"
    id_type = rows.schema["id"].dataType

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def batch(kind, chunk, bucket, doc=None, docs=None, n_tokens=None, n_known=None, base=None, blobs=None) -> pa.Table:
        n = len(kind)
        none = lambda t: pa.nulls(n, t)
        return pa.table(
            {
                "kind": pa.array(kind, pa.int32()),
                "chunk": pa.array(chunk, pa.int32()),
                "bucket": pa.array(bucket, pa.int32()),
                "doc": none(pa.int32()) if doc is None else pa.array(doc, pa.int32()),
                "id": none(arrow_id) if docs is None else docs["id"].combine_chunks().cast(arrow_id),
                "held": none(pa.bool_()) if docs is None else docs["held"].combine_chunks(),
                "n_tokens": none(pa.int64()) if n_tokens is None else pa.array(n_tokens, pa.int64()),
                "n_known": none(pa.int64()) if n_known is None else pa.array(n_known, pa.int64()),
                "base": none(pa.float64()) if base is None else pa.array(base, pa.float64()),
                "blobs": pa.array([[]] * n if blobs is None else blobs, pa.list_(pa.binary())),
            }
        )

    def entries(table: pa.Table, told: pa.Table) -> pa.Table:
        """kind 0: documents; kind 1: entries of a bucket as arrays: histories, their counts and lengths, then words, word counts, documents, times, learned from or not."""
        chunk = table["chunk"][0].as_py()
        t, before, doc, n = tokens(table["text"], hasher_of_worker())
        held = table["held"].to_numpy(zero_copy_only=False).astype(bool)
        words, where = np.unique(t, return_inverse=True)
        order = np.argsort(told["bucket"].to_numpy(), kind="stable").tolist()
        number = np.concatenate([expand(told["numbers"][i].as_py()) for i in order])
        count = np.concatenate([expand(told["counts"][i].as_py()) for i in order])
        if len(number) != len(words):
            raise RuntimeError("the answers do not belong to this chunk")
        c = count[where]
        known = np.bincount(doc, weights=c > 0, minlength=len(n)).astype(np.int64)
        base = np.bincount(doc, weights=np.log10(c + 1.0), minlength=len(n))
        w, h, hc = number[where], np.full(len(t), -1, np.int64), np.full(len(t), n_learned, np.int64)
        first = np.cumsum(n) - n
        inner = np.ones(len(t), bool)
        inner[first] = False
        h[inner], hc[inner] = w[np.flatnonzero(inner) - 1], c[np.flatnonzero(inner) - 1]
        times = np.ones(len(t), np.int64)
        learned = ~held[doc]
        mark = doc.astype(np.int64)
        hot_at: list[list[bytes]] = [[] for _ in n]
        if len(hot_pairs):
            key = bigram_key(before, t)
            at = np.minimum(np.searchsorted(hot_pairs, key), len(hot_pairs) - 1)
            is_hot = hot_pairs[at] == key
            both, again = np.unique(doc[is_hot] * len(hot_pairs) + at[is_hot], return_counts=True)
            for d, i, j in slices(both // len(hot_pairs)):
                hot_at[d] = [squeeze((both[i:j] % len(hot_pairs)).astype(np.int32)), squeeze(again[i:j].astype(np.int32))]
            # one entry for the whole chunk: its place is below 0
            one, at_first, where1 = np.unique(at[is_hot], return_index=True, return_inverse=True)
            chosen = np.flatnonzero(is_hot)[at_first]
            mark[chosen] = -1 - one
            times[chosen] = np.bincount(where1, weights=learned[is_hot], minlength=len(one)).astype(np.int64)
            learned[chosen] = True
            stay = ~is_hot
            stay[chosen] = True
            h, w, hc, c, mark, times, learned = (x[stay] for x in (h, w, hc, c, mark, times, learned))
        spread = np.where(hc >= hot, w, 0).astype(U)
        bucket = (mix(h.astype(U) * U(0x9E3779B97F4A7C15) + mix(spread)) % U(n_buckets)).astype(np.int64)
        order = np.lexsort((mark, w, h, bucket))
        bucket, h, w, hc, c, mark, times, learned = (x[order] for x in (bucket, h, w, hc, c, mark, times, learned))
        new = np.ones(len(h), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (mark[1:] != mark[:-1])
        at = np.flatnonzero(new)
        times = np.add.reduceat(times, at) if len(at) else times
        bucket, h, w, hc, c, mark, learned = (x[at] for x in (bucket, h, w, hc, c, mark, learned))
        kinds, buckets, blobs = [], [], []
        for b, i, j in slices(bucket):
            starts = np.flatnonzero(np.r_[True, h[i + 1 : j] != h[i : j - 1]])
            lengths = np.diff(np.r_[starts, j - i])
            blobs.append([squeeze(x) for x in (h[i:j][starts], hc[i:j][starts], lengths.astype(np.int32), w[i:j], c[i:j].astype(np.int64), mark[i:j].astype(np.int32), times[i:j].astype(np.int32), learned[i:j])])
            kinds.append(1)
            buckets.append(b)
        own = batch([0] * len(n), [chunk] * len(n), [chunk] * len(n), np.arange(len(n)), table, n, known, base, hot_at)
        return pa.concat_tables([own, batch(kinds, [chunk] * len(kinds), buckets, blobs=blobs)])

    def shares(table: pa.Table) -> pa.Table:
        """kind 0 goes through; kind 1 gives kind 2: documents and their shares by chunk, with frequent histories left open; kind 3: parts of those; kind 4: frequent bigrams."""
        if table["kind"][0].as_py() == 0:
            return table
        hs, hcs, ws, cs, marks, times, learned, chunk = [], [], [], [], [], [], [], []
        for k, row in zip(table["chunk"].to_pylist(), table["blobs"], strict=True):
            h, hc, length, w, c, mark, n, l = (expand(x.as_py()) for x in row)
            hs.append(np.repeat(h, length))
            hcs.append(np.repeat(hc, length))
            ws.append(w)
            cs.append(c)
            marks.append(mark)
            times.append(n)
            learned.append(l.astype(bool))
            chunk.append(np.full(len(w), k, np.int32))
        h, hc, w, c, mark, n, l, chunk = (np.concatenate(x) for x in (hs, hcs, ws, cs, marks, times, learned, chunk))
        del hs, hcs, ws, cs, marks, times, learned
        order = np.lexsort((w, h))
        h, hc, w, c, mark, n, l, chunk = (x[order] for x in (h, hc, w, c, mark, n, l, chunk))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        pair = np.cumsum(new) - 1
        seen = np.add.reduceat(np.where(l, n, 0).astype(np.int64), at)
        ph, phc, pc = h[at], hc[at], c[at]
        p_low = low.p(pc)
        star = discounted(seen, d2) / np.maximum(phc, 1)
        head = np.flatnonzero(np.diff(ph, prepend=-2))
        group = np.cumsum(np.r_[False, ph[1:] != ph[:-1]])
        gc = phc[head]
        used = np.add.reduceat(star, head)
        plain = np.add.reduceat(seen / np.maximum(phc, 1), head)
        covered = np.add.reduceat(np.where(seen > 0, p_low, 0.0), head)
        frequent = gc >= hot
        none_lost = used >= plain - 1e-12
        scale = np.where(none_lost & ~frequent, gc / (gc + 1.0), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(gc > 0, (1 - used * scale) / np.maximum(1 - covered, 1e-300), 1.0)
        p = np.where(seen > 0, star * scale[group], p_low * np.where(frequent[group], 1.0, alpha[group]))
        value = np.log10(p)[pair] * n
        out = []
        doc_entry = mark >= 0
        many = 1 << 20
        where_doc = chunk[doc_entry].astype(np.int64) * many * many + mark[doc_entry]
        keys, inv = np.unique(where_doc, return_inverse=True)
        total = np.bincount(inv, weights=value[doc_entry], minlength=len(keys))
        open_entry = doc_entry & frequent[group][pair] & ((seen[pair] == 0) | none_lost[group][pair])
        code = np.where(seen[pair] > 0, 1, 0)
        opened: dict[int, list[np.ndarray]] = {}
        for k in np.unique(chunk[open_entry]).tolist():
            e = open_entry & (chunk == k)
            opened[k] = [mark[e], h[e], n[e].astype(np.int32), code[e].astype(np.int8)]
        for k, i, j in slices(keys // (many * many)):
            blobs = [squeeze((keys[i:j] % (many * many)).astype(np.int32)), squeeze(total[i:j])]
            out.append((2, k, blobs + [squeeze(x) for x in opened.get(k, [])]))
        for g in np.flatnonzero(frequent).tolist():
            parts_of = np.array([ph[head[g]], gc[g]], np.int64).tobytes() + np.array([used[g], plain[g], covered[g]]).tobytes()
            out.append((3, -1, [parts_of]))
        special = ~doc_entry
        if special.any():
            ids, first = np.unique(-1 - mark[special], return_index=True)
            logp = np.log10(p)[pair[special]][first]
            ph_, fr = h[special][first], (frequent[group] & none_lost[group])[pair[special]][first]
            for i, x, hh, f in zip(ids.tolist(), logp.tolist(), ph_.tolist(), fr.tolist(), strict=True):
                out.append((4, -1, [np.array([i, hh if f else -2], np.int64).tobytes() + np.array([x]).tobytes()]))
        kinds, chunks, blobs = zip(*out, strict=True)
        return batch(kinds, chunks, [0] * len(kinds), blobs=list(blobs))

    answers = table.where("kind = 0").drop("kind")
    flow = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(entries, fields)
    result = keep(flow.groupBy("kind", "bucket").applyInArrow(shares, fields))
    forget(table)
    weights: dict[int, np.ndarray] = {}
    hot_counts: dict[int, int] = {}
    pair_values: dict[int, tuple[int, float]] = {}
    for r in result.where("kind in (3, 4)").select("kind", "blobs").collect():
        data = bytes(r[1][0])
        a, b = np.frombuffer(data[:16], np.int64).tolist()
        if r[0] == 3:
            weights[a] = weights.get(a, np.zeros(3)) + np.frombuffer(data[16:], float)
            hot_counts[a] = b
        else:
            pair_values[a] = (b, float(np.frombuffer(data[16:], float)[0]))
    closing: dict[int, tuple[float, float]] = {}
    for h, (used, plain, covered) in weights.items():
        scale = hot_counts[h] / (hot_counts[h] + 1) if used >= plain - 1e-9 else 1.0
        closing[h] = (math.log10(max(1 - used * scale, 1e-300) / max(1 - covered, 1e-300)), math.log10(scale))
    pair_logs = np.array([pair_values[i][1] + (closing[pair_values[i][0]][1] if pair_values[i][0] in closing else 0.0) if i in pair_values else 0.0 for i in range(len(hot_pairs))])
    open_h = np.array(sorted(closing), np.int64)
    open_logs = np.array([closing[h] for h in open_h.tolist()]).reshape(-1, 2)

    def finish(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        own = table.filter(pa.array(kind == 0)).sort_by("doc")
        n = own.num_rows
        total = np.zeros(n)
        for row in table.filter(pa.array(kind == 2))["blobs"]:
            parts_of = [expand(x.as_py()) for x in row]
            np.add.at(total, parts_of[0], parts_of[1])
            if len(parts_of) > 2:
                doc, h, times, code = parts_of[2:]
                np.add.at(total, doc, times * open_logs[np.searchsorted(open_h, h), code])
        for i, row in enumerate(own["blobs"]):
            if len(row):
                which, times = (expand(x.as_py()) for x in row)
                total[i] += (pair_logs[which] * times).sum()
        tokens_of = own["n_tokens"].to_numpy()
        base = own["base"].to_numpy() - tokens_of * math.log10(total_plus)
        return pa.table({"id": own["id"], "held_out": own["held"], "n_tokens": own["n_tokens"], "n_known": own["n_known"], "train_tokens": pa.array([total_tokens] * n, pa.int64()), "base_score": base, "score": total})

    total_tokens, total_plus = total, total + distinct + 1
    out = result.where("kind in (0, 2)").groupBy("chunk").applyInArrow(finish, f"id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, id_remainder(F.col("doc_id"), 7) == 2)
