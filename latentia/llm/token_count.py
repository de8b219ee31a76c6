"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens; those not met before are held together as one
ragged array of symbols, and in each round every sequence applies its pair of
the lowest rank everywhere it occurs, all sequences at once, until none has a
pair left. The surviving symbols are counted.

Defined results: a null or empty text has 0 tokens; a special token's string
inside a text counts as one token, as the library's default has it; repeated
rows are counted each; ids may be null; further columns are left out.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.llm.kernels import buffers
from latentia.llm.tables import read, small_batches

#: Characters whose classes no recent Unicode version has changed; texts with others are split by the library itself.
PLAIN = "[^\\x00-\\u07ff\\u2010-\\u203a\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3]"
CACHE = 400_000
NONE = np.int64(1) << np.int64(62)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker."""
    return sys.modules.setdefault("_latentia_worker", types.ModuleType("_latentia_worker")).__dict__


class Splitter:
    """Pre-tokens of texts, in the way of a byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.odd = regex.compile(PLAIN).search
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Specials, as they stand in a text, are pieces of their own."""
        if self.cut and any(s in text for s in self.special):
            return [p for part in self.cut(text) for p in ([part] if part in self.special else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii() and self.odd(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Counts symbols of pre-tokens by merging all of them at once."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.first = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, and each word's first place (one more at the end)."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_seq = [], []
        while len(sym):
            rank = np.full(len(sym), NONE)
            same = np.flatnonzero(seq[1:] == seq[:-1])
            rank[same] = self.rank(sym[same], sym[same + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            each = np.repeat(least, np.diff(np.r_[starts, len(sym)]))
            live = each < NONE
            done_sym.append(sym[~live])
            done_seq.append(seq[~live])
            sym, seq, rank, each = sym[live], seq[live], rank[live], each[live]
            if not len(sym):
                break
            hit = rank == each
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])  # of pairs that overlap, every other one from the left
            place = np.arange(len(sym))
            begin = np.zeros(len(sym), np.int64)
            begin[run] = run
            hit &= (place - np.maximum.accumulate(begin)) % 2 == 0
            sym[hit] = self.made[rank[hit]]
            left = ~np.r_[False, hit[:-1]]
            sym, seq = sym[left], seq[left]
        s, q = np.concatenate([*done_sym, sym]), np.concatenate([*done_seq, seq])
        order = np.argsort(q, kind="stable")
        return s[order], np.searchsorted(q[order], np.arange(len(words) + 1))

    def counts(self, words: list[bytes]) -> np.ndarray:
        return np.diff(self.symbols(words)[1])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens above limit)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        store = worker_store()
        key = ("token counts", path)
        if key not in store:
            store[key] = (Splitter(path), Merger(path), {})
        splitter, merger, cache = store[key]
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(buffers(column)[1])
            tokens = np.zeros(batch.num_rows, np.int64)
            groups = np.cumsum(sizes) // 2_000_000
            for g in np.unique(groups):
                rows = np.flatnonzero(groups == g)
                split = [splitter.pieces(t) if t else [] for t in column.take(pa.array(rows)).to_pylist()]
                new = list(set().union(*split).difference(cache))
                if new:
                    if len(cache) + len(new) > CACHE:
                        cache.clear()
                        new = list(set().union(*split))
                    cache.update(zip(new, merger.counts([w.encode() for w in new]).tolist(), strict=True))
                    cache.update((s, 1) for s in splitter.special)
                tokens[rows] = [sum(map(cache.__getitem__, p)) for p in split]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": pa.array(sizes), "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
