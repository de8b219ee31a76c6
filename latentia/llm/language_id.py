"""Language ID by error-correcting output codes.

Each language has a codeword; a logistic classifier over hashed letter n-grams
predicts each bit; the codeword with the least loss, weighted by how reliable
each bit is for that language, is chosen. A small lead over the next codeword
flags the document as ambiguous.

The classifiers are fitted on a bounded sample: `per_language` documents of
each language in expectation, picked by a hash of the id. Prediction reads whole texts.

Defined results: a text that is null, empty or has no letter is `und` with
score 0 and is not ambiguous; with no labelled row at all every text is `und`;
with one language every text with letters has that language and score 1;
repeated rows get the same result; ids may be null; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.llm.kernels import buffers
from latentia.llm.tables import id_remainder, read, small_batches

BITS = 12
DIM = 2 << BITS
MAX_LANGUAGES = 1000


def letter_table() -> np.ndarray:
    """Bytes to lower-case letters; what cannot be part of a letter becomes a space."""
    table = np.full(256, 0x20, np.uint8)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def gram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the counts of its hashed byte bigrams and trigrams, letters folded, runs of other bytes as one space."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM), np.float32)
    if not len(raw):
        return out
    s = letter_table()[raw]
    upper = np.zeros(len(s), bool)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    s[upper] += 0x20
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0x20) | (s[:-1] != 0x20) | (row[1:] != row[:-1])
    s, row = s[keep].astype(np.uint32), row[keep]
    for k, base in ((2, 0), (3, 1 << BITS)):
        if len(s) < k:
            continue
        m = len(s) - k + 1
        code = np.zeros(m, np.uint32)
        for i in range(k):
            code = (code << np.uint32(8)) | s[i : i + m]
        h = (code * np.uint32(2654435769)) >> np.uint32(32 - BITS)
        ok = row[:m] == row[k - 1 :]
        out += np.bincount(row[:m][ok] * DIM + base + h[ok], minlength=n * DIM).reshape(n, DIM)
    return out


def normed(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code for up to 6 classes, else the best of 200 random ones by least distance."""
    if n <= 2:
        return np.array([[1.0]] * n) if n < 2 else np.array([[1.0], [-1.0]])
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        code = np.ones((n, len(bits)))
        for i in range(1, n):
            code[i] = np.where((bits >> (i - 1)) & 1, -1.0, 1.0)
        return code
    length, rng, best, least = max(31, int(np.ceil(10 * np.log2(n)))), np.random.default_rng(seed), None, -1
    for _ in range(200 if n <= 100 else 10):
        code = rng.choice([-1.0, 1.0], (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        d = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(d, np.inf)
        if d.min() > least:
            best, least = code, d.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -f[:, None, :] * self.code[None]) * self.reliability[None]
        return loss.sum(2)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score in 0 to 1 and lead over the next."""
        p = -self.losses(x) * self.code.shape[1] / 2
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        second = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, p.max(1), p.max(1) - second


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, rate: float = 0.05, decay: float = 1e-5) -> LanguageModel:
    code = codewords(len(languages))
    x = x.astype(np.float32)
    t = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages))
    weight = (1.0 / np.maximum(share, 1))[y].astype(np.float32)
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for i in range(1, steps + 1):
        g = -t * weight / (1 + np.exp(np.clip(t * (x @ w + b), -60, 60)))
        gw, gb = x.T @ g + decay * w, g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        size = rate * np.sqrt(1 - 0.999**i) / (1 - 0.9**i)
        w -= size * 20 * m / (np.sqrt(v) + 1e-8)
        b -= size * mb / (np.sqrt(vb) + 1e-8)
    right = (np.sign(x @ w + b) == t).astype(float)
    rel = np.array([right[y == i].mean(0) if (y == i).any() else np.ones(code.shape[1]) for i in range(len(languages))])
    rel = np.maximum(rel, 1e-3)
    return LanguageModel(languages, code, w, b, rel / rel.sum(1, keepdims=True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300) -> LanguageModel | None:
    """Fits on `per_language` rows of each language in expectation; None if no row has a label and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = rows.groupBy(F.col(lang_col).alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not known:
        return None
    languages = sorted(r[0] for r in known)
    at = {name: i for i, name in enumerate(languages)}
    spark = docs.sparkSession
    share = spark.createDataFrame([(r[0], at[r[0]], min(1.0, per_language / r[1])) for r in known], "lang string, y int, share double")
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("language sample")), 11) / F.lit(float(1 << 53))
    picked = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), u.alias("u")).join(F.broadcast(share), "lang").where("u < share").select("y", "text")

    def features(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                x = normed(gram_counts(*buffers(part.column("text"))))
                some = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_pydict(
                    {"y": part.column("y"), "at": pa.array([k.astype(np.uint16).tobytes() for k in some], pa.binary()), "v": pa.array([r[k].astype(np.float16).tobytes() for r, k in zip(x, some, strict=True)], pa.binary())}
                )

    got = picked.mapInArrow(features, "y int, at binary, v binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))  # the order of rows does not change the model
    if not got:
        return None
    x = np.zeros((len(got), DIM), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r[1], np.uint16)] = np.frombuffer(r[2], np.float16)
    return train(x, np.array([r[0] for r in got]), languages)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] = (), lead: float = 0.1, keep_text: str | None = None) -> DataFrame:
    """id, the carried columns, lang_pred, score, margin (lead over the next language) and ambiguous (margin under `lead`); the text too, if it is given a name."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), *carry, F.col(text_col).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text" or keep_text]

    def run(batches):
        ascii_letters = np.zeros(256, bool)
        ascii_letters[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                column = part.column("_text")
                raw, offsets = buffers(column)
                n = len(offsets) - 1
                hits = np.concatenate([[0], np.cumsum(ascii_letters[raw])])
                has = hits[offsets[1:]] > hits[offsets[:-1]]
                for k in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[k] = any(map(str.isalpha, column[int(k)].as_py()))
                names, score, margin = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                if model is not None and has.any():
                    best, p, gap = model.decode(normed(gram_counts(raw, offsets)))
                    names = np.where(has, np.array(model.languages, object)[best], "und")
                    score, margin = np.where(has, np.clip(p, 0, 1), 0.0), np.where(has, gap, 0.0)
                cols = {f.name: part.column(f.name) for f in kept}
                cols |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "margin": pa.array(margin), "ambiguous": pa.array(has & (margin < lead) & (names != "und"))}
                yield pa.RecordBatch.from_pydict(cols)

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType()), StructField("ambiguous", BooleanType())])
    out = rows.mapInArrow(run, schema)
    return out.withColumnRenamed("_text", keep_text) if keep_text else out


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0)
    model = fit(docs.where("not held_out"))
    return predict(docs, model, carry=[F.col("held_out")]).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
