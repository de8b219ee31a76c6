"""NumPy kernels over the UTF-8 bytes of Arrow string columns.

A column is seen as one byte buffer and the offsets of its rows, so a batch is
processed whole. White space is \\x20 and \\x09-\\x0D; a word is a run of other bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
U = np.uint64


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def white_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class WordHasher:
    """64-bit hashes of words, from prefix sums of a polynomial in an odd base modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, fold_case: bool):
        self.table = (lower_table() if fold_case else np.arange(256, dtype=np.uint8)).astype(U) + U(1)
        self.white = white_table()
        self.up = powers(SEGMENT + 2, self.BASE)
        self.down = powers(SEGMENT + 2, pow(self.BASE, -1, 1 << 64))

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray):
        """Ends of segments: at a row's end if one is near, else after white space."""
        at, n = 0, len(raw)
        while at < n:
            end = min(at + SEGMENT, n)
            if end < n:
                k = np.searchsorted(offsets, end, "right") - 1
                if offsets[k] > at:
                    end = int(offsets[k])
                else:
                    limit = int(offsets[k + 1])
                    while True:
                        gaps = np.flatnonzero(self.white[raw[at:end]])
                        if len(gaps):
                            end = at + int(gaps[-1]) + 1
                            break
                        if end >= limit:
                            break
                        end = min(at + 2 * (end - at), limit)
            yield at, end
            at = end

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and first byte of each word, and for each row the place of its first word (one more at the end)."""
        hashes, firsts = [], []
        for at, end in self._cuts(raw, offsets):
            part = raw[at:end]
            inside = ~self.white[part]
            edge = np.zeros(len(part) + 1, bool)
            lo, hi = np.searchsorted(offsets, [at, end])
            inner = offsets[lo : hi + 1]
            edge[inner[(inner >= at) & (inner <= end)] - at] = True
            edge[0] = edge[-1] = True
            before = np.zeros(len(part), bool)
            before[1:] = inside[:-1]
            starts = np.flatnonzero(inside & (~before | edge[:-1]))
            after = np.zeros(len(part), bool)
            after[:-1] = inside[1:]
            ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
            if len(part) + 2 > len(self.up):
                up, down = powers(len(part) + 2, self.BASE), powers(len(part) + 2, pow(self.BASE, -1, 1 << 64))
            else:
                up, down = self.up, self.down
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(self.table[part] * up[: len(part)], out=sums[1:])
            hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)))
            firsts.append(starts + at)
        h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        s = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        return h, s, np.searchsorted(s, offsets)


def row_of(starts: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' starts with the total at the end."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def grams(h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside a row, and its row."""
    n = len(h) - k + 1
    rows = row_of(starts)
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.zeros(n, U)
    for i in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + h[i : i + n])
    ok = rows[:n] == rows[k - 1 :]
    return out[ok], rows[:n][ok]


def distinct(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, in order within the row, and the rows' starts. Rows are in order already."""
    order = np.lexsort((values, rows)) if len(values) else np.zeros(0, np.int64)
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, np.searchsorted(r, np.arange(n_rows + 1))
