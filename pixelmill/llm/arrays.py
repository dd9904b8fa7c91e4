"""Words and their hashes as arrays, for functions that run on Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D. All functions take the bytes of
many texts at once, so no Python loop runs over words. Hashes are 64-bit polynomials over
the bytes with a final mix; they are the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text is a piece of its own.
PIECE = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    plain = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    return plain, lower


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[0] = (out[0], out[1])
    return _powers[0][0][:n], _powers[0][1][:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A hash of each span data[start:end]; spans ascend. ``lower`` folds A-Z."""
    table = _byte_values()[lower]
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, side="right")))
        b = int(ends[j - 1])
        pw, inv = powers(b - a + 1)
        c = np.empty(b - a + 1, dtype=np.uint64)
        c[0] = 0
        np.cumsum(table[data[a:b]] * pw[: b - a], out=c[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


class Words:
    """Words of several texts: byte spans, hashes, and for each text its range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~is_space(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.range = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends, lower)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.range)

    def doc(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values; shorter than ``h`` by n - 1."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(len(h) - n + 1, dtype=np.uint64)
    step = 1 << 20
    for a in range(0, len(out), step):
        b = min(len(out), a + step)
        x = h[a : b + n - 1]
        pw, inv = powers(len(x))
        c = np.empty(len(x) + 1, dtype=np.uint64)
        c[0] = 0
        np.cumsum(x * pw, out=c[1:])
        out[a:b] = (c[n:] - c[:-n]) * inv[: b - a]
    return mix(out + _U(n * _BASE % (1 << 64)))


def run_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each slice h[lo:hi]; slices ascend and don't overlap."""
    pw, inv = powers(len(h) + 1)
    c = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * pw[: len(h)], out=c[1:])
    return mix((c[hi] - c[lo]) * inv[lo] + (hi - lo).astype(np.uint64) * _U(_BASE))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count values each, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, n: int = 5, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted, and each text's range in them.

    A text of fewer than n words has its whole sequence as one shingle, a text without
    words has none.
    """
    w = Words(data, offsets, lower)
    counts = w.counts
    g = ngram_hashes(w.hashes, n)
    many = np.maximum(counts - n + 1, 0)
    values = g[ranges(w.range[:-1], many)] if many.any() else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(counts)), many)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = run_hash(w.hashes, w.range[short], w.range[short + 1])
        values, doc = np.concatenate([values, whole]), np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(len(counts) + 1))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of about PIECE bytes each; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return
    _, offs, raw = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list array from flat values and each row's range in them."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
