"""Removing passages that recur, with sharded Aho-Corasick automata.

Texts are dealt into parts of bounded size, each distinct text once. Every window of words
has an anchor, the 8-word phrase in it with the smallest hash, so equal windows have equal
anchors. Only windows whose anchor recurs somewhere can recur themselves.

1. Anchors of all parts meet in hash buckets; those that occur twice go back to their parts.
2. Hashes of the windows with such anchors meet in the same way, which confirms what recurs.
3. Each part compiles the confirmed passages of its texts, runs of consecutive windows, into
   one automaton over words, streams all its texts through it and marks every occurrence.

The three steps read one shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import Words, lists, ngram_hashes

ANCHOR = 8
_HASHES = "bucket int, part int, hashes binary, twice binary"
_KNOWN = "part int, hashes binary"


class Part:
    """The texts of one part in a fixed order, their words, windows and anchors."""

    def __init__(self, rows: pa.Table, window: int):
        rows = rows.select(["k1", "k2", "text"]).sort_by([("k1", "ascending"), ("k2", "ascending")])
        self.rows = rows.combine_chunks()
        col = pa.concat_arrays([c.cast(pa.large_string()) for c in rows.column("text").chunks] or [pa.array([], pa.large_string())])
        _, off, raw = col.buffers()
        self.offsets = np.frombuffer(off, dtype=np.int64)[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
        self.data = np.frombuffer(raw, dtype=np.uint8)[: self.offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.words = w = Words(self.data, self.offsets)
        self.window = window
        hashes = w.hashes
        at = np.arange(max(0, len(hashes) - window + 1))
        doc = w.doc()
        #: first words of the windows, none across texts
        self.at = at[doc[at] == doc[at + window - 1]] if len(at) else at
        self.hash = ngram_hashes(hashes, window)[self.at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the hash of its anchor and the anchor's place, the first of equals."""
        size = min(ANCHOR, self.window)
        g = ngram_hashes(self.words.hashes, size)
        span = self.window - size + 1
        if not len(self.at):
            return np.empty(0, dtype=np.uint64), self.at

        def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(g[b] < g[a], b, a)

        # the smallest of ``width`` values from each place on, by doubling
        low, width = np.arange(len(g)), 1
        while 2 * width <= span:
            low, width = better(low[:-width], low[width:]), 2 * width
        n = len(g) - span + 1
        low = better(low[:n], low[span - width : span - width + n])[self.at]
        return g[low], low


def _dealt(hashes: np.ndarray, twice: np.ndarray, part: int, buckets: int) -> pa.Table:
    """A row per bucket with its hashes and whether they occur twice in this part already."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    hashes, twice = hashes[order], twice[order].astype("u1")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "part": pa.array([part] * len(full), pa.int32()),
            "hashes": pa.array([hashes[cuts[k] : cuts[k + 1]].astype("<u8").tobytes() for k in full], pa.binary()),
            "twice": pa.array([twice[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
        }
    )


def _anchors(window: int, buckets: int, rows: pa.Table) -> pa.Table:
    found, place = Part(rows, window).anchors()
    # places ascend, so windows with the same anchor follow each other
    new = np.append(True, np.diff(place) > 0) if len(place) else np.empty(0, dtype=bool)
    hashes, counts = np.unique(found[new], return_counts=True)
    return _dealt(hashes, counts > 1, rows.column("part")[0].as_py(), buckets)


def _recurring(rows: pa.Table) -> pa.Table:
    """Of one bucket: for each part its hashes that occur twice or more in all parts."""
    blobs = [np.frombuffer(b, dtype="<u8") for b in rows.column("hashes").to_pylist()]
    twice = np.frombuffer(b"".join(rows.column("twice").to_pylist()), dtype="u1")
    flat = np.concatenate(blobs)
    order = np.argsort(flat, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1], [True]]))
    many = np.add.reduceat(1 + twice[order].astype(np.int64), edge[:-1]) > 1
    keep = np.zeros(len(flat), dtype=bool)
    keep[order] = np.repeat(many, np.diff(edge))
    ends = np.cumsum([len(b) for b in blobs])
    parts, out = [], []
    for p, b, k in zip(rows.column("part").to_pylist(), blobs, np.split(keep, ends[:-1])):
        if k.any():
            parts.append(p)
            out.append(b[k].tobytes())
    return pa.table({"part": pa.array(parts, pa.int32()), "hashes": pa.array(out, pa.binary())})


def _among(values: np.ndarray, known: pa.Table) -> np.ndarray:
    if not known.num_rows or not len(values):
        return np.zeros(len(values), dtype=bool)
    k = np.sort(np.frombuffer(b"".join(known.column("hashes").to_pylist()), dtype="<u8"))
    at = np.minimum(np.searchsorted(k, values), len(k) - 1)
    return k[at] == values


def _windows(window: int, buckets: int, rows: pa.Table, known: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _dealt(np.empty(0, np.uint64), np.empty(0, bool), 0, buckets)
    p = Part(rows, window)
    hashes, counts = np.unique(p.hash[_among(p.anchors()[0], known)], return_counts=True)
    return _dealt(hashes, counts > 1, rows.column("part")[0].as_py(), buckets)


class Alphabet:
    """Each word a character, so that the automaton reads words; two characters if many."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.width = 1 if len(vocabulary) < 1_000_000 else 2

    @staticmethod
    def _char(code: np.ndarray) -> np.ndarray:
        # skip the range that is not characters
        return (code + np.where(code >= 0xD800, 0x800, 0)).astype("<u4")

    def spell(self, hashes: np.ndarray) -> str:
        """Words outside the vocabulary are all the same character, which no pattern has."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == hashes, at + 2, 1)
        if self.width == 2:
            code = np.stack([0x10000 + code // 50_000, 1 + code % 50_000], axis=1).ravel()
        return self._char(code).tobytes().decode("utf-32-le")


def covered(words: Words, flagged: np.ndarray, window: int) -> np.ndarray:
    """Words that occurrences of the passages cover; ``flagged`` are first words of windows."""
    import ahocorasick

    out = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    if not len(flagged):
        return out[:-1].astype(bool)
    doc = words.doc()
    new = np.append(True, (np.diff(flagged) > 1) | (doc[flagged[1:]] != doc[flagged[:-1]]))
    starts = flagged[new]
    ends = flagged[np.append(np.flatnonzero(new)[1:] - 1, len(flagged) - 1)] + window
    inside = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    alphabet = Alphabet(np.unique(words.hashes[np.cumsum(inside[:-1]) > 0]))
    text = alphabet.spell(words.hashes)
    k = alphabet.width
    automaton = ahocorasick.Automaton()
    for a, b in zip((starts * k).tolist(), (ends * k).tolist()):
        automaton.add_word(text[a:b], (b - a) // k)
    automaton.make_automaton()
    for a, b in zip((words.range[:-1]).tolist(), (words.range[1:]).tolist()):
        # overlapping matches are all wanted: only the longest that ends at a place counts
        last, longest = -1, 0
        for end, n in automaton.iter(text[a * k : b * k]):
            end = a + (end + 1) // k
            if end == last and n <= longest:
                continue
            last, longest = end, n
            out[end - n] += 1
            out[end] -= 1
    return np.cumsum(out[:-1]) > 0


_OUT = "k1 long, k2 long, n_words long, spans array<struct<start:int,length:int>>, kept_text string"


def _located(window: int, rows: pa.Table, known: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _result([], [], [], [], [])
    p = Part(rows, window)
    gone = covered(p.words, p.at[_among(p.hash, known)], window)
    w = p.words
    kept, spans = [], []
    raw = p.data.tobytes()
    for i, (a, b) in enumerate(zip(w.range[:-1].tolist(), w.range[1:].tolist())):
        here = gone[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
        spans.append([{"start": s, "length": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
        words = raw[p.offsets[i] : p.offsets[i + 1]].split()
        if len(edges):
            words = [x for x, g in zip(words, here.tolist()) if not g]
        kept.append(b" ".join(words).decode())
    return _result(p.rows.column("k1"), p.rows.column("k2"), w.counts, spans, kept)


def _result(k1, k2, n, spans, kept) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    names = ["k1", "k2", "n_words", "spans", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string()]
    cols = [c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip((k1, k2, n, spans, kept), kinds)]
    return pa.table(cols, names=names)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text this task has not seen yet."""
    seen: set = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        fresh = [k not in seen and not seen.add(k) for k in keys]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def keys(text: str = "text") -> list:
    """Two hashes that stand for a text; null is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.crc32(t).alias("k2")]


def recurring_passages(
    docs: DataFrame, window: int = 35, part_bytes: int = 4 << 20, text: str = "text"
) -> DataFrame:
    """(k1, k2, n_words, spans, kept_text) per distinct text.

    ``spans`` are the removed ranges of words, ``kept_text`` the other words joined by one
    space. A word goes if a window of ``window`` words covers it whose words also start
    anywhere else, in the same text too. That a whole text occurs in several rows is not
    looked at here but in ``decide``. Memory: a part, which is ``part_bytes`` of texts
    or a single longer text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, ceil(total / part_bytes))
    part = F.pmod(F.xxhash64("k1", "k2"), F.lit(parts)).cast("int").alias("part")
    rows = docs.select(*keys(text), t.alias("text")).mapInArrow(_once, "k1 long, k2 long, text string")
    n = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # one shuffle by part; copies of a text meet there one by one, before a part is gathered
    rows = rows.select(part, "k1", "k2", "text").repartition(n, "part")
    rows = rows.groupBy("part", "k1", "k2").agg(F.first("text").alias("text"))
    by_part = rows.groupBy("part")
    anchors = by_part.applyInArrow(lambda t: _anchors(window, parts, t), _HASHES)
    known = anchors.groupBy("bucket").applyInArrow(_recurring, _KNOWN).groupBy("part")
    hashes = by_part.cogroup(known).applyInArrow(lambda t, k: _windows(window, parts, t, k), _HASHES)
    known = hashes.groupBy("bucket").applyInArrow(_recurring, _KNOWN).groupBy("part")
    return by_part.cogroup(known).applyInArrow(lambda t, k: _located(window, t, k), _OUT)


def decide(passages: DataFrame, docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """(k1, k2, n_words, n_removed, whole) and the passages' other columns, per distinct text.

    Adds to ``recurring_passages`` that a text which several rows of ``docs`` have is removed
    whole from all of them, if it has a window at all. Rows find their text by ``keys``.
    Null texts are empty. Repeated rows and ids each count; an empty table gives no rows.
    """
    copies = docs.select(*keys(text)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_copies"))
    whole = ((F.col("_copies") > 1) & (F.col("n_words") >= window)).alias("whole")
    cut = passages.join(copies, ["k1", "k2"]).select("*", whole)
    spans = F.aggregate("spans", F.lit(0), lambda n, s: n + s["length"]).cast("long")
    return cut.withColumn("n_removed", F.when(F.col("whole"), F.col("n_words")).otherwise(spans)).drop("_copies", "spans")
