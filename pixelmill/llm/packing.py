"""Packing documents with their lexical neighbours into windows of equal length.

Documents are dealt into shards of bounded size. Each shard has a BM25 inverted index of its
own. A seed document opens a window; the index returns its unused neighbours, best first,
and they are put behind it until the window is full. What does not fit any more opens the
next window as its seed. A term is the 64-bit hash of a segment of the text
(``segments.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import ranges
from pixelmill.llm.encoding import encoded, kept

#: A term in more than one of so many documents has a row of weights, which is added as it is.
DENSE = 4


class Index:
    """BM25 inverted index of one shard: for each term the documents and their weights."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, n_docs: int, k1: float = 1.2, b: float = 0.75):
        self.n_docs = n_docs
        _, terms = np.unique(terms, return_inverse=True)
        pair, tf = np.unique(terms.astype(np.int64) * n_docs + docs, return_counts=True)
        term, self.doc = pair // n_docs, pair % n_docs
        self.df = np.bincount(term)
        self.start = np.cumsum(self.df) - self.df
        length = np.bincount(docs, minlength=n_docs)
        norm = k1 * (1 - b + b * length / max(length.mean(), 1))
        idf = np.log1p((n_docs - self.df + 0.5) / (self.df + 0.5))
        self.weight = idf[term] * tf * (k1 + 1) / (tf + norm[self.doc])
        # the other way: each document's terms that others have too
        own = np.flatnonzero(self.df[term] > 1)
        own = own[np.argsort(self.doc[own], kind="stable")]
        self.terms = term[own]
        self.of = np.searchsorted(self.doc[own], np.arange(n_docs + 1))
        # terms of many documents as rows, at most DENSE numbers for each posting
        many = np.flatnonzero(self.df * DENSE > n_docs)
        self.row = np.full(len(self.df), -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), n_docs))
        dense = np.flatnonzero(self.row[term] >= 0)
        self.rows[self.row[term[dense]], self.doc[dense]] = self.weight[dense]

    def scores(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents that share a term with the seed, and their scores against all its terms."""
        query = self.terms[self.of[seed] : self.of[seed + 1]]
        row = self.row[query]
        few = query[row < 0]
        at = ranges(self.start[few], self.df[few])
        if (row >= 0).any():
            score = self.rows[row[row >= 0]].sum(axis=0)
            score += np.bincount(self.doc[at], self.weight[at], self.n_docs)
            docs = np.flatnonzero(score)
            return docs, score[docs]
        # nothing as long as the shard, for shards of very many short documents
        docs, place = np.unique(self.doc[at], return_inverse=True)
        return docs, np.bincount(place, self.weight[at], len(docs))

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term, by falling score; ties by place."""
        docs, score = self.scores(seed)
        free = ~used[docs]
        docs, score = docs[free], score[free]
        page = 64
        while len(docs):
            best = np.arange(len(docs))
            if len(docs) > page:
                # all documents of the page's lowest score are on it
                best = np.flatnonzero(score >= -np.partition(-score, page - 1)[page - 1])
            yield from docs[best[np.lexsort((docs[best], -score[best]))]].tolist()
            docs, score = np.delete(docs, best), np.delete(score, best)
            page *= 8


def fill(lengths: np.ndarray, index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces; only the last may be shorter."""
    used = np.zeros(len(lengths), dtype=bool)
    windows: list[list[tuple[int, int, int]]] = []
    left = (0, 0)  # what the last window had no room for: document and start
    carry, ahead = False, 0
    while True:
        pieces: list[tuple[int, int, int]] = []
        room, near, asked = window, iter(()), -1
        while room:
            if carry:
                doc, start = left
            else:
                doc = next((d for d in near if not used[d]), -1)
                if doc < 0 and pieces and asked != pieces[-1][0]:
                    # all neighbours of the seed, and when they run out those of the last document
                    asked = pieces[-1][0] if asked >= 0 else pieces[0][0]
                    near = index.neighbours(asked, used)
                    continue
                if doc < 0:
                    while ahead < len(lengths) and used[ahead]:
                        ahead += 1
                    if ahead == len(lengths):
                        break
                    doc = ahead
                start, used[doc] = 0, True
            take = min(room, int(lengths[doc]) - start)
            pieces.append((doc, start, take))
            room -= take
            carry = start + take < lengths[doc]
            left = (doc, start + take)
        if pieces:
            windows.append(pieces)
        if room:
            return windows


def cut(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Split a window that isn't full into ones whose lengths are powers of two."""
    rest = sum(p[2] for p in pieces)
    while rest:
        room, out = 1 << (rest.bit_length() - 1), []
        rest -= room
        while room:
            doc, start, n = pieces[0]
            take = min(room, n)
            out.append((doc, start, take))
            room -= take
            pieces = pieces[1:] if take == n else [(doc, start + take, n - take), *pieces[1:]]
        yield out


def shards(
    batches: Iterator[pa.RecordBatch], path: str, shard_tokens: int
) -> Iterator[list[tuple[object, np.ndarray, np.ndarray, pa.DataType]]]:
    """Documents of one shard after the other: id, token ids, terms and the id's type."""
    known = kept(path)
    some, size = [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for e in encoded(batch, path):
            keys = batch.column(0).slice(e.first, len(e.range) - 1).to_pylist()
            for i, key in enumerate(keys):
                own = e.ids[e.range[i] : e.range[i + 1]]
                if some and size + len(own) >= shard_tokens:
                    yield some
                    some, size = [], 0
                terms = e.terms[e.term_range[i] : e.term_range[i + 1]]
                some.append((key, own.copy(), terms.copy(), kind))
                size += len(own) + 1
        known.trim()
    if some:
        yield some


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    window: int = 2048,
    shard_tokens: int = 2_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) per piece of a document.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit; each document ends
    with ``end_id``. All windows of a shard are full but the last, which is cut into
    sequences whose lengths are powers of two, so there is no padding. A shard is what a task
    reads, up to ``shard_tokens`` ids, or one document if that has more: no shuffle is
    needed, and memory does not grow with the table. Neighbours come from the same shard.

    A query is all words that the asking document shares with others; the answer is every
    unused document with one of them, best first, and only when it is used up another
    document is asked. Null and empty texts are documents of
    one id. Repeated rows and ids, null ids too, are packed each on their own; pieces are
    matched by sequence and offset, not by id. An empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 36)
        for some in shards(batches, path, shard_tokens):
            ids = [x for _, x, _, _ in some]
            lengths = np.array([len(x) + 1 for x in ids])
            words = [t for _, _, t, _ in some]
            docs_ = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in words])
            index = Index(docs_, np.concatenate(words), len(ids))
            windows = fill(lengths, index, window)
            if windows and (n := sum(p[2] for p in windows[-1])) < window and n & (n - 1):
                windows[-1:] = cut(windows[-1])
            rows = [(d, s, n, q, o) for p in windows for q in [next(number)] for (d, s, n), o in zip(p, _offsets(p))]
            for i in range(0, len(rows), 2000):
                d, s, n, q, o = zip(*rows[i : i + 2000])
                raw = [np.append(ids[x], np.uint32(end_id))[y : y + z].astype("<u4").tobytes() for x, y, z in zip(d, s, n)]
                own = pa.array([some[x][0] for x in d], some[0][3])
                whole = [int(lengths[x]) for x in d]
                yield pa.RecordBatch.from_arrays(
                    [own, *(pa.array(v, pa.int64()) for v in (s, n, whole, q, o)), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def _offsets(pieces: list[tuple[int, int, int]]) -> list[int]:
    return [sum(p[2] for p in pieces[:i]) for i in range(len(pieces))]
