"""Quality rules: text statistics, and lines that many documents of a host share.

A line is normalised to its words in lower case (A-Z), and hashed. Per host the distinct
documents that have it are counted; lines above the limits are removed from all documents,
and a document that loses most of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import Words, is_space, lists, run_hash, signed, span_hashes, texts
from pixelmill.llm.arrays import ngram_hashes
from pixelmill.session import cut_lineage

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: A line in this many pieces is joined piece by piece, so that no line is one task's load.
SALTS = 16


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """Per text: words in windows of n words that the text has twice or more."""
    g = ngram_hashes(w.hashes, n)
    counts = w.counts
    many = np.maximum(counts - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), many)
    at = np.repeat(w.range[:-1] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    values = g[at] if len(at) else np.empty(0, dtype=np.uint64)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    same = np.zeros(len(v) + 1, dtype=bool)
    same[1:-1] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice = at[order][same[1:] | same[:-1]]
    covered = np.zeros(len(w.starts), dtype=bool)
    for k in range(n):
        covered[twice + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[w.range])


class Lines:
    """Lines with a word: raw hash, hash of the lower-case words, number of words, text, place among the text's lines."""

    def __init__(self, w: Words):
        data, offsets = w.data, w.offsets
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        # a line ends before its line break
        ends -= (data[ends - 1] == 10) & (ends > starts) if len(ends) else 0
        first, last = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
        has = last > first
        self.starts, self.ends, first, last = starts[has], ends[has], first[has], last[has]
        self.raw = span_hashes(data, self.starts, self.ends)
        low = span_hashes(data, w.starts, w.ends, lower=True)
        self.key = run_hash(low, first, last)
        self.words = last - first
        self.range = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.range))
        self.number = np.searchsorted(breaks, self.starts) - np.searchsorted(breaks, offsets[self.doc])

    def repeated(self) -> np.ndarray:
        """Per text: lines equal to an earlier line."""
        order = np.lexsort((self.raw, self.doc))
        v, d = self.raw[order], self.doc[order]
        again = np.zeros(len(v), dtype=bool)
        again[1:] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        return np.bincount(d[again], minlength=len(self.range) - 1)


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_ROW = "_row long, row_key long, doc_id {kind}, host string, line array<long>, line_words array<int>, line_number array<int>, " + _STATS


def row_key(*columns: str) -> Column:
    """Tells rows apart by what they hold; rows that are equal in ``columns`` have the same."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Statistics of every row, with its lines' hashes, numbers of words and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts(batch, "text"):
                w = Words(data, offsets)
                lines = Lines(w)
                n = hi - lo
                own = batch.slice(lo, n)
                chars = (data & 0xC0) != 0x80
                longs = (
                    w.counts,
                    _per_text(chars & ~is_space(data), offsets),
                    _per_text(_SYMBOL[data], offsets),
                    lines.repeated(),
                    repeated_words(w),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(2),
                        own.column(4),
                        own.column(0),
                        own.column(3),
                        lists(signed(lines.key), lines.range, pa.int64()),
                        lists(lines.words, lines.range, pa.int32()),
                        lists(lines.number, lines.range, pa.int32()),
                        *(pa.array(v, pa.int64()) for v in longs),
                    ],
                    [c.split()[0] for c in _ROW.split(", ")],
                )

    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.monotonically_increasing_id().alias("_row"),
        # null is a host of its own
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"),
        row_key(doc_id, text, host).alias("row_key"),
    )
    return rows.mapInArrow(run, _ROW.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def line_frequency(
    docs: DataFrame,
    min_docs: int = 10,
    max_share: float = 0.1,
    max_docs: int = 100,
    keep_share: float = 0.5,
    min_words: int = 50,
    max_repeat: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """(_row, row_key, doc_id, statistics, n_lines_removed, n_words_left, base_failed, kept, removed) of every row.

    A line goes if more than ``min_docs`` documents of the host have it, and they are more than
    ``max_docs`` or more than ``max_share`` of the host's. Rows of one id are one document, each
    row without an id is one of its own, and equal texts of different documents count each. The
    line goes from all documents. ``kept`` is false if a document has under ``min_words`` words,
    if more than ``max_repeat`` of them stand in repeated 3-word windows, or if less than
    ``keep_share`` of them is left.

    Null and empty texts have no words and fail. A null host is a host of its own. Repeated
    rows are judged each. Texts may be of any length, and an empty table gives no rows. Other
    columns are not looked at. ``_row`` tells rows apart; ``row_key``
    finds the row again in ``docs``. ``removed`` are the places of the lines that go, from 0, for
    ``without_lines``.
    """
    stats = cut_lineage(text_statistics(docs, doc_id, text, host))
    document = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.col("_row").cast("string"))
    known = stats.select("host", F.xxhash64(document).alias("document"), F.array_distinct("line").alias("line"))
    sizes = known.select("host", "document").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    counts = (
        known.select("host", "document", F.explode("line").alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > min_docs)
    )
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    frequent = (
        counts.join(sizes, "host")
        .filter((F.col("n") > max_docs) | (F.col("n") > max_share * F.col("of")))
        .select("host", "line", salt)
    )
    both = F.inline(F.arrays_zip("line", "line_words", "line_number")).alias("line", "words", "number")
    lost = (
        stats.select("_row", "host", both)
        .withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        .join(frequent, ["host", "line", "salt"])
        .groupBy("_row")
        .agg(
            F.sum("words").alias("lost"),
            F.count(F.lit(1)).alias("n_lines_removed"),
            F.array_sort(F.collect_list("number")).alias("removed"),
        )
    )
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    names = [c.split()[0] for c in _STATS.split(", ")]
    return stats.join(lost, "_row", "left").select(
        "_row",
        "row_key",
        "doc_id",
        *names,
        F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        left.cast("long").alias("n_words_left"),
        failed.alias("base_failed"),
        (~failed & (left >= keep_share * F.col("n_words"))).alias("kept"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines at these places; the others as they are, to the byte."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(removed, i)), "\n")
