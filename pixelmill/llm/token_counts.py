"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a pre-token stand in a doubly linked list and all adjacent pairs that may
merge in a heap. The pair of the lowest rank, leftmost first, is popped and merged until no
pair is left. The count is the number of first symbols less the number of merges; no token
is built. Each task merges a distinct segment once (``segments.py``).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import texts
from pixelmill.llm.encoding import special_strings, tokenizer
from pixelmill.llm.segments import Kept, segments

Merges = dict[tuple[str, str], tuple[int, str]]


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> Merges:
    """(left, right) -> (rank, merged symbol) of a byte-pair vocabulary file."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    return {p: (rank, p[0] + p[1]) for rank, p in enumerate(pairs)}


def merged_length(symbols: str, ranks: Merges) -> int:
    """Number of tokens of one pre-token, given as its byte symbols."""
    sym: list[str | None] = list(symbols)
    n = len(sym)
    heap = [(r[0], i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1])))]
    if not heap:
        return n
    heapq.heapify(heap)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # the pair at i may be gone or another one by now
        if sym[i] is None or j >= n or (now := ranks.get((sym[i], sym[j]))) is None or now[0] != rank:
            continue
        merges += 1
        sym[i], sym[j] = now[1], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if r := ranks.get((sym[i], sym[k])):
                heapq.heappush(heap, (r[0], i))
        if (h := before[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))):
            heapq.heappush(heap, (r[0], h))
    return n - merges


@lru_cache(maxsize=2)
def _kept(path: str) -> Kept:
    split, ranks = tokenizer(path).pre_tokenizer, merge_ranks(path)

    def count(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [sum(merged_length(p, ranks) for p, _ in split.pre_tokenize_str(s.decode())) for s in new]
        return np.array(found, dtype=np.uint32), np.ones(len(new), dtype=np.int64)

    return Kept(count, np.uint32)


def _one(text: bytes, path: str) -> int:
    """Of a text with special strings in it, each of which is one token."""
    for s in special_strings(path):
        if s in text:
            parts = text.split(s)
            return len(parts) - 1 + sum(_one(p, path) for p in parts)
    kept = _kept(path)
    starts, _ = segments(data := np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    return int(kept.gather(kept.slots(data, starts))[0].sum())


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the vocabulary's library counts them.

    Null and empty texts have 0 tokens; special strings inside a text are one token each, the
    library's default. Repeated rows and ids, null ids too, give a row each. Other columns
    are not looked at. A text is never cut; memory holds one text and the kept segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, special = _kept(path), special_strings(path)
        for batch in batches:
            kept.trim()
            n = []
            for lo, hi, data, offsets in texts(batch, "text"):
                starts, first = segments(data, offsets)
                per = kept.gather(kept.slots(data, starts))[0].astype(np.int64)
                found = np.diff(np.concatenate([[0], np.cumsum(per)])[first])
                raw = data.tobytes()
                if any(s in raw for s in special):
                    for i in range(hi - lo):
                        found[i] = _one(raw[offsets[i] : offsets[i + 1]], path)
                n.append(found)
            counts = np.concatenate(n) if n else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
