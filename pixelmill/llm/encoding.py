"""Token ids of whole texts with the ``tokenizers`` library, for functions on Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from pixelmill.llm.arrays import span_hashes, texts
from pixelmill.llm.segments import Kept, segments


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values())


def encode(path: str, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after the other, and the number of ids of each."""
    flat, counts = [], []
    for i in range(0, len(some), 4096):
        ids = [e.ids for e in tokenizer(path).encode_batch_fast(some[i : i + 4096], add_special_tokens=False)]
        counts.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32))
    return np.concatenate(flat), np.concatenate(counts)


@lru_cache(maxsize=4)
def kept(path: str) -> Kept:
    return Kept(lambda new: encode(path, [s.decode() for s in new]), np.uint32)


class Encoded(NamedTuple):
    """Some consecutive texts of a batch."""

    first: int
    ids: np.ndarray
    #: each text's range in ids
    range: np.ndarray
    #: the segments' hashes, a stand-in for words; the same in every batch, task and process
    terms: np.ndarray
    term_range: np.ndarray


def encoded(batch: pa.RecordBatch, path: str, column: str = "text") -> Iterator[Encoded]:
    """Whole texts as the library encodes them, null as empty; special strings as its default."""
    known, special = kept(path), special_strings(path)
    for lo, hi, data, offsets in texts(batch, column):
        starts, first = segments(data, offsets)
        terms = span_hashes(data, starts[:-1], starts[1:])
        ids, counts = known.gather(known.slots(data, starts, terms))
        bounds = np.concatenate([[0], np.cumsum(counts)])[first]
        raw = data.tobytes()
        if any(s in raw for s in special):
            parts = np.split(ids, bounds[1:-1])
            for i in range(hi - lo):
                one = raw[offsets[i] : offsets[i + 1]]
                if any(s in one for s in special):
                    parts[i] = encode(path, [one.decode()])[0]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield Encoded(lo, ids, bounds, terms, first)
