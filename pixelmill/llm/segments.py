"""Cuts of a text that no pre-tokenizer used here ever crosses, and results kept per segment.

Both vocabularies split a text by one pattern before merging: runs of letters, digits, other
characters and white space, with English contractions and, in one of them, one space in
front. At the cuts below such a run always ends, whatever stands on either side, so a
segment has the same tokens alone as inside its text. Characters outside ASCII are cut only
if their class is plain from the bytes. Texts with a special token's string are never cut.

Segments repeat much more often than texts, so a task asks the tokenizer once per distinct
segment and gathers the rest with array indexing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pixelmill.llm.arrays import ranges, span_hashes

_L, _D, _P, _Q, _S, _W, _X = range(7)

_CLASS = np.full(256, _X, dtype=np.uint8)
_CLASS[:128] = _P
_CLASS[0x1C:0x20] = _X
_CLASS[9:14] = _W
_CLASS[32] = _S
_CLASS[39] = _Q
_CLASS[48:58] = _D
_CLASS[65:91] = _L
_CLASS[97:123] = _L

#: First bytes of the UTF-8 characters that may be white space.
_MAYBE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)
_SOLID = np.zeros(256, dtype=bool)
_SOLID[33:127] = True
_SOLID[0xC3:0xF5] = True
_SOLID[list(_MAYBE_SPACE)] = False


def _pairs() -> np.ndarray:
    cut = np.zeros((7, 7), dtype=bool)
    for a, b in ((_L, _P), (_L, _Q), (_L, _D), (_D, _L), (_D, _P), (_D, _Q), (_P, _L), (_P, _D)):
        cut[a, b] = True
    cut[np.ix_([_L, _D, _P, _Q], [_S, _W])] = True
    return cut.ravel()


_CUT = _pairs()


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the segments with the end of the data, first segment of each text and the total)."""
    n = len(data)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    cls = _CLASS[data]
    # U+00C0 to U+00FF are letters but for two signs
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    cls[at] = _L
    cls[at + 1] = _L
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = _CUT[cls[:-1] * np.uint8(7) + cls[1:]]
    if n > 2:
        cut[1 : n - 1] |= (cls[:-2] == _X) & (cls[1:-1] == _S) & _SOLID[data[2:]]
        cut[2:n] |= (cls[:-2] <= _Q) & (cls[1:-1] == _W) & (cls[2:] <= _Q)
    cut[offsets] = True
    cut[n] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts[:-1], offsets)


class Kept:
    """Results per distinct segment, found again by the segment's hash.

    ``ask`` takes the segments that are new and returns their integers one after the other
    and the number of integers of each. ``trim`` starts anew beyond ``limit`` segments.
    """

    def __init__(self, ask: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 1_000_000):
        self.ask, self.dtype, self.limit = ask, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.hash = np.empty(0, dtype=np.uint64)
        self.slot = np.empty(0, dtype=np.int64)
        self.start = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.values = np.empty(0, dtype=self.dtype)
        self.n_values = 0

    def trim(self) -> None:
        if len(self.hash) > self.limit:
            self.clear()

    def slots(self, data: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """For each segment the place of its result, good until the next ``trim``."""
        if hashes is None:
            hashes = span_hashes(data, starts[:-1], starts[1:])
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            where = first[new]
            flat, counts = self.ask([raw[a:b] for a, b in zip(starts[where].tolist(), starts[where + 1].tolist())])
            if self.n_values + len(flat) > len(self.values):
                grown = np.empty(2 * (self.n_values + len(flat)), dtype=self.dtype)
                grown[: self.n_values] = self.values[: self.n_values]
                self.values = grown
            self.values[self.n_values : self.n_values + len(flat)] = flat
            slot = len(self.start) + np.arange(len(new))
            self.start = np.concatenate([self.start, self.n_values + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.n_values += len(flat)
            self.slot = np.insert(self.slot, at[new], slot)
            self.hash = np.insert(self.hash, at[new], distinct[new])
            at = np.searchsorted(self.hash, distinct)
        return self.slot[at][back]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the segments one after the other, number of values of each)."""
        counts = self.count[slots]
        return self.values[ranges(self.start[slots], counts)], counts
