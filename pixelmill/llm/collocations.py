"""Collocation mining with count streams in prefix and suffix order.

Words are counted first, then short keys of pairs of frequent words, keys of longer phrases
of frequent pairs, and at last the phrases themselves that have a frequent key. The counts are then laid out twice, as streams sorted by a phrase's words
and by its words from the last to the first. In prefix order all beginnings of a phrase
stand before it and its right extensions after it; in suffix order the same holds for its
endings and left extensions. One walk in step with each stream therefore finds left, right
and extension counts with a stack as deep as a phrase is long, and no table of counts is
ever looked up by hash. The empty phrase is the root of a language and counts its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import mix, span_hashes
from pixelmill.operators.ordered import row_index
from pixelmill.session import cut_lineage, parallelism

#: Bytes of text counted at once.
BLOCK = 8 << 20
#: Bits of the filters that texts are read through; their 8 MB don't depend on the phrases.
FILTER_BITS = 26
#: Bits of a phrase's key; equal keys of different phrases only cost time.
KEY_BITS = 40
#: Words per bucket of keys.
BUCKET = 4 << 20

_U = np.uint64
_PAIR = _U(0x9E3779B97F4A7C15)

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Block:
    """Words of some text as numbers, with each word's language and whether the next one follows it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: pa.Array):
        data = _LOWER[data]
        inside = ~_GAP[data]
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        raw = pa.py_buffer(np.ascontiguousarray(data[inside]))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), raw)
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        text = np.searchsorted(offsets, starts, side="right") - 1
        self.lang = langs[text]
        self.names = names
        # a break lies between two words if the count of breaks differs
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        self.follows = (breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1])

    @property
    def base(self) -> int:
        return max(1, len(self.words))

    def singles(self) -> np.ndarray:
        """A number for each word together with its language."""
        return self.lang * self.base + self.code

    def word_hashes(self) -> np.ndarray:
        return text_hashes(self.words)

    def lang_hashes(self) -> np.ndarray:
        return text_hashes(self.names)[self.lang]


def text_hashes(strings: pa.Array) -> np.ndarray:
    strings = strings.cast(pa.large_string())
    _, offs, raw = strings.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return span_hashes(data, off[:-1], off[1:]) if len(strings) else np.empty(0, dtype=np.uint64)


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """Blocks of a batch of (lang, text); a long text is cut where no phrase can cross."""
    names = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
    langs = names.indices.to_numpy().astype(np.int64)
    col = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    _, offs, raw = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo, end = int(off[0]), int(off[-1])
    while lo < end:
        hi = min(lo + BLOCK, end)
        while hi < end:
            breaks = np.flatnonzero(_BREAK[data[hi : hi + BLOCK]])
            stop = int(off[np.searchsorted(off, hi)])
            if len(breaks):
                stop = min(stop, hi + int(breaks[0]) + 1)
            hi = min(stop, hi + BLOCK)
            if hi == stop:
                break
        a = int(np.searchsorted(off, lo, side="right")) - 1
        b = int(np.searchsorted(off, hi, side="left"))
        own = np.clip(off[a : b + 1] - lo, 0, hi - lo)
        yield Block(data[lo:hi], own, langs[a:b], names.dictionary)
        lo = hi


def single_hash(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word + lang * _PAIR)


def passes(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = h & _U((1 << FILTER_BITS) - 1)
    return (bitmap[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1


def _rows(names: pa.Array, lang: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    cols = [names.take(pa.array(lang)), phrase.cast(pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "n"])


def _joined(b: Block, places: np.ndarray, n: int) -> pa.Array:
    parts = [b.words.take(pa.array(b.code[places + k])) for k in range(n)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, and the empty phrase once per word."""
    for batch in batches:
        for b in blocks(batch):
            keys, n = np.unique(b.singles(), return_counts=True)
            if not len(keys):
                continue
            lang, code = np.divmod(keys, b.base)
            yield _rows(b.names, lang, b.words.take(pa.array(code)), n)
            some, n = np.unique(b.lang, return_counts=True)
            yield _rows(b.names, some, pa.array([""] * len(some)), n)


def extended(h: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word, which stands at ``at``."""
    return mix(h * _PAIR + words[at])


def keys_of(h: np.ndarray) -> np.ndarray:
    return h >> _U(64 - KEY_BITS)


def pairs_of(b: Block, words: np.ndarray, single: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a frequent pair begins at a word, places of those that do, their hashes)."""
    pair = b.follows.copy()
    at = np.flatnonzero(pair)
    h = extended(single[at], words, at + 1)
    ok = passes(keys_of(h), frequent)
    pair[at] = ok
    return pair, at[ok], h[ok]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, all first bytes together and so on, as they compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


_KEY_BYTES, _COUNT_BYTES = KEY_BITS // 8, 4


def _key_rows(keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, keys, counts): distinct keys as differences of sorted ones."""
    keys, n = np.unique(keys, return_counts=True)
    edges = np.arange(1, buckets, dtype=np.uint64) * _U((1 << KEY_BITS) // buckets)
    bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = []
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        if lo < hi:
            steps = np.diff(keys[lo:hi], prepend=_U(0))
            rows.append((k, _planes(steps, _KEY_BYTES), _planes(n[lo:hi].astype(np.uint64), _COUNT_BYTES)))
    cols = list(zip(*rows)) or [[], [], []]
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["bucket", "keys", "counts"])


def count_pair_keys(frequent, buckets: int):
    """Keys of pairs of words that pass the filter of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                words = b.word_hashes()[b.code]
                single = single_hash(words, b.lang_hashes())
                ok = passes(single, frequent.value)
                at = np.flatnonzero(b.follows & ok[:-1] & ok[1:])
                yield _key_rows(keys_of(extended(single[at], words, at + 1)), buckets)

    return run


def count_longer_keys(frequent, buckets: int, longest: int):
    """Keys of phrases of 3 to ``longest`` words, all pairs of which pass the filter of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                words = b.word_hashes()[b.code]
                single = single_hash(words, b.lang_hashes())
                pair, at, h = pairs_of(b, words, single, frequent.value)
                found = []
                for n in range(3, longest + 1):
                    on = at + n - 2 < len(pair)
                    on[on] = pair[at[on] + n - 2]
                    at = at[on]
                    h = extended(h[on], words, at + n - 1)
                    found.append(keys_of(h))
                yield _key_rows(np.concatenate(found), buckets)

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


def frequent_keys(min_count: int, most: int = 8_000_000):
    """Filter bits of keys that reach ``min_count``; a partition's buckets come one after the other."""

    def bits(keys: list, counts: list) -> pa.RecordBatch:
        k, n = _summed(keys, counts)
        return _bits(k[n >= min_count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, size = None, [], [], 0
        for batch in batches:
            for bucket, k, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now and keys:
                    yield bits(keys, counts)
                    keys, counts, size = [], [], 0
                now = bucket
                keys.append(np.cumsum(_from_planes(k, _KEY_BYTES), dtype=np.uint64))
                counts.append(_from_planes(n, _COUNT_BYTES).astype(np.int64))
                size += len(keys[-1])
                if size > most:
                    # what is the same so far becomes one
                    some = _summed(keys, counts)
                    keys, counts, size = [some[0]], [some[1]], 0
        if keys:
            yield bits(keys, counts)

    return run


_RUNS = "bucket int, lang string, phrases array<string>, counts array<long>"


def count_phrases(pairs, longer, buckets: int, longest: int):
    """Phrases of 2 to ``longest`` words whose own key, and that of all their beginnings, is frequent.

    A block gives one row per bucket and language, with its phrases and their counts.
    """
    width = _U((1 << KEY_BITS) // buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                words = b.word_hashes()[b.code]
                single = single_hash(words, b.lang_hashes())
                pair, at, h = pairs_of(b, words, single, pairs.value)
                ids = b.singles()[at]
                found = []
                for n in range(2, longest + 1):
                    if n > 2:
                        on = at + n - 2 < len(pair)
                        on[on] = pair[at[on] + n - 2]
                        at, ids = at[on], ids[on]
                        h = extended(h[on], words, at + n - 1)
                        on = passes(keys_of(h), longer.value)
                        at, ids, h = at[on], ids[on], h[on]
                    if not len(at):
                        break
                    ids = ids * b.base + b.code[at + n - 1]
                    _, first, ids, times = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
                    bucket = (keys_of(h[first]) // width).astype(np.int64)
                    found.append((b.lang[at[first]], bucket, _joined(b, at[first], n), times))
                if not found:
                    continue
                lang, bucket, phrases, counts = zip(*found)
                lang, bucket = np.concatenate(lang), np.concatenate(bucket)
                order = np.lexsort((bucket, lang))
                lang, bucket = lang[order], bucket[order]
                first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1])]))
                bounds = pa.array(np.append(first, len(order)).astype(np.int32))
                phrases = pa.chunked_array(phrases).take(pa.array(order)).combine_chunks().cast(pa.string())
                cols = [
                    pa.array(bucket[first], pa.int32()),
                    b.names.take(pa.array(lang[first])),
                    pa.ListArray.from_arrays(bounds, phrases),
                    pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(counts)[order], pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "lang", "phrases", "counts"])

    return run


def merge_runs(min_count: int, most: int = 2_000_000):
    """(lang, phrase, f) of frequent phrases from rows of ``count_phrases`` sorted by bucket and language."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).group_by("phrase").aggregate([("n", "sum")])
        return table.rename_columns(["phrase", "n"])

    def frequent(lang: str, parts: list[pa.Table]) -> pa.RecordBatch:
        table = summed(parts)
        table = table.filter(pc.greater_equal(table["n"], min_count)).combine_chunks()
        names = pa.array([lang] * len(table), pa.string())
        cols = [names, *(pa.array(c.to_pylist(), t) for c, t in zip(table.columns, (pa.string(), pa.int64())))]
        return pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for row, key in enumerate(keys):
                if key != now and parts:
                    yield frequent(now[1], parts)
                    parts, size = [], 0
                now = key
                parts.append(pa.table([batch.column(c)[row].values for c in (2, 3)], names=["phrase", "n"]))
                size += len(parts[-1])
                if size > most:
                    parts, size = [summed(parts)], 0
        if parts:
            yield frequent(now[1], parts)

    return run


def _bits(keys: np.ndarray) -> pa.RecordBatch:
    at = keys & _U((1 << FILTER_BITS) - 1)
    bit = (_U(1) << (at & _U(63))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int32)), pa.array(bit)], ["w", "b"])


def _word_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _bits(single_hash(text_hashes(batch.column(1)), text_hashes(batch.column(0))))


def _filter(bits: DataFrame):
    """A broadcast bitmap from (w, b), of fixed size."""
    table = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return bits.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def phrase_counts(docs: DataFrame, min_count: int, longest: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, f) of all phrases that occur ``min_count`` times or more, and of the empty one.

    What the filters leave out can't be frequent; what they let pass by chance is counted in
    full, so counts are exact.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    words = rows.mapInArrow(count_words, "lang string, phrase string, n long")
    words = words.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = cut_lineage(words.filter((F.col("f") >= min_count) | (F.col("phrase") == "")))
    if longest < 2:
        return words
    frequent = words.filter("phrase <> ''").select("lang", "phrase").mapInArrow(_word_bits, "w int, b long")
    total = words.filter("phrase = ''").agg(F.sum("f")).first()[0] or 0
    # a bucket is some millions of pairs, whatever the table's size
    buckets = 1 << min(16, max(parallelism(docs.sparkSession), total // BUCKET).bit_length())

    def frequent_filter(run):
        keys = rows.mapInArrow(run, "bucket int, keys binary, counts binary")
        keys = keys.repartition("bucket").sortWithinPartitions("bucket")
        return _filter(keys.mapInArrow(frequent_keys(min_count), "w int, b long"))

    pairs = frequent_filter(count_pair_keys(_filter(frequent), buckets))
    longer = frequent_filter(count_longer_keys(pairs, buckets, longest)) if longest > 2 else None
    runs = rows.mapInArrow(count_phrases(pairs, longer, buckets, longest), _RUNS)
    runs = runs.repartition("bucket").sortWithinPartitions("bucket", "lang")
    phrases = cut_lineage(runs.mapInArrow(merge_runs(min_count), "lang string, phrase string, f long"))
    return words.unionByName(phrases)


class Chain:
    """The open phrase of a walk and the counts of its beginnings, the empty one first."""

    def __init__(self, lang: str | None = None, words: tuple = (), counts: tuple = ()):
        self.lang, self.words, self.counts = lang, list(words), list(counts)

    def step(self, lang: str, words: list[str], f: int | None) -> None:
        """Go to the next phrase of the stream; counts that other slices hold are None."""
        same = 0
        if lang == self.lang:
            least = min(len(words), len(self.words))
            while same < least and words[same] == self.words[same]:
                same += 1
            known = same + 1
        else:
            known = 0
        self.counts = self.counts[:known] + [None] * (len(words) + 1 - known)
        self.counts[len(words)] = f
        self.lang, self.words = lang, words


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[str], int]]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(4)))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a slice's walk ends, with the counts that the slice itself holds."""
    chain, at = Chain(), None
    for at, lang, words, f in _stream(batches):
        chain.step(lang, words, f)
    if at is not None:
        cols = [[at], [chain.lang], [chain.words], [chain.counts]]
        kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["at", "lang", "words", "counts"])


def carried(ends: list) -> dict[int, Chain]:
    """For each slice the chain that the slices before it leave: one row per slice comes in."""
    out, chain = {}, Chain()
    for row in sorted(ends, key=lambda r: r["at"]):
        out[row["at"]] = Chain(chain.lang, chain.words, chain.counts)
        chain.step(row["lang"], list(row["words"]), None)
        chain.counts = [c if c is not None else o for c, o in zip(row["counts"], chain.counts)]
    return out


_SIDES = "lang string, words array<string>, a long, n long, l array<long>, r array<long>, inside boolean"


def _walk(carry, backward: bool, percent: int):
    """Beginnings' (or endings') counts of each phrase, and phrases that an extension covers."""

    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
    names = ["lang", "words", "a", "n", "l", "r", "inside"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, rows = None, []
        for at, lang, words, f in _stream(batches):
            if chain is None:
                chain = carry.value[at]
            chain.step(lang, words, f)
            if len(words) < 2:
                continue
            own, shorter = (words[::-1], words[:-1][::-1]) if backward else (words, words[:-1])
            sides = chain.counts[1:-1]
            if backward:
                rows.append((lang, own, None, None, None, sides[::-1], None))
            else:
                rows.append((lang, own, f, chain.counts[0], sides, None, None))
            if len(shorter) > 1 and 100 * f >= percent * chain.counts[-2]:
                rows.append((lang, shorter, None, None, None, None, True))
            if len(rows) >= 20_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return run


def sides(counts: DataFrame, backward: bool, percent: int) -> DataFrame:
    """One walk over the counts in prefix order, or in suffix order if ``backward``."""
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    words = F.reverse(words) if backward else words
    stream = counts.select("lang", words.alias("words"), "f").repartitionByRange("lang", "words")
    stream = stream.sortWithinPartitions("lang", "words").withColumn("at", F.spark_partition_id())
    stream = cut_lineage(stream.select("at", "lang", "words", "f"))
    ends = stream.mapInArrow(_ends, "at int, lang string, words array<string>, counts array<long>").collect()
    carry = counts.sparkSession.sparkContext.broadcast(carried(ends))
    return stream.mapInArrow(_walk(carry, backward, percent), _SIDES)


def lowest_cut(a: int, n: int, l: list[int], r: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut, the first of equals."""
    k = min(range(len(l)), key=lambda i: 1000 * a * n // (l[i] * r[i]))
    return 1000 * a * n // (l[k] * r[k]), l[k], r[k]


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lowest_cut(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
        score, l, r = zip(*found) if found else ((), (), ())
        more = [pa.array(c, pa.int64()) for c in (l, r, score)]
        cols = [batch.column(0), batch.column(1), batch.column(2), more[0], more[1], batch.column(3), more[2]]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "a", "l", "r", "n", "score"])


def collocations(
    docs: DataFrame,
    min_count: int = 100,
    longest: int = 5,
    top: int = 2000,
    inside_percent: int = 100,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases.

    Words are runs of anything but space and tab, in lower case (A-Z), and phrases don't cross
    ``.,;:!?`` or a line break. Phrases of 2 to ``longest`` words that occur ``min_count`` times
    or more (a) are scored by floor(1000 a n / (l r)) at their lowest-scoring cut, with n words
    in the language and l and r occurrences of the two sides. A phrase inside a longer one that
    occurs ``inside_percent`` hundredths as often, or more, is left out. Ranks go by score, a, and
    the phrase in byte order.

    A null language is ``und``. Null and empty texts have no words; repeated rows count each
    time. Texts may be of any length, and other columns are not looked at. An empty table, or
    one without a frequent phrase, gives no rows.
    """
    counts = phrase_counts(docs, min_count, longest, text, lang)
    both = sides(counts, False, inside_percent).unionByName(sides(counts, True, inside_percent))
    rows = both.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", "l", "r", "inside")
    # in range order groups are whole without another exchange
    one = cut_lineage(rows).repartitionByRange("lang", "phrase").groupBy("lang", "phrase")
    one = one.agg(*[F.max(c).alias(c) for c in ("a", "n", "l", "r", "inside")])
    kind = "lang string, phrase string, a long, l long, r long, n long, score long"
    scored = one.filter(F.col("inside").isNull()).select("lang", "phrase", "a", "n", "l", "r").mapInArrow(_scores, kind)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = row_index(scored, ["lang"], order, "rank").filter(F.col("rank") < top)
    return ranked.select("lang", (F.col("rank") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
