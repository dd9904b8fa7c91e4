"""Finding short benchmark items inside long documents by size-partitioned MinHash.

Documents are partitioned by the number of their shingles, in powers of two. A signature has
as many bins as the class's largest document has shingles, and in each bin the smallest hash:
one permutation that suits the size, so that a short item's shingles have the same chance to
show in a long document as in a short one. Items are signed once per class. Equal bins make
candidates, which exact shingle containment verifies. An item of a few shingles might still
show in no bin: it is looked up by shingles, as many as cannot all be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import lists, mix, shingle_sets, signed, texts
from pixelmill.session import cut_lineage

#: Independent permutations; a shingle shows in one with a chance of 0.63 or more.
SEEDS = (0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD)
#: Classes of 2**0 to 2**39 shingles; no text is larger.
CLASSES = 40
#: Items of up to this many shingles show too rarely in a bin, and are looked up by shingles.
SHORT = 4
#: Bits of the filter that documents are read through; its 8 MB don't depend on the items.
FILTER_BITS = 26


def signature(values: np.ndarray, doc: np.ndarray, size_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its value) of all bins; ``size_class`` is each document's, keys depend on it."""
    keys, places = [], []
    shift = (63 - size_class[doc]).astype(np.uint64)
    for k, seed in enumerate(SEEDS):
        h = mix(values ^ np.uint64(seed))
        order = np.lexsort((h, doc))
        h, d, s = h[order], doc[order], shift[order]
        slot = h >> s
        first = np.ones(len(h), dtype=bool)
        first[1:] = (slot[1:] != slot[:-1]) | (d[1:] != d[:-1])
        salt = (size_class[d[first]] * len(SEEDS) + k + 1).astype(np.uint64)
        keys.append(mix(h[first] + mix(salt)))
        places.append(order[first])
    return np.concatenate(keys), np.concatenate(places)


def _class_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(n, 1))), CLASSES - 1).astype(np.int64)


def item_sets(items: DataFrame, words: int, item_id: str, text: str) -> DataFrame:
    """(item_id, n_item, shingles); items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts(batch, "text"):
                values, bounds = shingle_sets(data, offsets, words)
                n = pa.array(np.diff(bounds), pa.int64())
                own = batch.column(0).slice(lo, hi - lo)
                cols = [own, n, lists(signed(values), bounds, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "n_item", "shingles"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, n_item long, shingles array<long>").filter("n_item > 0")


def _item_keys(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (n, values) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                v = np.array(values, dtype=np.int64).view(np.uint64)
                # a document that holds the item is not much smaller than it
                least = int(_class_of(np.array([max(1, percent * n // 100)]))[0])
                some = np.arange(least, CLASSES)
                doc = np.repeat(np.arange(len(some)), n)
                key, _ = signature(np.tile(v, len(some)), doc, some)
                own = batch.column(0).slice(row, 1).take(pa.array(np.zeros(len(key), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([own, pa.array(signed(key))], ["item_id", "key"])

    return run


def _filter(shingles: DataFrame) -> np.ndarray:
    """A bitmap of all items' shingles, of fixed size, summed up by Spark word by word."""
    at = F.col("shingle").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    rows = shingles.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[[r["w"] for r in rows]] = [r["b"] for r in rows]
    return out.view(np.uint64)


def _passes(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = values & np.uint64((1 << FILTER_BITS) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def contained(
    docs: DataFrame,
    items: DataFrame,
    percent: int = 75,
    words: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(_row, doc_id, item_id, n_shared, n_item, containment) of each document that holds an item.

    Containment is the share of the item's distinct shingles, in lower case (A-Z), that the
    document has; pairs of ``percent`` hundredths or more are found. A text of fewer than
    ``words`` words is one shingle. Items and documents without words match nothing, null
    texts too. Repeated rows, repeated and null ids are searched each; ``_row`` tells rows
    apart. Either table may be empty, texts may be of any length, and other columns are not
    looked at. Items of up to 4 shingles are found without fail; of longer ones one in some
    hundred thousand may be missed. What is broadcast is a bitmap of 8 MB.
    """
    sets = cut_lineage(item_sets(items, words, item_id, item_text))
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter(sets.select(F.explode("shingles").alias("shingle"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts(batch, "text"):
                values, bounds = shingle_sets(data, offsets, words)
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                hit = _passes(values, bitmap.value)
                some = np.unique(doc[hit])
                if not len(some):
                    continue
                # documents without a shingle of any item have no bin in common with one
                number = np.full(hi - lo, -1)
                number[some] = np.arange(len(some))
                own = number[doc] >= 0
                size_class = _class_of(np.diff(bounds)[some])
                keys, place = signature(values[own], number[doc[own]], size_class)
                # a bin whose smallest hash is no item's shingle can't equal one of an item
                keys, place = keys[hit[own][place]], place[hit[own][place]]
                of = number[doc[own]][place]
                order = np.argsort(of, kind="stable")
                seen = np.searchsorted(of[order], np.arange(len(some) + 1))
                shared, sdoc = values[hit], number[doc[hit]]
                held = np.searchsorted(sdoc, np.arange(len(some) + 1))
                at = pa.array(some)
                cols = [
                    batch.column(0).slice(lo, hi - lo).take(at),
                    batch.column(1).slice(lo, hi - lo).take(at),
                    lists(signed(shared), held, pa.int64()),
                    lists(signed(keys[order]), seen, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["_row", "doc_id", "shared", "keys"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = cut_lineage(rows.mapInArrow(run, f"_row long, doc_id {kind}, shared array<long>, keys array<long>"))
    item_kind = sets.schema["item_id"].dataType.simpleString()
    signed_items = sets.filter(F.col("n_item") > SHORT).mapInArrow(_item_keys(percent), f"item_id {item_kind}, key long")
    pairs = found.select("_row", F.explode("keys").alias("key")).join(signed_items, "key").select("_row", "item_id")
    # of n shingles, at least as many as are needed are shared, so one of the first n - needed + 1 is
    first = F.slice("shingles", 1, (F.col("n_item") - F.ceil(F.col("n_item") * percent / 100) + 1).cast("int"))
    short = sets.filter(F.col("n_item") <= SHORT).select("item_id", F.explode(first).alias("key"))
    looked_up = found.select("_row", F.explode("shared").alias("key")).join(short, "key").select("_row", "item_id")
    pairs = pairs.unionByName(looked_up).distinct()
    n = F.size(F.array_intersect("shingles", "shared")).cast("long")
    both = pairs.join(found.drop("keys"), "_row").join(sets, "item_id").withColumn("n_shared", n)
    share = (F.col("n_shared") / F.col("n_item")).alias("containment")
    return both.filter(100 * F.col("n_shared") >= percent * F.col("n_item")).select(
        "_row", "doc_id", "item_id", "n_shared", "n_item", share
    )
