"""Shards of bounded bytes by extendible hashing.

A directory is indexed by the leading bits of a hash. A bucket covers all entries with its
prefix; only buckets over the byte limit split on one more bit, so each bucket has a depth
of its own. Bytes are first summed per fine cell of the hash, and all splits are then found
on these sums: the levels above a cell are its prefixes. Only cells that are themselves too
large are opened further.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.session import cut_lineage

BITS = 62


def _hash(keys: list[str]) -> Column:
    return F.call_function("shiftrightunsigned", F.xxhash64(*keys), F.lit(64 - BITS))


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _up(prefix: Column, by: Column) -> Column:
    return F.call_function("shiftright", prefix, by.cast("int"))


def _split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth): the first depth from low to high at which the cell's prefix fits."""
    wide = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    wide = wide.withColumn("prefix", _up(F.col("cell"), F.lit(high) - F.col("depth")))
    fits = wide.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") <= limit)
    placed = wide.select("cell", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"])
    return placed.groupBy("cell").agg(F.min("depth").alias("depth"))


def directory(
    docs: DataFrame, limit: int, keys: list[str], text: str = "text", fine: int = 6
) -> tuple[DataFrame, list[int]]:
    """(level, entry, depth, prefix, bytes, n_docs, fits) and the levels in use.

    An entry is a prefix of ``level`` bits and points to a bucket of ``depth`` bits or fewer
    than its own; several entries may point to the same. Nearly always one level holds all;
    only under entries that are too large by themselves there is another.
    """
    hashed = docs.select(
        _hash(keys).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")
    )
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    level = min(BITS, ceil(log2(total / limit)) + fine) if total > limit else 1
    low, rows, entries, levels = 0, hashed, None, []
    while True:
        cells = rows.groupBy(_prefix(F.col("h"), level).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_docs")
        )
        cells = cut_lineage(cells)
        placed = cut_lineage(cells.join(_split(cells, low, level, limit), "cell", "left"))
        last = level == BITS
        open_ = placed.filter(F.col("depth").isNull())
        depth = F.coalesce("depth", F.lit(BITS)) if last else F.col("depth")
        done = (placed if last else placed.filter(F.col("depth").isNotNull())).withColumn("depth", depth)
        done = done.withColumn("prefix", _up(F.col("cell"), F.lit(level) - F.col("depth")))
        whole = done.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n_docs").alias("n_docs"))
        part = done.select("cell", "depth", "prefix").join(whole, ["depth", "prefix"])
        part = part.select(
            F.lit(level).alias("level"),
            F.col("cell").alias("entry"),
            "depth",
            "prefix",
            "bytes",
            "n_docs",
            (F.col("bytes") <= limit).alias("fits"),
        )
        entries = part if entries is None else entries.unionByName(part)
        levels.append(level)
        if last or open_.isEmpty():
            return entries, levels
        cell = _prefix(F.col("h"), level).alias("cell")
        rows = hashed.select("h", "bytes", cell).join(open_.select("cell"), "cell", "left_semi")
        low, level = level + 1, min(BITS, level + 8)


def shard(
    docs: DataFrame, limit: int, keys: list[str] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs, fits) of every row.

    ``limit`` bounds the bytes of the texts of a shard. The hash is that of ``keys``, the id
    and the text by default, so many rows of one id spread; rows that are equal in them can't
    be told apart by a hash and stay together. A bucket that has reached the last bit, such
    as a single text above the limit, is a shard of its own with ``fits`` false. ``shard_id``
    is the bucket's first hash value, so ids ascend along the directory. Null and empty texts
    count 0 bytes. An empty table has no shards. Other columns are not looked at.
    """
    keys = keys or [doc_id, text]
    entries, levels = directory(docs, limit, keys, text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        _hash(keys).alias("h"),
    )
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), _prefix(F.col("h"), n).alias("entry")) for n in levels]))
    rows = rows.withColumn("at", at).select("doc_id", "n_bytes", "at.level", "at.entry")
    shard_id = F.call_function("shiftleft", F.col("prefix"), (F.lit(BITS) - F.col("depth")).cast("int"))
    return rows.join(entries, ["level", "entry"]).select(
        "doc_id",
        "n_bytes",
        shard_id.alias("shard_id"),
        "depth",
        F.col("bytes").alias("shard_bytes"),
        F.col("n_docs").alias("shard_docs"),
        "fits",
    )
