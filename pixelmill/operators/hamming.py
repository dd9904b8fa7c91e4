"""Nearest 64-bit hashes at any distance.

Hashes are collapsed first. A banded index settles what has a near neighbour, with a radius
that grows from round to round for the rest. Beyond a dozen bits any index on bands visits
most pairs, so what is left then is compared with the other side block by block, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import cut_lineage, parallelism

#: Radii of the index rounds.
ROUNDS = (7, 11)
#: More hashes than this under one band value are not looked up but compared in blocks.
CROWD = 1024
#: Hashes per block.
BLOCK = 8192


def _flip_masks(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits in ``width`` bits."""
    out = []
    for r in range(radius + 1):
        for bits in combinations(range(width), r):
            out.append(sum(1 << b for b in bits))
    return out


def _band_keys(hashes: DataFrame, cols: Sequence[str], bands: int, radius: int) -> DataFrame:
    """(cols.., band, key): each band value with up to ``radius`` bits flipped.

    Band i takes the bits i, i + bands, i + 2 bands, .. so that bits which hardly vary
    are shared out and no single band degenerates to a few values.
    """
    width = 64 // bands

    def band_value(i):
        v = F.lit(0).cast("bigint")
        for j in range(width):
            bit = F.shiftrightunsigned("hash", j * bands + i).bitwiseAND(F.lit(1).cast("bigint"))
            v = v.bitwiseOR(F.shiftleft(bit, j))
        return v

    masks = F.array(*[F.lit(m).cast("bigint") for m in _flip_masks(width, radius)])
    values = F.array(*[F.struct(F.lit(i).alias("band"), band_value(i).alias("v")) for i in range(bands)])
    d = hashes.select(*cols, F.inline(values))
    flipped = F.transform(masks, lambda m: m.bitwiseXOR(F.col("v")))
    return d.select(*cols, "band", F.explode(flipped).alias("key"))


def _banded(left: DataFrame, right: DataFrame, within: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """(nearest within a radius, hashes with a crowded band): the latter are not settled here.

    Exact: two hashes within t bits agree up to floor(t / bands) bits in at least one band,
    and that radius is split between the two sides.
    """
    radius = within // bands
    probes = _band_keys(left, ["hash"], bands, radius - radius // 2)
    targets = _band_keys(right, ["hash", "fid"], bands, radius // 2).withColumnRenamed("hash", "fh")
    crowds = targets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
    crowds = cut_lineage(crowds.select("band", "key"))
    held = left.limit(0)
    if not crowds.isEmpty():
        held = cut_lineage(probes.join(crowds, ["band", "key"], "left_semi").select("hash").distinct())
        targets = targets.join(crowds, ["band", "key"], "left_anti")
        probes = probes.join(held, "hash", "left_anti")
    d = F.bit_count(F.col("hash").bitwiseXOR(F.col("fh"))).cast("int")
    best = (
        probes.join(targets.hint("merge"), ["band", "key"])
        .select("hash", d.alias("d"), "fid")
        .filter(F.col("d") <= within)
        .groupBy("hash")
        .agg(F.min(F.struct("d", "fid")).alias("b"))
    )
    return cut_lineage(best), held


def _nearest_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            mine, theirs, ids = (batch.column(c)[row].values for c in range(3))
            # unsigned: of a negative number the bits of its absolute value would be counted
            a, b = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (mine, theirs))
            d, at = np.empty(len(a), dtype=np.int32), np.empty(len(a), dtype=np.int64)
            for i in range(0, len(a), 64):
                bits = np.bitwise_count(a[i : i + 64, None] ^ b[None, :])
                at[i : i + 64] = bits.argmin(axis=1)
                d[i : i + 64] = bits.min(axis=1)
            yield pa.RecordBatch.from_arrays([mine, pa.array(d), ids.take(pa.array(at))], ["hash", "d", "fid"])


def _by_blocks(left: DataFrame, right: DataFrame, n_left: int) -> DataFrame:
    """Nearest of all hashes of ``right``: each block of one side meets each of the other once."""
    spark = left.sparkSession
    n_right = right.count()
    theirs = max(1, -(-n_right // BLOCK))
    mine = max(-(-n_left // BLOCK), min(parallelism(spark), n_left // 64 + 1))
    groups = min(mine, parallelism(spark))

    def dealt(n: int):
        return F.pmod(F.xxhash64("hash"), F.lit(n)).cast("int")

    # in order of ids, so that the first of equally near ones has the lowest
    some = F.array_sort(F.collect_list(F.struct("fid", "hash")))
    right = right.groupBy(dealt(theirs).alias("block")).agg(some.alias("f"))
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    right = right.select("block", F.col("f.hash").alias("theirs"), F.col("f.fid").alias("ids"), each)
    left = left.groupBy(dealt(mine).alias("own")).agg(F.collect_list("hash").alias("mine"))
    left = left.select("mine", (F.col("own") % groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))).alias("block"))
    pairs = left.join(right.hint("merge"), ["block", "g"]).select("mine", "theirs", "ids")
    kind = pairs.schema["ids"].dataType.elementType.simpleString()
    found = pairs.mapInArrow(_nearest_in_block, f"hash long, d int, fid {kind}")
    return found.groupBy("hash").agg(F.min(F.struct("d", "fid")).alias("b"))


def nearest_hamming(cand: DataFrame, forbidden: DataFrame, max_distance: int | None = None, bands: int = 4) -> DataFrame:
    """Nearest forbidden 64-bit hash of every candidate, at any distance or up to a limit.

    Adds (min_distance, nearest_id). Both are NULL for a candidate without a hash, if no
    forbidden row has one, and beyond ``max_distance`` if that is given. Equal hashes are
    collapsed on both sides, so a flood of identical images costs one row. Ties: the lowest id.
    """
    limit = 64 if max_distance is None else max_distance
    right = cut_lineage(forbidden.filter("hash is not null").groupBy("hash").agg(F.min("id").alias("fid")))
    rest = cut_lineage(cand.select("hash").filter("hash is not null").distinct())
    rounds = [limit] if limit <= ROUNDS[-1] else list(ROUNDS)
    found = []
    for within in rounds:
        best, held = _banded(rest, right, within, bands)
        found.append(best)
        rest = cut_lineage(rest.join(best, "hash", "left_anti"))
        if limit == within:
            # nothing is that near, but for those that were not looked up
            rest = rest.join(held, "hash", "left_semi")
    n = rest.count()
    if n and not right.isEmpty():
        found.append(_by_blocks(rest, right, n).filter(F.col("b.d") <= limit))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    out = cand.join(best, "hash", "left")
    return out.select(*cand.columns, F.col("b.d").alias("min_distance"), F.col("b.fid").alias("nearest_id"))


def closest_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """(min_distance, id, nearest_id) of the nearest pair of two sets; NULL if one has no hash.

    Ties: the lowest id, then the lowest nearest_id.
    """
    near = nearest_hamming(a, b).filter("min_distance is not null")
    one = near.agg(F.min(F.struct("min_distance", "id", "nearest_id")).alias("p"))
    return one.select("p.min_distance", "p.id", "p.nearest_id")
