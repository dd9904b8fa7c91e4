"""Splits, work lists and set numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.seeded import hash_order
from pixelmill.operators.ordered import row_index

# Set ranges of the rendered dataset.
SPLIT_RANGES = (("train", 0, 31), ("val", 32, 35), ("test", 36, 39))


def split_by_range(df: DataFrame, ranges=SPLIT_RANGES, col: str = "set_id") -> DataFrame:
    """Split from the set id; NULL outside all ranges."""
    out = F.lit(None).cast("string")
    for name, lo, hi in ranges:
        out = F.when(F.col(col).between(lo, hi), name).otherwise(out)
    return df.withColumn("split", out)


def _held_out(groups: DataFrame, by: list[str], key: str, frac: float, seed, none_if_single: bool):
    """(by.., key, _val): which groups are held out, in the order of a seeded hash."""
    sizes = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_index(
        groups.withColumn("_h", hash_order(seed, key)), by, ["_h", key], "_i"
    ).join(sizes, by)
    k = F.greatest(F.lit(1.0), F.rint(F.col("_n") * frac))
    if none_if_single:
        k = F.when(F.col("_n") > 1, k).otherwise(0.0)
    return ranked.select(*by, key, (F.col("_i") < k).alias("_val"))


def split_by_group(
    df: DataFrame, group: str, frac: float, seed: int, none_if_single: bool = False
) -> DataFrame:
    """Hold out whole groups: max(1, round(frac * groups)) of them."""
    groups = df.select(group).distinct().withColumn("_all", F.lit(0))
    val = _held_out(groups, ["_all"], group, frac, seed, none_if_single).drop("_all")
    return _mark(df, val, [group])


def split_within_source(
    df: DataFrame, source: str, key: str, frac: float, seed: int, none_if_single: bool = False
) -> DataFrame:
    """Stratified: hold out keys (rows or donors) separately within every source."""
    groups = df.select(source, key).distinct()
    val = _held_out(groups, [source], key, frac, seed, none_if_single)
    return _mark(df, val, [source, key])


def _mark(df, val, keys):
    out = df.join(val, keys, "left")
    name = F.when(F.coalesce(F.col("_val"), F.lit(False)), "val").otherwise("train")
    return out.withColumn("split", name).drop("_val")


def split_group_or_row(
    df: DataFrame,
    group: str,
    row: str,
    frac: float,
    seed: int,
    unknown: str = "unknown",
    min_groups: int = 5,
) -> DataFrame:
    """By group when there are at least five groups and all are known, else by row."""
    facts = df.agg(
        F.count_distinct(F.coalesce(F.col(group), F.lit(unknown))).alias("n"),
        F.max((F.coalesce(F.col(group), F.lit(unknown)) == unknown).cast("int")).alias("u"),
    ).first()
    by_group = facts["n"] >= min_groups and not facts["u"]
    return split_by_group(df, group if by_group else row, frac, seed)


def assign_set_ids(df: DataFrame, order: Sequence[str], start: int = 0, out: str = "new_set_id"):
    """Dense ids over the sorted rows, numbered slice by slice."""
    return row_index(df, [], list(order), out).withColumn(out, F.col(out) + start)


def work_list(sets: DataFrame, stride: int = 1, splits: Sequence[str] | None = None) -> DataFrame:
    """(split, set_id, src) frames to process from (split, set_id, frames) rows."""
    if splits:
        sets = sets.filter(F.col("split").isin(list(splits)))
    sets = sets.filter(F.col("frames") > 0)
    idx = F.sequence(F.lit(0).cast("bigint"), F.col("frames").cast("bigint") - 1, F.lit(stride).cast("bigint"))
    return sets.select("split", "set_id", F.explode(idx).alias("src"))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Work without a complete output: ``done`` has one row per (keys.., channel) file."""
    complete = (
        done.filter(F.col("channel").isin(list(channels)))
        .groupBy(*keys)
        .agg(F.count_distinct("channel").alias("_c"))
        .filter(F.col("_c") == len(channels))
    )
    return work.join(complete.select(*keys), list(keys), "left_anti")


def usable_frames(inventory: DataFrame, channels: Sequence[str], set_id: str = "set_id") -> DataFrame:
    """Per set the smallest file count over channels; sets lacking a channel are dropped."""
    counts = inventory.groupBy(set_id).agg(
        *[F.count_if(F.col("channel") == c).alias(c) for c in channels]
    )
    least = F.least(*channels) if len(channels) > 1 else F.col(channels[0])
    return counts.withColumn("frames", least).filter(F.col("frames") > 0)


def next_free_index(manifest: DataFrame, col: str = "base") -> DataFrame:
    """Smallest positive number that no name starts with: one row."""
    used = manifest.select(
        F.regexp_extract(col, r"^(\d+)", 1).try_cast("bigint").alias("u")
    ).filter(F.col("u").isNotNull()).distinct()
    zero = used.sparkSession.range(0, 1).select(F.col("id").alias("u"))
    after = used.filter(F.col("u") > 0).unionByName(zero).select((F.col("u") + 1).alias("u"))
    return after.join(used, "u", "left_anti").agg(F.min("u").alias("next_index"))
