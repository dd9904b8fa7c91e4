"""Sorts, limits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.mix import dedup_content
from pixelmill.operators.ordered import first_n, row_index


def worst_frames(frames: DataFrame, k: int, min_px: int, frame: str = "frame_id") -> DataFrame:
    """Lowest recall among frames with at least ``min_px`` object pixels (tp + fn);
    equal recall: the larger object first."""
    px = F.col("tp") + F.col("fn")
    d = frames.withColumn("gt_px", px).filter(F.col("gt_px") >= max(min_px, 1))
    d = d.withColumn("recall", F.col("tp") / F.col("gt_px"))
    return d.orderBy("recall", F.desc("gt_px"), frame).limit(k)


def top_delta_distinct(df: DataFrame, k: int, by: str, delta: str, tie: str) -> DataFrame:
    """Largest improvement, at most one row per ``by``, k in all."""
    best = df.groupBy(by).agg(
        F.max(F.struct(F.col(delta), (-F.col(tie)).alias("_neg"))).alias("_b")
    )
    picked = best.select(by, F.col(f"_b.{delta}").alias(delta), (-F.col("_b._neg")).alias(tie))
    return picked.orderBy(F.desc(delta), tie).limit(k)


def rank_modes(df: DataFrame, mode: str = "mode", mass: str = "mass", by: Sequence[str] = ()):
    """Error modes by mass share. One row per mode comes in, so the window is tiny."""
    keys = list(by) or ["_all"]
    d = df if by else df.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*keys)
    total = F.sum(mass).over(w)
    share = F.when(total > 0, F.col(mass) / total).otherwise(0.0)
    rank = F.row_number().over(w.orderBy(F.desc(mass), mode))
    d = d.withColumns({"share": share, "rank": rank}).withColumn("dominant", F.col("rank") == 1)
    return d if by else d.drop("_all")


def cap_total(
    df: DataFrame,
    query: str,
    order: Sequence[str],
    per_query: int,
    total: int,
    sha: str = "sha",
    title: str | None = "title",
) -> DataFrame:
    """No repeated title or hash, at most ``per_query`` rows per query, then at most
    ``total`` rows in query order. ``order`` starts with the query order."""
    d = dedup_content(df, order, sha, title)
    d = first_n(d, per_query, [query], order)
    return first_n(d, total, [], order)


def extremity(
    df: DataFrame, mask: Column, direction: tuple[float, float], k: int, frame: str = "frame_id"
) -> DataFrame:
    """The k mask pixels farthest along (dx, dy) in every frame."""
    dx, dy = direction
    reach = F.col("x") * float(dx) + F.col("y") * float(dy)
    d = df.filter(mask).select(frame, "y", "x", reach.alias("reach"))
    w = Window.partitionBy(frame).orderBy(F.desc("reach"), "y", "x")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_rows(df: DataFrame, prob: str, thresh: float, min_kept: int, keys: Sequence[str]) -> DataFrame:
    """Rows whose true-class probability is at most the larger of ``thresh`` and the
    ``min_kept``-th smallest value.

    The k-th smallest comes from running counts over distinct values, so any
    ``min_kept`` works without a single-task sort.
    """
    from pixelmill.operators.ordered import running, value_counts

    counts = value_counts(df, [], prob)
    cum = running(counts, [], ["value"], {"_cum": ("sum", "n")})
    kth = cum.agg(
        F.coalesce(
            F.min(F.when(F.col("_cum") >= min_kept, F.col("value"))), F.max("value")
        ).alias("k")
    )
    limit = F.greatest(F.lit(float(thresh)), kth.scalar())
    return df.filter(F.col(prob) <= limit)


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Global 1-based rank without a one-task window."""
    return row_index(df, [], order, name).withColumn(name, F.col(name) + 1)
