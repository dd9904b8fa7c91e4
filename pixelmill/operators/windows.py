"""Neighbourhood operators on pixel tables.

A frame is one image, so its rows fit a task. Boxes and stencils take whole frames as
arrays after one exchange and one sort; two-dimensional boxes are done one axis at a
time. Other windows partition by the frame plus one axis: when the table is
hash-partitioned by frame they run without a further shuffle, only with local sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.operators.distance import Pass
from pixelmill.operators.raster import Morph, box_ranges, box_totals, grid_step, morphs, stencils


def _row(frame: str):
    return Window.partitionBy(frame, "y").orderBy("x")


def _col(frame: str):
    return Window.partitionBy(frame, "x").orderBy("y")


def runs(df: DataFrame, mask: Column, axis: str = "x", frame: str = "frame_id") -> DataFrame:
    """Consecutive foreground runs: (frame, line, start, stop) along one axis."""
    line = "y" if axis == "x" else "x"
    w = Window.partitionBy(frame, line).orderBy(axis)
    fg = df.filter(mask).select(frame, F.col(line), F.col(axis))
    return (
        fg.withColumn("_win_k", F.col(axis) - F.row_number().over(w))
        .groupBy(frame, line, "_win_k")
        .agg(F.min(axis).alias("start"), F.max(axis).alias("stop"))
        .select(frame, F.col(line).alias("line"), "start", "stop")
    )


def run_lengths(df: DataFrame, mask: Column, frame: str = "frame_id") -> DataFrame:
    """Lengths of all row and column runs."""
    parts = [
        runs(df, mask, axis, frame).select(
            frame,
            F.lit(axis).alias("axis"),
            "line",
            "start",
            (F.col("stop") - F.col("start") + 1).alias("length"),
        )
        for axis in ("x", "y")
    ]
    return parts[0].unionByName(parts[1])


def median_run_length(
    df: DataFrame, mask: Column, frame: str = "frame_id", min_px: int = 30
) -> DataFrame:
    """Median run length per frame; NULL below ``min_px`` foreground pixels."""
    r = run_lengths(df, mask, frame)
    px = F.sum(F.when(F.col("axis") == "x", F.col("length")))
    return r.groupBy(frame).agg(
        px.alias("px"), F.when(px >= min_px, F.median("length")).alias("median_run")
    )


def box_sums(
    df: DataFrame,
    values: dict[str, Column],
    win: int,
    size: tuple[int, int],
    border: str = "reflect",
    frame: str = "frame_id",
) -> DataFrame:
    """Add sums of each value in a win x win box around every pixel.

    ``border`` is reflect (mirrored rows are added before the window) or clip (the
    box is cut at the frame edge).
    """
    half, (h, w), mirror = win // 2, size, border == "reflect"
    d = df.filter(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)) if mirror else df
    kinds = d.select(*[c.alias(n) for n, c in values.items()]).schema
    whole = {n: isinstance(kinds[n].dataType, T.IntegralType) for n in values}
    fields = [T.StructField(n, T.LongType() if whole[n] else T.DoubleType()) for n in values]
    p = Pass(d, frame)
    p.given |= {f"_win_in_{n}": c.cast("double") for n, c in values.items()}

    def run(*grids):
        return [box_totals(v, ok, half, mirror) for v, ok, _ in grids]

    return p.step(*grid_step(list(p.given), run, fields, size if mirror else None)).run()


def box_stats(
    df: DataFrame,
    value: Column,
    win: int,
    size: tuple[int, int],
    border: str = "reflect",
    frame: str = "frame_id",
    prefix: str = "box",
) -> DataFrame:
    """Local mean, population std and count in a win x win box."""
    v = value.cast("double")
    d = box_sums(
        df, {"_win_s": v, "_win_q": v * v, "_win_n": F.lit(1).cast("bigint")}, win, size, border, frame
    )
    mean = F.col("_win_s") / F.col("_win_n")
    var = F.greatest(F.col("_win_q") / F.col("_win_n") - mean * mean, F.lit(0.0))
    return d.withColumns(
        {f"{prefix}_mean": mean, f"{prefix}_std": F.sqrt(var), f"{prefix}_n": F.col("_win_n")}
    ).drop("_win_s", "_win_q", "_win_n")


def masked_contrast(
    df: DataFrame,
    value: Column,
    mask: Column,
    win: int,
    size: tuple[int, int],
    min_bg: int = 8,
    frame: str = "frame_id",
    out: str = "contrast",
) -> DataFrame:
    """|mean over mask - mean over the rest| in the box; NULL with too little of either."""
    v, one = value.cast("double"), F.lit(1)
    d = box_sums(
        df,
        {
            "_win_fs": F.when(mask, v).otherwise(0.0),
            "_win_bs": F.when(mask, 0.0).otherwise(v),
            "_win_fn": F.when(mask, one).otherwise(0),
            "_win_bn": F.when(mask, 0).otherwise(one),
        },
        win,
        size,
        "reflect",
        frame,
    )
    ok = (F.col("_win_bn") >= min_bg) & (F.col("_win_fn") >= 1)
    gap = F.abs(F.col("_win_fs") / F.col("_win_fn") - F.col("_win_bs") / F.col("_win_bn"))
    return d.withColumn(out, F.when(ok, gap)).drop("_win_fs", "_win_bs", "_win_fn", "_win_bn")


def stencil(df: DataFrame, value: Column, frame: str = "frame_id") -> DataFrame:
    """3x3 Sobel (gx, gy, grad) and Laplacian (lap); borders reflect without repeating.

    The Laplacian is the diagonal form 2, 0, 2 / 0, -8, 0 / 2, 0, 2.
    """
    fields = [T.StructField(n, T.DoubleType()) for n in ("gx", "gy", "lap")]
    p = Pass(df, frame)
    p.given["_win_c"] = value.cast("double")
    d = p.step(*grid_step(["_win_c"], lambda c: stencils(*c[:2]).values(), fields)).run()
    return d.withColumn("grad", F.hypot("gx", "gy"))


def laplacian_variance(
    df: DataFrame, value: Column, win: int, size: tuple[int, int], frame: str = "frame_id",
    out: str = "busy",
) -> DataFrame:
    """Variance of the Laplacian in a box: local texture."""
    p = Pass(df.filter(F.col("y").between(0, size[0] - 1) & F.col("x").between(0, size[1] - 1)), frame)
    p.given["_win_c"] = value.cast("double")

    def run(c):
        lap, ok = stencils(*c[:2])["lap"]
        total, some = box_totals(lap, ok, win // 2, True)
        square = box_totals(lap * lap, ok, win // 2, True)[0]
        n = box_totals(np.ones(ok.shape), c[2], win // 2, True)[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total / n
            return [(np.maximum(square / n - mean * mean, 0.0), some)]

    return p.step(*grid_step(["_win_c"], run, [T.StructField(out, T.DoubleType())], size)).run()


def local_range(
    df: DataFrame, value: Column, win: int, frame: str = "frame_id", out: str = "range"
) -> DataFrame:
    """Local max minus local min in a box cut at the frame edge."""
    half = win // 2
    p = Pass(df, frame)
    p.given["_win_c"] = value.cast("double")
    return p.step(*grid_step(["_win_c"], lambda c: [box_ranges(*c[:2], half)], [T.StructField(out, T.DoubleType())])).run()


def edge_width(
    df: DataFrame, value: Column, win: int = 5, frame: str = "frame_id", range_out: str | None = None
) -> DataFrame:
    """Gradient magnitude and the width proxy range / (gradient + 0.001); the range too if named."""
    half, names = win // 2, ("_win_gx", "_win_gy", "_win_range")
    p = Pass(df, frame)
    p.given["_win_c"] = value.cast("double")

    def run(c):
        s = stencils(*c[:2])
        return [s["gx"], s["gy"], box_ranges(*c[:2], half)]

    d = p.step(*grid_step(["_win_c"], run, [T.StructField(n, T.DoubleType()) for n in names])).run()
    d = d.withColumn("grad", F.hypot("_win_gx", "_win_gy"))
    return d.withColumn("edge_width", F.col("_win_range") / (F.col("grad") + 1e-3)).drop(*names[:2]).withColumnRenamed(
        "_win_range", range_out or "_win_range"
    ).drop("_win_range")


def local_max(df: DataFrame, value: str, win: int, frame: str = "frame_id", out: str = "peak"):
    half = win // 2
    d = df.withColumn(out, F.col(value))
    for over in (_row(frame), _col(frame)):
        d = d.withColumn(out, F.max(out).over(over.rangeBetween(-half, half)))
    return d


def morph(
    df: DataFrame,
    mask: Column,
    op: str,
    k: int = 1,
    kernel: str = "square",
    frame: str = "frame_id",
    out: str = "morph",
) -> DataFrame:
    """Dilate, erode, open or close a mask with a (2k+1) kernel; 0/1 in ``out``.

    Pixels outside the frame are ignored.
    """
    return morphs(df, [Morph(mask, op, k, kernel, out)], frame)


def boundary_band(
    df: DataFrame, mask: Column, k: int, frame: str = "frame_id", out: str = "band"
) -> DataFrame:
    """1 within k pixels of the mask boundary, inside or outside."""
    jobs = [Morph(mask, op, k, "ellipse", f"_win_{op}") for op in ("dilate", "erode")]
    band = F.col("_win_dilate") * (1 - F.col("_win_erode"))
    return morphs(df, jobs, frame).withColumn(out, band).drop("_win_dilate", "_win_erode")


def ring(
    df: DataFrame, mask: Column, outer: int, inner: int = 0, frame: str = "frame_id",
    out: str = "ring", kernel: str = "square",
) -> DataFrame:
    """1 in the band between ``inner`` and ``outer`` pixels outside the mask."""
    jobs = [Morph(mask, "dilate", k, kernel, f"_win_{i}") for i, k in enumerate((outer, inner))]
    band = F.col("_win_0") - F.col("_win_1")
    return morphs(df, jobs, frame).withColumn(out, band).drop("_win_0", "_win_1")


def arc_length(
    nodes: DataFrame, by: Sequence[str], order: str, axes: Sequence[str] = ("nx", "ny", "nz")
) -> DataFrame:
    """Cumulative length along each chain of nodes."""
    w = Window.partitionBy(*by).orderBy(order)
    sq = sum(
        ((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0)
    )
    d = nodes.withColumn("_win_step", F.coalesce(F.sqrt(sq), F.lit(0.0)))
    return d.withColumn("arc", F.sum("_win_step").over(w)).drop("_win_step")


def frame_displacement(
    points: DataFrame,
    clip: str = "clip",
    frame: str = "frame",
    point: str = "point_id",
    axes: Sequence[str] = ("px", "py", "pz"),
) -> DataFrame:
    """Max and mean displacement between consecutive frames, with count and NaN checks."""
    w = Window.partitionBy(clip, point).orderBy(frame)
    sq = sum(
        ((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0)
    )
    bad = F.lit(False)
    for a in axes:
        bad = bad | F.isnan(a) | (F.abs(F.col(a)) == float("inf")) | F.col(a).isNull()
    per = (
        points.withColumns({"_win_d": F.sqrt(sq), "_win_bad": bad})
        .groupBy(clip, frame)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.avg("_win_d").alias("mean_d"),
            F.max("_win_d").alias("max_d"),
            F.count_if("_win_bad").alias("bad"),
        )
    )
    return per.groupBy(clip).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg("mean_d").alias("mean_displacement"),
        F.max("max_d").alias("max_displacement"),
        (F.min("points") == F.max("points")).alias("same_count"),
        F.sum("bad").alias("non_finite"),
    )
