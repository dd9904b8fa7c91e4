"""Connected blobs of masks and what is measured on them.

Blobs are found on row runs of whole frames (``raster``). A blob id is its first pixel in
raster order, y * 65536 + x, so ids do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.operators import windows as wi
from pixelmill.operators.distance import Pass, group_counts, group_percentiles, mask_nearest, pa_array, places, with_nulls
from pixelmill.operators.metrics import ratio
from pixelmill.operators.ordered import exact_percentiles
from pixelmill.operators.raster import _numbers, blob_runs, blob_step, connected_components, frame_blobs, morph_step, outlines, ridge_step
from pixelmill.session import cut_lineage

_ROW = 65536


def run_pixels(runs: DataFrame, frame: str = "frame_id") -> DataFrame:
    """(frame, y, x, blob) of run rows."""
    return runs.select(
        frame, F.col("line").alias("y"), F.explode(F.sequence("start", "stop")).alias("x"), "blob"
    )


def blob_stats(runs: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Area, bounding box, fill and aspect per blob, from its runs."""
    n = F.col("stop") - F.col("start") + 1
    agg = runs.groupBy(frame, "blob").agg(
        F.sum(n).alias("area"),
        F.min("line").alias("y0"),
        F.max("line").alias("y1"),
        F.min("start").alias("x0"),
        F.max("stop").alias("x1"),
    )
    h, w = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    return agg.withColumns(
        {
            "h": h,
            "w": w,
            "fill": F.col("area") / (h * w),
            "elong": F.greatest(h, w) / F.least(h, w),
        }
    )


def top_blobs(runs: DataFrame, k: int = 5, frame: str = "frame_id") -> DataFrame:
    """The k largest areas per frame in falling order, blob count and total pixels."""
    areas = blob_stats(runs, frame).select(frame, "area")
    return areas.groupBy(frame).agg(
        F.slice(F.reverse(F.array_sort(F.collect_list("area"))), 1, k).alias("top_areas"),
        F.count(F.lit(1)).alias("blobs"),
        F.sum("area").alias("px"),
    )


def frame_areas(rows, frames: np.ndarray, on: np.ndarray) -> list[list[int]]:
    """The falling areas of the 8-connected blobs of ``on`` in each frame; rows sorted by y, x."""
    out = [[] for _ in range(int(frames[-1]) + 1)]
    at = np.flatnonzero(on)
    if not len(at):
        return out
    y, x = (v[at] for v in places(rows))
    f = frames[at]
    first, last, root = frame_blobs(y, x, np.flatnonzero(np.r_[True, f[1:] != f[:-1]]), 1)
    # a blob is told by its frame and first pixel
    blob = np.unique(y[root] * _ROW + x[root], return_inverse=True)[1]
    key, area = np.unique(f[root] * len(blob) + blob, return_inverse=True)
    area = np.bincount(area, weights=last - first + 1).astype(np.int64)
    owner = key // len(blob)
    order = np.lexsort((-area, owner))
    for frame, n in zip(owner[order].tolist(), area[order].tolist()):
        out[frame].append(n)
    return out


def blob_recall(
    df: DataFrame,
    cls: int,
    classes: int = 3,
    gt: str = "gt",
    pred: str = "pred",
    connectivity: int = 8,
    frame: str = "frame_id",
) -> DataFrame:
    """Per ground-truth blob of ``cls``: area, hit, lost_<c> for each class, recall."""
    d = connected_components(df, F.col(gt) == cls, connectivity, frame)
    lost = [
        F.count_if(F.col(pred) == c).alias(f"lost_{c}") for c in range(classes) if c != cls
    ]
    out = d.groupBy(frame, "blob").agg(
        F.count(F.lit(1)).alias("area"), F.count_if(F.col(pred) == cls).alias("hit"), *lost
    )
    return out.withColumn("recall", F.col("hit") / F.col("area"))


def blob_recall_summary(blobs: DataFrame) -> DataFrame:
    """One row: counts of missed and found blobs, mean recall, area percentiles."""
    r = F.col("recall")
    lost = [c for c in blobs.columns if c.startswith("lost_")]
    base = blobs.agg(
        F.count(F.lit(1)).alias("blobs"),
        F.count_if(r < 0.05).alias("fully_missed"),
        F.count_if(r < 0.50).alias("mostly_missed"),
        F.count_if(r >= 0.80).alias("well_detected"),
        F.avg(r).alias("mean_recall"),
        *[F.sum(c).alias(c) for c in lost],
    ).withColumn("_k", F.lit(0))
    pct = exact_percentiles(
        blobs.select(F.lit(0).alias("_k"), "area"),
        ["_k"],
        "area",
        {"area_p05": 0.05, "area_p25": 0.25, "area_p50": 0.5, "area_p75": 0.75, "area_p95": 0.95},
    ).drop("n")
    return base.join(pct, "_k", "left").drop("_k")


# Blob-size buckets, right-open.
SIZE_EDGES = [0, 10, 30, 100, 300, 1000]
SIZE_LABELS = ["<10", "10-30", "30-100", "100-300", "300-1000", ">1000"]


def recall_by_area(blobs: DataFrame, mode: str = "quartile") -> DataFrame:
    """Mean blob recall and pixel recall by area quartile or by fixed size bucket."""
    area = F.col("area")
    if mode == "quartile":
        q = exact_percentiles(blobs, [], "area", {"a": 0.25, "b": 0.5, "c": 0.75})
        d = blobs.withColumn("_q", q.select(F.struct("a", "b", "c").alias("q")).scalar())
        bucket = (
            F.when(area <= F.col("_q.a"), "q1_smallest")
            .when(area <= F.col("_q.b"), "q2")
            .when(area <= F.col("_q.c"), "q3")
            .otherwise("q4_largest")
        )
    elif mode == "fixed":
        d, bucket = blobs, F.lit(SIZE_LABELS[0])
        for lo, name in zip(SIZE_EDGES[1:], SIZE_LABELS[1:]):
            bucket = F.when(area >= lo, name).otherwise(bucket)
    else:
        raise ValueError("mode is quartile or fixed")
    return d.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("blobs"),
        F.avg("area").alias("mean_area"),
        F.avg("recall").alias("mean_recall"),
        (F.sum("hit") / F.sum("area")).alias("pixel_recall"),
        F.count_if(F.col("recall") > 0.5).alias("found"),
    )


def drop_small(
    df: DataFrame, mask: Column, min_area: int, connectivity: int = 8,
    frame: str = "frame_id", out: str = "kept",
) -> DataFrame:
    """1 on mask pixels of blobs with at least ``min_area`` pixels."""
    p = Pass(df, frame, "yx")
    on = p.mask(mask, "_on")
    p.step(*blob_step(on, 1 if connectivity == 8 else 0, "_blob", "_area"))
    return p.run(["_blob"]).withColumn(out, (F.col("_area") >= min_area).cast("int")).drop("_area")


def band_errors(
    df: DataFrame, cls: int, ks: Sequence[int], gt: str = "gt", pred: str = "pred",
    frame: str = "frame_id", by: Sequence[str] = (),
) -> DataFrame:
    """Share of class errors and of the class itself within k px of its boundary."""
    g, p = F.col(gt), F.col(pred)
    d = df.select(*by, frame, "y", "x", gt, pred)
    p_ = Pass(d, frame)
    on = p_.mask(g == cls, "_on")
    for k in ks:
        for op in ("dilate", "erode"):
            p_.step(*morph_step(on, op, k, "ellipse", f"_{op}{k}"))
    d = p_.run()
    d = d.withColumns({f"_band{k}": F.col(f"_dilate{k}") * (1 - F.col(f"_erode{k}")) for k in ks})
    err = (g != p) & ((g == cls) | (p == cls))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_band{k}").alias("_in")) for k in ks])
    long = d.select(*by, err.alias("_err"), (g == cls).alias("_gt"), F.inline(rows))
    inside = F.col("_in") == 1
    agg = long.groupBy(*by, "k").agg(
        F.count_if(F.col("_err") & inside).alias("err_in"),
        F.count_if(F.col("_err") & ~inside).alias("err_out"),
        F.count_if(F.col("_gt") & inside).alias("gt_in"),
        F.count_if(F.col("_gt") & ~inside).alias("gt_out"),
    )
    return agg.withColumns(
        {
            "err_share": ratio("err_in", F.col("err_in") + F.col("err_out")),
            "gt_share": ratio("gt_in", F.col("gt_in") + F.col("gt_out")),
        }
    )


def ring_median(
    df: DataFrame, mask: Column, value: str, outer: int, inner: int = 0, frame: str = "frame_id"
) -> DataFrame:
    """Median of a value in the band outside the mask, per frame."""
    d = df.select(frame, "y", "x", value, mask.alias("_m"))
    d = wi.ring(d, F.col("_m"), outer, inner, frame)
    return d.filter(F.col("ring") == 1).groupBy(frame).agg(
        F.count(value).alias("ring_px"), F.median(value).alias("ring_median")
    )


def ring_contrast_frames(
    df: DataFrame,
    target: Column,
    around: Column,
    value: str,
    outer: int = 7,
    min_px: int = 30,
    min_ring: int = 20,
    frame: str = "frame_id",
    valid: Column | None = None,
) -> DataFrame:
    """|median(target) - median(adjacent part of ``around``)| per frame.

    Frames with too few pixels of either class are left out; a ring that is too thin
    falls back to the whole ``around`` class.
    """
    ok = F.lit(True) if valid is None else valid
    t, a = target & ok, around & ok
    d = df.select(frame, "y", "x", F.col(value).cast("double").alias("_v"), t.alias("_t"), a.alias("_a"))
    p = Pass(d, frame)
    p.given["_on"] = F.when(F.col("_a"), 1).otherwise(0)
    p.mask(F.col("_t"), "_mask")
    p.df = d.withColumns(p.given).drop("_t", "_a")
    p.given = {}
    p.step(*morph_step("_mask", "dilate", outer, "square", "_grown"))

    def make(rows, starts, group, n):
        v, there = _numbers(rows, "_v")
        inside, grown, on = (rows.column(c).to_numpy() for c in ("_mask", "_grown", "_on"))
        masks = [inside == 1, on == 1, (on == 1) & (grown == 1) & (inside != 1)]
        counts = group_counts(group, n, *masks)
        return [*map(pa_array, counts), *[with_nulls(*group_percentiles(v, m & there, group, n, 0.5)) for m in masks]]

    fields = [T.StructField(c, T.LongType()) for c in ("target_px", "around_px", "ring_px")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("_mt", "_ma", "_mr")]
    per = p.collapse([], make, fields)
    ring = F.when(F.col("ring_px") >= min_ring, F.col("_mr")).otherwise(F.col("_ma"))
    return (
        per.filter((F.col("target_px") >= min_px) & (F.col("around_px") >= min_px))
        .withColumn("margin", F.abs(F.col("_mt") - ring))
        .select(frame, "target_px", "around_px", "ring_px", "margin")
    )


def ring_contrast_gate(frames: DataFrame, full_range: float = 255.0, share: float = 0.05):
    """Gate row: median margin as a share of the range against ``share``."""
    pct = exact_percentiles(
        frames.select((F.col("margin") / full_range).alias("m")), [], "m", {"observed": 0.5}
    )
    return pct.select(
        F.lit("ring_contrast").alias("gate"),
        F.lit("all").alias("group"),
        "observed",
        F.lit(float(share)).alias("threshold"),
        F.when(F.col("observed") >= share, 0).otherwise(1).cast("bigint").alias("n_bad"),
        (F.col("observed") >= share).alias("passed"),
    )


def ridge(
    df: DataFrame, mask: Column, frame: str = "frame_id", tol: float = 1e-6
) -> DataFrame:
    """Add ``inner`` (distance to the nearest pixel outside the mask, 0 outside) and
    ``ridge`` (1 where it is a 3x3 maximum inside the mask)."""
    return ridge_pass(df, mask, frame, tol).run(["_out_d2", "_out_y", "_out_x"])


def ridge_pass(df: DataFrame, mask: Column, frame: str, tol: float) -> Pass:
    """The pass of ``ridge``, to which further steps may be added."""
    p = Pass(df, frame)
    p.nearest(p.mask(~mask, "_out"), {}, "_out_")
    return p.step(*ridge_step(p.mask(mask, "_on"), "_out_d2", "inner", "ridge", tol))


def local_width(df: DataFrame, mask: Column, frame: str = "frame_id") -> DataFrame:
    """Ridge pixels with ``width`` = 2 x inner distance."""
    d = ridge(df, mask, frame)
    return d.filter(F.col("ridge") == 1).withColumn("width", 2.0 * F.col("inner"))


def width_of_nearest_ridge(
    df: DataFrame, mask: Column, frame: str = "frame_id", out: str = "width"
) -> DataFrame:
    """Width at every mask pixel, taken from its nearest ridge pixel; NULL outside."""
    d = width_pass(df, mask, frame, out).run(WIDTH_SCRATCH)
    return d.withColumn(out, F.when(mask, 2.0 * F.col(out)))


WIDTH_SCRATCH = ["_out_d2", "_out_y", "_out_x", "inner", "ridge", "_top_d2", "_top_y", "_top_x"]


def width_pass(df: DataFrame, mask: Column, frame: str, out: str) -> Pass:
    """The pass of ``width_of_nearest_ridge``; ``out`` is half the width, outside the mask too."""
    p = ridge_pass(df, mask, frame, 1e-3)
    return p.nearest("ridge", {"inner": out}, "_top_", {"inner": T.DoubleType()})


def blob_shape(
    pixels: DataFrame, eroded: str | None = None, frame: str = "frame_id"
) -> DataFrame:
    """Principal-axis shape per blob: (frame, blob, area, major, minor, axis_ratio,
    long_axis, thin_share). ``eroded`` names a 0/1 column that survived erosion."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    survivors = F.sum(eroded) if eroded else F.lit(0)
    agg = pixels.groupBy(frame, "blob").agg(
        F.count(F.lit(1)).alias("area"),
        F.var_samp(x).alias("_xx"),
        F.var_samp(y).alias("_yy"),
        F.covar_samp(x, y).alias("_xy"),
        survivors.alias("_left"),
    )
    half = (F.col("_xx") + F.col("_yy")) / 2
    gap = (F.col("_xx") - F.col("_yy")) / 2
    spread = F.sqrt(gap * gap + F.col("_xy") * F.col("_xy"))
    one = F.col("area") < 2
    major = F.when(one, 0.0).otherwise(F.sqrt(half + spread))
    minor = F.when(one, 0.5).otherwise(
        F.greatest(F.sqrt(F.greatest(half - spread, F.lit(0.0))), F.lit(0.5))
    )
    return agg.select(
        frame,
        "blob",
        "area",
        major.alias("major"),
        minor.alias("minor"),
        F.when(one, 1.0).otherwise(major / minor).alias("axis_ratio"),
        (4.0 * major).alias("long_axis"),
        (1.0 - F.col("_left") / F.col("area")).alias("thin_share"),
    )


def wirelike_blobs(shape: DataFrame, min_elong: float = 3.0, max_width: float = 10.0) -> DataFrame:
    """kind = wirelike for long and thin blobs, else blob; ``shape`` is from ``outlines``.

    Length and thickness are the sides of the rectangle of least area, of at least one pixel.
    """
    length = F.greatest(F.col("rect_long"), F.lit(1.0))
    side = F.greatest(F.col("rect_short"), F.lit(1.0))
    wire = (F.col("rect_long") / side >= min_elong) & (F.col("area") / length <= max_width)
    return shape.withColumn("kind", F.when(wire, "wirelike").otherwise("blob"))


def error_distance(
    df: DataFrame, errors: Column, truth: Column, frame: str = "frame_id"
) -> DataFrame:
    """Error pixels with their distance to the nearest true pixel (NULL: a frame without any)."""
    return mask_nearest(df, truth, None, frame).filter(errors)


def error_distance_buckets(
    df: DataFrame,
    errors: Column,
    truth: Column,
    near: float,
    mid: float,
    by: Sequence[str] = (),
    frame: str = "frame_id",
) -> DataFrame:
    """Error pixels nearer than ``near``, up to ``mid`` inclusive, beyond, and in frames without truth."""
    d = error_distance(df, errors, truth, frame)
    dist = F.col("dist")
    return d.groupBy(*by).agg(
        F.count_if(dist < near).alias("near"),
        F.count_if((dist >= near) & (dist <= mid)).alias("mid"),
        F.count_if(dist > mid).alias("far"),
        F.count_if(dist.isNull()).alias("no_truth"),
        F.avg(dist).alias("mean_dist"),
    )


def halo_split(
    df: DataFrame, errors: Column, truth: Column, px: int = 5, by: Sequence[str] = (),
    frame: str = "frame_id",
) -> DataFrame:
    """Error mass within ``px`` of truth against standalone mass."""
    d = error_distance(df, errors, truth, frame)
    halo = F.count_if(F.col("dist") <= px)
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fp"),
        halo.alias("halo"),
        (F.count(F.lit(1)) - halo).alias("standalone"),
        (halo / F.count(F.lit(1))).alias("halo_share"),
    )


# Thresholds of the false-alarm modes.
NEAR_SHARE, NEAR_PX, LUMA_HI, SAT_LO, ELONG_HI, FILL_LO = 0.5, 5.0, 150.0, 60.0, 4.0, 0.35


def classify_fp_modes(blobs: DataFrame) -> DataFrame:
    """Mode per blob by the first rule that holds.

    Needs halo_share, median_dist, median_luma, median_sat, elong and fill.
    """
    near = (F.col("halo_share") >= NEAR_SHARE) | (F.col("median_dist") <= NEAR_PX)
    thin = (F.col("elong") > ELONG_HI) & (F.col("fill") < FILL_LO)
    pale = (F.col("median_luma") > LUMA_HI) & (F.col("median_sat") < SAT_LO)
    mode = (
        F.when(near, "near_wire_halo")
        .when(thin, "structured_edge")
        .when(pale, "bright_pale_bg")
        .otherwise("busy_texture")
    )
    return blobs.withColumn("mode", mode)


def mode_mass(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("mode").agg(
        F.count(F.lit(1)).alias("blobs"), F.sum("area").alias("mass")
    )


def circularity(
    df: DataFrame, mask: Column, min_area: int = 12, frame: str = "frame_id"
) -> DataFrame:
    """4 pi area / perimeter^2 per blob, at most 1: (frame, blob, area, perimeter, circ).

    The perimeter is the length of the outer contour; blobs without one, of a single pixel,
    are left out, as are those under ``min_area``.
    """
    found = outlines(df, mask, frame).filter((F.col("area") >= min_area) & (F.col("contour") > 1e-6))
    per = F.col("contour")
    circ = F.least(F.lit(1.0), 4 * math.pi * F.col("area") / (per * per))
    return found.select(frame, "blob", "area", per.alias("perimeter"), circ.alias("circ"))


def circularity_by_frame(blobs: DataFrame, frame: str = "frame_id") -> DataFrame:
    return blobs.groupBy(frame).agg(
        F.median("circ").alias("median_circ"), F.count(F.lit(1)).alias("blobs")
    )
