"""Matched comparison, what-if arithmetic and dataset audits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions import colour
from pixelmill.operators import blobs as bl
from pixelmill.operators import windows as wi
from pixelmill.operators.distance import Pass, group_counts, group_percentiles, mask_nearest, pa_array, with_nulls
from pixelmill.operators.geometry import resize_area, resize_nearest
from pixelmill.operators.metrics import ratio
from pixelmill.operators.ordered import exact_percentiles
from pixelmill.operators.raster import _numbers, box_ranges, box_totals, grid_step, stencils
from pixelmill.operators.stats import colourfulness_agg
from pixelmill.session import cut_lineage

AB_COUNTS = [
    "gt_px",
    "fp_a_px",
    "fp_b_px",
    "removed_fp_px",
    "added_fp_px",
    "net_fp_change",
    "lost_tp_px",
    "gained_tp_px",
    "removed_far",
    "removed_mid",
    "removed_near",
    "added_far",
    "added_mid",
    "added_near",
    "n_fp_blobs_a",
    "n_fp_blobs_b",
]


def matched_ab(
    df: DataFrame,
    gt: Column,
    a: Column,
    b: Column,
    near: float = 30.0,
    mid: float = 100.0,
    top: int = 5,
    frame: str = "frame_id",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per-frame decomposition of the difference between two models on one truth."""
    g, pa, pb = gt, a, b
    removed, added = ~g & pa & ~pb, ~g & pb & ~pa
    # what is true of a pixel in one number: NULL is not true
    facts = [g, ~g & pa, ~g & pb, removed, added, g & pa & ~pb, g & ~pa & pb]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(facts)), F.lit(0))
    p = Pass(df.select(*by, frame, "y", "x", F.when(g, 1).otherwise(0).alias("_g"), bits.alias("_bits")), frame, "yx")
    p.nearest("_g", {}, "_near_")
    n_facts = len(facts)

    def make(rows, starts, group, n):
        bits = rows.column("_bits").to_numpy()
        fact = [bits & (1 << i) > 0 for i in range(n_facts)]
        d2, sown = _numbers(rows, "_near_d2")
        dist = np.sqrt(d2)
        zones = [~sown | (dist > mid), sown & (dist >= near) & (dist <= mid), sown & (dist < near)]
        g, fa, fb, gone, new, lost, gained = group_counts(group, n, *fact)
        out = [g, fa, fb, gone, new, new - gone, lost, gained]
        out += group_counts(group, n, *[fact[i] & z for i in (3, 4) for z in zones])
        out = [pa_array(v) for v in out]
        frames = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
        known = rows.column(frame).is_valid().to_numpy()[starts]
        at = frames[np.unique(group, return_index=True)[1]]
        for on in fact[1:3]:
            areas = bl.frame_areas(rows, frames, on)
            out += [_lists([areas[f][:top] if known[f] else [] for f in at]), pa_array(np.array([len(areas[f]) if known[f] else 0 for f in at], dtype=np.int64))]
        return out

    fields = [T.StructField(c, T.LongType()) for c in AB_COUNTS[:14]]
    for side in "ab":
        fields += [T.StructField(f"top_blobs_{side}", T.ArrayType(T.LongType())), T.StructField(f"n_fp_blobs_{side}", T.LongType())]
    return p.collapse(by, make, fields)


def _lists(values):
    import pyarrow as pa

    return pa.array(values, pa.list_(pa.int64()))


def aggregate_ab(records: DataFrame, keys: Sequence[str] = ("camera",)) -> DataFrame:
    """Pooled sums, overall and per key value."""
    scope, value = F.lit("pooled"), F.lit("all")
    for c in keys:
        on = F.grouping(c) == 0
        scope = F.when(on, c).otherwise(scope)
        value = F.when(on, F.col(c).cast("string")).otherwise(value)
    return (
        records.groupingSets([[]] + [[F.col(c)] for c in keys], *keys)
        .agg(
            scope.alias("scope"),
            value.alias("value"),
            F.count(F.lit(1)).alias("images"),
            *[F.sum(c).alias(c) for c in AB_COUNTS],
        )
        .drop(*keys)
    )


def generalisation_gap(
    train: DataFrame, val: DataFrame, keys: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Train minus val per key."""
    v = val.select(*keys, *[F.col(m).alias(f"_v_{m}") for m in metrics])
    return train.join(v, list(keys)).select(
        *keys, *[(F.col(m) - F.col(f"_v_{m}")).alias(f"gap_{m}") for m in metrics]
    )


def resolution_ceiling(
    df: DataFrame,
    mask: Column,
    size: tuple[int, int],
    variants: Sequence[tuple[int, int, str]],
    frame: str = "frame_id",
    by: Sequence[str] = (),
) -> DataFrame:
    """IoU a perfect mask keeps after going down to (h, w) and back.

    Methods: nearest, area (mean at least 0.5), nearest_erode1, nearest_dilate1.
    """
    h0, w0 = size
    base = df.select(*by, frame, "y", "x", mask.cast("int").alias("_m"))
    out = None
    for h, w, method in variants:
        src = base.select(frame, "y", "x", "_m")
        if method == "area":
            small = resize_area(src, size, (h, w), "_m", [frame])
            small = small.withColumn("_m", (F.col("_m") >= 0.5).cast("int"))
        else:
            small = resize_nearest(src, size, (h, w))
            if method != "nearest":
                op = {"nearest_erode1": "erode", "nearest_dilate1": "dilate"}[method]
                small = wi.morph(small, F.col("_m") == 1, op, 1, "square", frame, "_m2")
                small = small.select(frame, "y", "x", F.col("_m2").alias("_m"))
        small = small.select(
            frame, F.col("y").alias("_ty"), F.col("x").alias("_tx"), F.col("_m").alias("_up")
        )
        full = base.withColumns(
            {
                "_ty": F.floor(F.col("y") * h / h0).cast("int"),
                "_tx": F.floor(F.col("x") * w / w0).cast("int"),
            }
        )
        m, up = F.col("_m") == 1, F.col("_up") == 1
        part = (
            full.join(small.hint("merge"), [frame, "_ty", "_tx"])
            .groupBy(*by)
            .agg(
                F.count_if(m & up).alias("tp"),
                F.count_if(~m & up).alias("fp"),
                F.count_if(m & ~up).alias("fn"),
            )
            .withColumns({"size": F.lit(f"{h}x{w}"), "method": F.lit(method)})
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("iou", ratio("tp", F.col("tp") + F.col("fp") + F.col("fn"), "null"))


def recall_by_property(
    df: DataFrame,
    truth: Column,
    hit: Column,
    properties: dict[str, tuple[Column, Sequence[float]]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Recall over bins of several properties at true pixels; all bins are reported.

    Values outside the outer edges fall into the end bins, NULLs are dropped.
    """
    aggs, names = [], []
    rows = df.filter(truth)
    cols = {}
    for name, (value, edges) in properties.items():
        inner = edges[1:-1]
        idx = F.when(value.isNotNull(), F.lit(0))
        for e in inner:
            idx = idx + (value >= e).cast("int")
        cols[f"_i_{name}"] = idx
    rows = rows.select(*by, hit.alias("_hit"), *[c.alias(n) for n, c in cols.items()])
    structs = []
    for name, (_, edges) in properties.items():
        for k in range(len(edges) - 1):
            at = F.col(f"_i_{name}") == k
            g, t = f"_g_{name}{k}", f"_t_{name}{k}"
            aggs += [F.count_if(at).alias(g), F.count_if(at & F.col("_hit")).alias(t)]
            structs.append(
                F.struct(
                    F.lit(name).alias("property"),
                    F.lit(k).alias("bin"),
                    F.col(g).alias("gt_px"),
                    F.col(t).alias("tp"),
                )
            )
        names.append(name)
    wide = rows.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*structs))).withColumn(
        "recall", ratio("tp", "gt_px", "null")
    )


def recall_by_colour(df: DataFrame, gt: Column, pred: Column, aim: float = 0.95) -> DataFrame:
    """Per colour bin: pixels, recall, and pooled IoU if its recall were ``aim`` with the
    false alarms fixed or with the precision fixed."""
    c = colour.hsv()
    d = df.select(
        gt.alias("_g"), pred.alias("_p"), colour.colour_bin(c["hue"], c["sat"], c["val"]).alias("_c")
    )
    counts = d.groupBy("_c").agg(
        F.count_if("_g").alias("gt_px"),
        F.count_if(F.col("_g") & F.col("_p")).alias("tp"),
        F.count_if(~F.col("_g") & F.col("_p")).alias("_fp"),
    )
    total = counts.agg(
        F.struct(
            F.sum("tp").alias("tp"),
            F.sum("_fp").alias("fp"),
            F.sum(F.col("gt_px") - F.col("tp")).alias("fn"),
            F.sum("gt_px").alias("gt"),
        ).alias("t")
    )
    names = F.array(*[F.lit(n) for n in colour.COLOUR_BINS])
    r = counts.filter(F.col("gt_px") > 0).withColumn("_t", total.scalar())
    gain = F.greatest(F.lit(0.0), aim * F.col("gt_px") - F.col("tp"))
    tp2, fn2 = F.col("_t.tp") + gain, F.col("_t.fn") - gain
    p0 = F.col("_t.tp") / (F.col("_t.tp") + F.col("_t.fp"))
    return r.select(
        names[F.col("_c")].alias("colour"),
        "gt_px",
        "tp",
        (F.col("gt_px") / F.col("_t.gt")).alias("gt_share"),
        (F.col("tp") / F.col("gt_px")).alias("recall"),
        (tp2 / (tp2 + F.col("_t.fp") + fn2)).alias("iou_fp_fixed"),
        (tp2 / (tp2 / p0 + fn2)).alias("iou_precision_fixed"),
    )


# Thresholds of the failure buckets.
GOOD_IOU, CAMO, CAMO_SOFT, THIN_W, COLOUR_RECALL, HALO_SHARE = 0.50, 12.0, 18.0, 3.0, 0.35, 0.50


def failure_frames(
    df: DataFrame,
    gt: Column,
    pred: Column,
    size: tuple[int, int],
    win: int = 11,
    halo_px: int = 5,
    min_bg: int = 8,
    frame: str = "frame_id",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per frame with what the failure rules look at.

    iou, tp, fp, fn, median_fn_contrast, median_fn_width, dom_fn_bin, dom_fn_recall,
    halo_share.
    """
    c = colour.hsv()
    # only what the rules look at travels through the window and distance passes
    d = df.select(
        *by,
        frame,
        "y",
        "x",
        gt.alias("_g"),
        pred.alias("_p"),
        colour.luma().alias("_l"),
        colour.colour_bin(c["hue"], c["sat"], c["val"]).alias("_c"),
    )
    g, p = F.col("_g"), F.col("_p")
    d = d.filter(F.col("y").between(0, size[0] - 1) & F.col("x").between(0, size[1] - 1))
    # contrast, widths, distances and what is counted of them in one pass, so no pixel is exchanged after it
    one, wins = bl.width_pass(d, g, frame, "_width"), ["_win_fs", "_win_bs", "_win_fn", "_win_bn"]
    one.nearest(one.mask(g, "_in"), {}, "_in_")
    v = F.col("_l").cast("double")
    inputs = [F.when(g, v).otherwise(0.0), F.when(g, 0.0).otherwise(v), F.when(g, 1.0).otherwise(0.0), F.when(g, 0.0).otherwise(1.0)]
    one.df = d.withColumns(
        dict(zip(wins, inputs)) | one.given | {"_facts": sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((g & p, ~g & p, g & ~p, g))), F.lit(0))}
    ).drop("_g", "_p", "_l")
    one.given = {}

    def boxes(*grids):
        (fs, a), (bs, b), (fn, c), (bn, e) = (box_totals(v, ok, win // 2, True) for v, ok, _ in grids)
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = np.abs(fs / fn - bs / bn)
        return [(gap, a & b & c & e & (bn >= min_bg) & (fn >= 1))]

    one.step(*grid_step(wins, boxes, [T.StructField("_contrast", T.DoubleType())], size))
    nb = len(colour.COLOUR_BINS)

    def make(rows, starts, group, n):
        bits = rows.column("_facts").to_numpy()
        tp, fp, fn, g = (bits & (1 << i) > 0 for i in range(4))
        contrast, width = _numbers(rows, "_contrast"), _numbers(rows, "_width")
        d2, sown = _numbers(rows, "_in_d2")
        c, some = _numbers(rows, "_c")
        some &= (c >= 0) & (c < nb)
        cell = group * nb + c.astype(np.int64) * some
        missed, true = (np.bincount(cell[some & m], minlength=n * nb).reshape(n, nb) for m in (fn, g))
        dom = missed.argmax(axis=1)
        # of equally many misses the first bin
        at = np.arange(n), dom
        counts = group_counts(group, n, tp, fp, fn, fp & sown & (np.sqrt(d2) <= halo_px))
        medians = [
            with_nulls(*group_percentiles(v, fn & there, group, n, 0.5)) for v, there in (contrast, (2.0 * width[0], width[1]))
        ]
        return [*map(pa_array, counts), *medians, pa_array(dom.astype(np.int32)), pa_array(missed[at].astype(np.int64)), pa_array(true[at].astype(np.int64))]

    fields = [T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn", "_halo")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("median_fn_contrast", "median_fn_width")]
    fields += [T.StructField("_bin", T.IntegerType()), T.StructField("_dfn", T.LongType()), T.StructField("_dgt", T.LongType())]
    per = one.collapse(by, make, fields)
    per = per.withColumn("_dom", F.struct(F.col("_dfn").alias("fn"), (-F.col("_bin")).alias("neg"), F.col("_dgt").alias("gt")))
    some = F.col("fn") > 0
    dom = F.col("_dom")
    return per.select(
        *by,
        frame,
        "tp",
        "fp",
        "fn",
        ratio("tp", F.col("tp") + F.col("fp") + F.col("fn"), "null").alias("iou"),
        "median_fn_contrast",
        "median_fn_width",
        F.when(some, -dom["neg"]).alias("dom_fn_bin"),
        F.when(some, 1.0 - dom["fn"] / dom["gt"]).alias("dom_fn_recall"),
        ratio("_halo", "fp", "null").alias("halo_share"),
    )


def failure_bucket(frames: DataFrame) -> DataFrame:
    """Dominant failure per frame by ordered rules."""
    chroma = F.col("dom_fn_bin") < 8
    low = F.col("dom_fn_recall") < COLOUR_RECALL
    contrast = F.col("median_fn_contrast")
    missed = F.col("fn") >= F.col("fp")
    bucket = (
        F.when(F.col("iou") >= GOOD_IOU, "good")
        .when(missed & (contrast < CAMO), "camouflage-low-contrast")
        .when(missed & chroma & low, "missed-colour")
        .when(missed & (F.col("median_fn_width") < THIN_W), "too-thin")
        .when(missed & (contrast < CAMO_SOFT), "camouflage-low-contrast")
        .when(missed & (low | chroma), "missed-colour")
        .when(missed, "camouflage-low-contrast")
        .when(F.col("halo_share") >= HALO_SHARE, "halo-only")
        .otherwise("busy-bg-FP")
    )
    return frames.withColumn("bucket", bucket)


def bucket_upside(frames: DataFrame, aim: float = 0.9) -> DataFrame:
    """Per bucket: shares of truth, misses and false alarms, and the pooled IoU if its
    recall were ``aim``, if its false alarms vanished, and both."""
    gain = F.greatest(F.lit(0.0), aim * (F.col("tp") + F.col("fn")) - F.col("tp"))
    per = frames.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum("tp").alias("btp"),
        F.sum("fp").alias("bfp"),
        F.sum("fn").alias("bfn"),
        F.sum(gain).alias("_gain"),
    )
    total = per.agg(
        F.struct(
            F.sum("btp").alias("tp"), F.sum("bfp").alias("fp"), F.sum("bfn").alias("fn")
        ).alias("t")
    )
    d = per.withColumn("_t", total.scalar())
    tp, fp, fn = F.col("_t.tp"), F.col("_t.fp"), F.col("_t.fn")
    rest, g = fp - F.col("bfp"), F.col("_gain")
    return d.select(
        "bucket",
        "frames",
        (F.col("btp") + F.col("bfn")).alias("gt_px"),
        ((F.col("btp") + F.col("bfn")) / (tp + fn)).alias("gt_share"),
        ratio("bfn", fn).alias("fn_share"),
        ratio("bfp", fp).alias("fp_share"),
        ((tp + g) / (tp + fp + fn)).alias("iou_if_recall"),
        (tp / (tp + rest + fn)).alias("iou_if_fp0"),
        ((tp + g) / (tp + rest + fn)).alias("iou_if_both"),
    )


def variant_gate(
    df: DataFrame,
    prob: Column,
    ref_prob: Column,
    ref_mask: Column,
    frame: str = "frame_id",
    group: str = "camera",
    low: float = 0.01,
    need: float = 0.5,
) -> DataFrame:
    """Per video: ratio of mean score to the reference, share of reference positives still
    scored above ``low``, and whether all groups pass."""
    per = df.groupBy(group, frame).agg(
        F.avg(prob).alias("_m"),
        F.avg(ref_prob).alias("_r"),
        F.count_if(ref_mask).alias("_pos"),
        F.count_if(ref_mask & (prob > low)).alias("_kept"),
    )
    v = per.groupBy(group).agg(
        F.count(F.lit(1)).alias("frames"),
        (F.avg("_m") / F.greatest(F.avg("_r"), F.lit(1e-12))).alias("gate_a"),
        (F.sum("_kept") / F.greatest(F.sum("_pos"), F.lit(1))).alias("gate_b"),
    )
    all_pass = v.agg(
        F.struct(
            F.bool_and(F.col("gate_a") >= need).alias("a"),
            F.bool_and(F.col("gate_b") >= need).alias("b"),
        ).alias("s")
    )
    return v.withColumn("_s", all_pass.scalar()).select(
        group,
        "frames",
        "gate_a",
        "gate_b",
        F.col("_s.a").alias("all_pass_a"),
        F.col("_s.b").alias("all_pass_b"),
    )


def gate_rollup(
    gates: Sequence[tuple[str, DataFrame | None]], videos: Sequence[str], group: str = "camera",
    reference: str = "reference",
) -> DataFrame:
    """Variants x videos matrix: a_<video>, b_<video>; the reference row is 1.0 and missing
    variants are skipped."""
    long = None
    for name, g in gates:
        if g is None:
            continue
        part = g.select(F.lit(name).alias("variant"), F.col(group).alias("video"), "gate_a", "gate_b")
        long = part if long is None else long.unionByName(part)
    rows = F.array(
        *[
            F.struct(
                F.lit(reference).alias("variant"),
                F.lit(v).alias("video"),
                F.lit(1.0).alias("gate_a"),
                F.lit(1.0).alias("gate_b"),
            )
            for v in videos
        ]
    )
    ref = long.sparkSession.range(1).select(F.inline(rows))
    long = long.unionByName(ref)
    return long.groupBy("variant").agg(
        *[
            F.max(F.when(F.col("video") == v, F.col(f"gate_{x}"))).alias(f"{x}_{v}")
            for x in ("a", "b")
            for v in videos
        ]
    )


def pick_threshold(
    df: DataFrame, score: Column, target: int, grid: Sequence[float] | None = None, floor_keep: int = 700
) -> DataFrame:
    """Threshold whose keep count is closest to ``target``; the lowest one on ties. Keeping
    fewer than ``floor_keep`` falls back to the lowest threshold.

    All counts of the grid come from one scan.
    """
    grid = list(grid or [round(0.30 + 0.01 * i, 2) for i in range(61)])
    counts = df.agg(*[F.count_if(score >= t).alias(f"_k{i}") for i, t in enumerate(grid)])
    cand = [
        F.struct(
            F.abs(F.col(f"_k{i}") - target).alias("gap"),
            F.lit(float(t)).alias("threshold"),
            F.col(f"_k{i}").alias("keep"),
        )
        for i, t in enumerate(grid)
    ]
    best = counts.select(F.array_min(F.array(*cand)).alias("b"), F.col("_k0"))
    low = (F.col("b.keep") < floor_keep) & (F.col("_k0") >= F.col("b.keep"))
    return best.select(
        F.when(low, float(grid[0])).otherwise(F.col("b.threshold")).alias("threshold"),
        F.when(low, F.col("_k0")).otherwise(F.col("b.keep")).alias("keep"),
    )


def domain_summary(
    df: DataFrame, mask: Column, by: str, frame: str = "frame_id"
) -> DataFrame:
    """Foreground share, width and colour of each dataset in ``by``."""
    d = df.select(by, frame, "y", "x", *"bgr", mask.alias("_m"))
    p = bl.ridge_pass(d, F.col("_m"), frame, 1e-6)

    def make(rows, starts, group, n):
        on, inner = rows.column("_on").to_numpy() == 1, _numbers(rows, "inner")[0]
        size = np.bincount(group, minlength=n)
        out = [pa_array(group_counts(group, n, on)[0] / size)]
        out.append(with_nulls(*group_percentiles(2.0 * inner, rows.column("ridge").to_numpy() == 1, group, n, 0.5)))
        for c in "bgr":
            v, there = _numbers(rows, c)
            some = group_counts(group, n, there)[0]
            out.append(with_nulls(np.bincount(group, weights=v, minlength=n) / np.maximum(some, 1), some > 0))
        return out

    # one row per frame, which five sums and percentiles look at
    per = cut_lineage(p.collapse([by], make, [T.StructField(c, T.DoubleType()) for c in ("fg", "width", *"bgr")]))
    base = per.groupBy(by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg("fg").alias("fg_mean"),
        F.avg("width").alias("width_mean"),
        *[F.avg(c).alias(f"mean_{c}") for c in "bgr"],
        (F.avg("r") - F.avg("b")).alias("warmth"),
    )
    fg = exact_percentiles(per, [by], "fg", {"fg_median": 0.5, "fg_p05": 0.05, "fg_p95": 0.95})
    w = exact_percentiles(
        per, [by], "width", {"width_median": 0.5, "width_p05": 0.05, "width_p95": 0.95}
    )
    return base.join(fg.drop("n"), by, "left").join(w.drop("n"), by, "left")


def domain_gap(summary: DataFrame, by: str, a, b) -> DataFrame:
    """Ratios of the medians of dataset ``a`` to those of ``b``."""
    def side(v, c):
        return F.max(F.when(F.col(by) == v, F.col(c)))

    def gap(c):
        return (side(a, c) / F.greatest(side(b, c), F.lit(1e-9))).alias(f"{c}_ratio")

    return summary.agg(gap("fg_median"), gap("width_median"))


# Thickness classes in pixels.
THICK_EDGES = [0.0, 2.0, 4.0, 8.0, 16.0, math.inf]
THICK_NAMES = ["lt2", "2_4", "4_8", "8_16", "ge16"]


def audit_frames(
    df: DataFrame, object_mask: Column, trained_mask: Column, noise: Column, min_blob: int = 20,
    frame: str = "frame_id",
) -> DataFrame:
    """One wide row per frame: coverage, object colours, widths, blob count and background
    brightness and colourfulness."""
    c = colour.hsv()
    d = df.select(
        frame,
        "y",
        "x",
        *"bgr",
        object_mask.alias("_o"),
        trained_mask.alias("_t"),
        noise.alias("_n"),
        colour.colour_bin(c["hue"], c["sat"], c["val"]).alias("_c"),
        colour.luma().alias("_l"),
    )
    o, bg = F.col("_o"), ~F.col("_o")
    runs = bl.blob_runs(d, o, 8, frame)
    big = bl.blob_stats(runs, frame).filter(F.col("area") >= min_blob)
    big = big.groupBy(frame).agg(F.count(F.lit(1)).alias("n_components"))
    d = bl.ridge(d, o, frame)
    wd = F.when(F.col("ridge") == 1, 2.0 * F.col("inner"))
    px = F.count(F.lit(1))
    n_obj, n_ridge = F.greatest(F.count_if(o), F.lit(1)), F.greatest(F.count(wd), F.lit(1))
    per = d.groupBy(frame).agg(
        (100.0 * F.count_if(o) / px).alias("coverage_pct"),
        (100.0 * F.count_if("_t") / px).alias("coverage_trained_pct"),
        F.count_if("_n").alias("noise_px"),
        *[
            (100.0 * F.count_if(o & (F.col("_c") == i)) / n_obj).alias(f"col_{n}_pct")
            for i, n in enumerate(colour.COLOUR_BINS)
        ],
        *[
            (100.0 * F.count_if((wd >= lo) & (wd < hi)) / n_ridge).alias(f"thick_{n}_pct")
            for n, lo, hi in zip(THICK_NAMES, THICK_EDGES, THICK_EDGES[1:])
        ],
        F.coalesce(F.median(wd), F.lit(0.0)).alias("thick_median_px"),
        F.coalesce(F.percentile(wd, F.lit(0.9)), F.lit(0.0)).alias("thick_p90_px"),
        F.coalesce(F.avg(F.when(bg, F.col("_l"))), F.lit(0.0)).alias("bg_luma_mean"),
        F.coalesce(F.stddev_pop(F.when(bg, F.col("_l"))), F.lit(0.0)).alias("bg_luma_std"),
        colourfulness_agg(bg).alias("bg_colourfulness"),
    )
    out = per.join(big, frame, "left")
    return out.withColumn("n_components", F.coalesce("n_components", F.lit(0)).cast("bigint"))


def coverage_flag(
    df: DataFrame, reference: DataFrame, clip: str = "clip", pct: str = "pct",
    tol: float = 15.0, low: float = 5.0,
) -> DataFrame:
    """Mean and median coverage per clip, percent change to the reference and a flag."""
    stats = df.groupBy(clip).agg(F.avg(pct).alias("mean_pct"))
    med = exact_percentiles(df, [clip], pct, {"median_pct": 0.5}).drop("n")
    j = stats.join(med, clip).join(reference.select(clip, "ref_pct"), clip)
    change = 100.0 * (F.col("mean_pct") - F.col("ref_pct")) / F.col("ref_pct")
    j = j.withColumn("change_pct", change)
    ok = (F.abs("change_pct") <= tol) & (F.col("mean_pct") >= low)
    return j.withColumn(
        "flag", F.when(ok, "OK").when(F.col("mean_pct") < low, "LOW").otherwise("OFF")
    )


def new_sharp_edges(
    df: DataFrame, old: Column, new: Column, region: Column, frame: str = "frame_id",
    top: float = 0.995, max_width: float = 1.5, factor: float = 2.0,
) -> DataFrame:
    """Per frame: pixels whose new gradient is among the strongest, narrow, and at least
    ``factor`` times the old one."""
    d = df.select(
        frame, "y", "x", old.cast("double").alias("_old"), new.cast("double").alias("_new"), F.coalesce(region, F.lit(False)).alias("_in")
    )
    gone = [T.StructField(n, T.DoubleType()) for n in ("_go", "_gn", "_wn")]
    kept = [T.StructField(n, T.LongType()) for n in ("region_px", "new_sharp_px")]

    def counts(rows, starts):
        import pyarrow as pa

        inside = rows.column("_in").to_numpy(zero_copy_only=False)
        go, gn, wn = (rows.column(f.name).to_numpy(zero_copy_only=False) for f in gone)
        at_least = _frame_percentile(gn, inside, starts, top)
        with np.errstate(invalid="ignore"):
            sharp = inside & (gn >= at_least) & (wn < max_width) & (gn > factor * (go + 1e-3))
        first = np.zeros(len(gn), dtype=bool)
        first[starts] = True
        for name, mask in (("region_px", inside), ("new_sharp_px", sharp)):
            n = np.zeros(len(gn), dtype=np.int64)
            n[starts] = np.add.reduceat(mask.astype(np.int64), starts)
            rows = rows.append_column(name, pa.array(n, mask=~first))
        return rows

    p = Pass(d, frame)
    p.step(*grid_step(["_old", "_new"], lambda o, n: [_edges(*o)[0], *_edges(*n)], gone))
    p.step(counts, *kept)
    return p.run(drop=["y", "x", "_old", "_new", "_in", *[f.name for f in gone]], only="region_px")


def _edges(v: np.ndarray, ok: np.ndarray, present: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and edge width of (frame, y, x) of numbers, as of ``windows.edge_width``."""
    s = stencils(v, ok)
    grad, there = np.hypot(s["gx"][0], s["gy"][0]), s["gx"][1] & s["gy"][1]
    wide, some = box_ranges(v, ok, 2)
    return [(grad, there), (wide / (grad + 1e-3), there & some)]


def _frame_percentile(v: np.ndarray, mask: np.ndarray, starts: np.ndarray, q: float) -> np.ndarray:
    """For each row the percentile of its frame's values under the mask; NaN without any."""
    size = np.diff(np.r_[starts, len(v)])
    frame = np.repeat(np.arange(len(starts)), size)
    at = np.flatnonzero(mask & ~np.isnan(v))
    at = at[np.lexsort((v[at], frame[at]))]
    n = np.bincount(frame[at], minlength=len(starts))
    some = np.flatnonzero(n)
    out = np.full(len(starts), np.nan)
    pos, first = (n[some] - 1) * q, (np.cumsum(n) - n)[some]
    lo, hi = np.floor(pos), np.ceil(pos)
    a, b = v[at[first + lo.astype(np.int64)]], v[at[first + hi.astype(np.int64)]]
    out[some] = np.where(a == b, a, (hi - pos) * a + (pos - lo) * b)
    return np.repeat(out, size)


def strong_edge_widths(
    df: DataFrame, value: Column, region: Column, frame: str = "frame_id", top: float = 0.99
) -> DataFrame:
    """Edge widths at the strongest 1 % of gradients of a region, per frame."""
    d = df.select(frame, "y", "x", value.cast("double").alias("_v"), F.coalesce(region, F.lit(False)).alias("_in"))
    gone = [T.StructField(n, T.DoubleType()) for n in ("_g", "_w")]
    kept = T.StructField("edge_width", T.DoubleType())

    def strong(rows, starts):
        import pyarrow as pa

        g, w = (rows.column(f.name).to_numpy(zero_copy_only=False) for f in gone)
        with np.errstate(invalid="ignore"):
            m = rows.column("_in").to_numpy(zero_copy_only=False) & (g > 0)
            m &= g >= _frame_percentile(g, m, starts, top)
        return rows.append_column(kept.name, pa.array(w, mask=~m))

    p = Pass(d, frame)
    p.step(*grid_step(["_v"], lambda v: _edges(*v), gone)).step(strong, kept)
    return p.run(drop=["y", "x", "_v", "_in", *[f.name for f in gone]], only="edge_width")


def sharp_edge_gate(
    per_frame: DataFrame, old_widths: DataFrame, new_widths: DataFrame,
    max_new: int = 500, keep: float = 0.9,
) -> DataFrame:
    """Gate row: few new sharp pixels, and the median edge did not get sharper."""
    n = per_frame.agg(F.sum("new_sharp_px").alias("n")).scalar()
    q = {"m": 0.5}
    m_old = exact_percentiles(old_widths, [], "edge_width", q).select("m").scalar()
    m_new = exact_percentiles(new_widths, [], "edge_width", q).select("m").scalar()
    one = per_frame.sparkSession.range(1).select(
        n.alias("observed"), m_old.alias("median_old"), m_new.alias("median_new")
    )
    not_sharper = F.coalesce(F.col("median_new") >= keep * F.col("median_old"), F.lit(True))
    return one.select(
        F.lit("new_sharp_edges").alias("gate"),
        "observed",
        F.lit(max_new).cast("bigint").alias("threshold"),
        "median_old",
        "median_new",
        ((F.col("observed") < max_new) & not_sharper).alias("passed"),
    )
