"""Confusion counts and everything derived from them.

Pixel tables are reduced to confusion rows first (map-side combined), so all
later steps touch at most groups x k x k rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = {"zero": 0.0, "null": None, "one": 1.0}


def ratio(num, den, empty: str = "zero") -> Column:
    """num / den with a chosen value for an empty denominator."""
    num, den = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.when(den != 0, num / den).otherwise(F.lit(EMPTY[empty]).cast("double"))


def confusion(
    df: DataFrame, by: Sequence[str] = (), k: int = 3, gt: str = "gt", pred: str = "pred"
) -> DataFrame:
    """(by.., gt, pred, n); labels outside 0..k-1 on either side are ignored."""
    ok = F.col(gt).between(0, k - 1) & F.col(pred).between(0, k - 1)
    return (
        df.filter(ok)
        .groupBy(*by, F.col(gt).alias("gt"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_counts(cm: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """(by.., cls, tp, fp, fn) for every class 0..k-1, absent ones included."""
    zero = F.lit(0).cast("bigint")
    n, hit = F.col("n"), F.col("gt") == F.col("pred")

    def row(cls, tp, fp, fn):
        return F.struct(
            cls.cast("int").alias("cls"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
        )

    rows = [row(F.lit(c), zero, zero, zero) for c in range(k)]
    rows.append(row(F.col("gt"), F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n)))
    rows.append(row(F.col("pred"), zero, F.when(hit, zero).otherwise(n), zero))
    return (
        cm.select(*by, F.inline(F.array(*rows)))
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )


def class_metrics(
    cm: DataFrame, by: Sequence[str] = (), k: int = 3, empty: str = "zero"
) -> DataFrame:
    """IoU, precision and recall per class."""
    c = class_counts(cm, by, k)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns(
        {
            "iou": ratio(tp, tp + fp + fn, empty),
            "precision": ratio(tp, tp + fp, empty),
            "recall": ratio(tp, tp + fn, empty),
        }
    )


def mean_metrics(
    cm: DataFrame, by: Sequence[str] = (), k: int = 3, empty: str = "zero"
) -> DataFrame:
    """Mean IoU, mean IoU without background, mean class accuracy, pixel accuracy,
    frequency-weighted IoU: one row per group."""
    c = class_metrics(cm, by, k, empty)
    support = F.col("tp") + F.col("fn")
    return c.groupBy(*by).agg(
        F.avg("iou").alias("miou"),
        F.avg(F.when(F.col("cls") > 0, F.col("iou"))).alias("miou_no_bg"),
        F.avg("recall").alias("mean_acc"),
        ratio(F.sum("tp"), F.sum(support)).alias("pixel_acc"),
        ratio(F.sum(support * F.col("iou")), F.sum(support)).alias("freq_iou"),
    )


def freq_weighted_iou(cm: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    return mean_metrics(cm, by, k).select(*by, "freq_iou", "mean_acc", "miou_no_bg")


def binary_metrics(
    df: DataFrame, gt: Column, pred: Column, by: Sequence[str] = (), empty: str = "zero"
) -> DataFrame:
    """tp, fp, fn, tn and what follows from them, one row per group."""

    def n(cond):
        return F.count_if(cond)

    c = df.groupBy(*by).agg(
        n(gt & pred).alias("tp"),
        n(~gt & pred).alias("fp"),
        n(gt & ~pred).alias("fn"),
        n(~gt & ~pred).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "iou": ratio(tp, tp + fp + fn, empty),
            "precision": ratio(tp, tp + fp, empty),
            "recall": ratio(tp, tp + fn, empty),
            "f1": ratio(2 * tp, 2 * tp + fp + fn, empty),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn, empty),
        }
    )


def pooled_and_grouped(
    df: DataFrame, keys: Sequence[str], k: int = 3, gt: str = "gt", pred: str = "pred"
) -> DataFrame:
    """Class metrics pooled and per value of each key, in one result.

    Grouping sets run on the confusion rows, so pixels are read and combined once.
    """
    cm = confusion(df, keys, k, gt, pred)
    sets = [[F.col("gt"), F.col("pred")]] + [[F.col(c), F.col("gt"), F.col("pred")] for c in keys]
    scope = F.lit("pooled")
    value = F.lit("all")
    for c in keys:
        on = F.grouping(c) == 0
        scope = F.when(on, c).otherwise(scope)
        value = F.when(on, F.col(c).cast("string")).otherwise(value)
    rolled = cm.groupingSets(sets, *keys, "gt", "pred").agg(
        F.sum("n").alias("n"), scope.alias("scope"), value.alias("value")
    )
    return class_metrics(rolled.select("scope", "value", "gt", "pred", "n"), ["scope", "value"], k)


def pooled_vs_mean_iou(
    df: DataFrame, frame: str, gt: Column, pred: Column, by: Sequence[str] = ()
) -> DataFrame:
    """IoU of summed counts next to mean, min and max of per-frame IoU.

    A frame with an empty union has NULL IoU and leaves the mean.
    """
    per = binary_metrics(df, gt, pred, [*by, frame], empty="null")
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        ratio(tp, tp + fp + fn, "null").alias("pooled_iou"),
        F.avg("iou").alias("mean_iou"),
        F.min("iou").alias("min_iou"),
        F.max("iou").alias("max_iou"),
    )


def dice_fscore(cm: DataFrame, by: Sequence[str] = (), k: int = 3, beta: float = 1.0) -> DataFrame:
    """Dice and F-beta per class."""
    c = class_metrics(cm, by, k)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r, b2 = F.col("precision"), F.col("recall"), beta * beta
    return c.select(
        *by,
        "cls",
        ratio(2 * tp, 2 * tp + fp + fn).alias("dice"),
        ratio((1 + b2) * p * r, b2 * p + r).alias("fscore"),
    )


def row_normalised(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion rows as shares of their ground-truth class."""
    total = cm.groupBy(*by, "gt").agg(F.sum("n").alias("total"))
    return cm.join(total, [*by, "gt"]).withColumn("share", F.col("n") / F.col("total")).drop("total")


def error_flow(cm: DataFrame, cls: int, by: Sequence[str] = ()) -> DataFrame:
    """Where misses of ``cls`` go (kind fn) and where its false alarms come from (fp)."""
    g, p = F.col("gt"), F.col("pred")
    flow = cm.filter((g != p) & ((g == cls) | (p == cls))).select(
        *by,
        F.when(g == cls, "fn").otherwise("fp").alias("kind"),
        F.when(g == cls, p).otherwise(g).alias("other"),
        "n",
    )
    # a group has at most k rows of a kind; a window reads the counts once, a join twice
    total = F.sum("n").over(Window.partitionBy(*by, "kind"))
    return flow.withColumn("pct", 100.0 * F.col("n") / total)


def coverage(df: DataFrame, fg: Column, frame: str, by: Sequence[str] = ()) -> DataFrame:
    """Foreground pixels and percent per frame."""
    return df.groupBy(*by, frame).agg(
        F.count_if(fg).alias("fg_px"),
        (100.0 * F.count_if(fg) / F.count(F.lit(1))).alias("pct"),
    )


def mean_coverage(df: DataFrame, fg: Column, frame: str, by: Sequence[str] = ()) -> DataFrame:
    per = coverage(df, fg, frame, by)
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum("fg_px").alias("fg_px"),
        F.avg("pct").alias("mean_pct"),
    )


def class_frequency(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Class share per group and inverse-frequency weights with mean 1 over present classes."""
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(
        F.sum("n").alias("_total"),
        F.avg(F.lit(1.0) / F.col("n")).alias("_mean_inverse"),
    )
    return counts.join(total, keys).select(
        *by,
        label,
        "n",
        (F.col("n") / F.col("_total")).alias("share"),
        (1.0 / F.col("n") / F.col("_mean_inverse")).alias("weight"),
    )


def disagreement(df: DataFrame, a: str, b: str, frame: str, by: Sequence[str] = ()) -> DataFrame:
    """Mismatch share per frame, then its spread over frames."""
    per = disagreement_per_frame(df, a, b, frame, by)
    m = F.col("mismatch")
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(m).alias("mean_mismatch"),
        F.max(m).alias("max_mismatch"),
        F.avg((m > 1e-3).cast("double")).alias("share_gt_0p1pct"),
        F.avg((m > 5e-3).cast("double")).alias("share_gt_0p5pct"),
        F.avg((m == 0).cast("double")).alias("share_zero"),
    )


def disagreement_per_frame(df, a: str, b: str, frame: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, frame).agg(
        (F.count_if(F.col(a) != F.col(b)) / F.count(F.lit(1))).alias("mismatch")
    )


def mode_share(
    df: DataFrame, by: Sequence[str], value: str, keep: Column | None = None, none: str = "none"
) -> DataFrame:
    """Most frequent value per group and its share; ties go to the lowest value.

    Rows failing ``keep`` only make the group known; a group without any kept row
    reports ``none`` with share 0.
    """
    keep = F.lit(True) if keep is None else keep
    counts = df.groupBy(*by, F.when(keep, F.col(value)).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    kept = F.col("_v").isNotNull()
    best = F.max(F.when(kept, F.struct(F.col("_n"), (-F.col("_v")).alias("_neg"))))
    out = counts.groupBy(*by).agg(
        best.alias("_best"), F.coalesce(F.sum(F.when(kept, F.col("_n"))), F.lit(0)).alias("_total")
    )
    return out.select(
        *by,
        F.coalesce((-F.col("_best._neg")).cast("string"), F.lit(none)).alias("mode"),
        ratio(F.coalesce(F.col("_best._n"), F.lit(0)), F.col("_total")).alias("share"),
    )


def topk_accuracy(
    df: DataFrame,
    k: int,
    prob: str = "prob",
    gt: str = "gt",
    thresh: float | None = None,
    ignore: int = 255,
    by: Sequence[str] = (),
) -> DataFrame:
    """Share of valid rows whose class is among the k best scores.

    With ``thresh`` the class score must also exceed it. Of equal scores the lower
    class index ranks first.
    """
    own = F.col(prob)[F.col(gt)]
    at = F.col(gt)
    ahead = F.size(
        F.filter(
            F.transform(F.col(prob), lambda p, i: (p > own) | ((p == own) & (i < at))),
            lambda hit: hit,
        )
    )
    ok = ahead < k
    if thresh is not None:
        ok = ok & (own > thresh)
    return (
        df.filter(F.col(gt) != ignore)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("valid"), F.avg(ok.cast("double")).alias("accuracy"))
    )
