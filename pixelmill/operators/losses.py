"""Losses over scored pixel tables, as metrics. Arrays are per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.ordered import running


def _shifted(logits: str | Column, classes: int, temperature: float) -> list[Column]:
    """Logits over the temperature, minus their maximum so that exp cannot overflow.

    One scalar expression per class keeps the work inside generated code; the
    array functions with lambdas would be interpreted.
    """
    a = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(a)
    return [(a[i] - top) / temperature for i in range(classes)]


def _total(cols: Sequence[Column]) -> Column:
    return sum(cols[1:], cols[0])


def softmax(logits: str | Column, classes: int = 3, temperature: float = 1.0) -> Column:
    """Class probabilities."""
    e = [F.exp(v) for v in _shifted(logits, classes, temperature)]
    return F.array(*[v / _total(e) for v in e])


def log_softmax(logits: str | Column, classes: int = 3, temperature: float = 1.0) -> list[Column]:
    z = _shifted(logits, classes, temperature)
    lse = F.log(_total([F.exp(v) for v in z]))
    return [v - lse for v in z]


def argmax(array: str | Column) -> Column:
    """0-based index of the first maximum."""
    a = F.col(array) if isinstance(array, str) else array
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax_argmax(df: DataFrame, logits: str = "logits", classes: int = 3) -> DataFrame:
    return df.withColumns({"prob": softmax(logits, classes), "pred": argmax(logits)})


def tta_merge(passes: Sequence[DataFrame], keys=("frame_id", "y", "x"), classes: int = 3) -> DataFrame:
    """Add the logits of several passes that were mapped back to one pixel grid.

    A pass has one row per pixel. Passes are laid together and grouped, not joined: that needs
    no exchange if they are partitioned by frame.
    """
    rows = None
    for i, p in enumerate(passes):
        part = p.select(*keys, F.lit(i).alias("_p"), *[F.get("logits", k).alias(f"_l{k}") for k in range(classes)])
        rows = part if rows is None else rows.unionByName(part)
    at = [F.col("_p") == i for i in range(len(passes))]
    found = rows.groupBy(*keys).agg(
        *[F.max(F.when(own, F.col(f"_l{k}"))).alias(f"_l{i}_{k}") for i, own in enumerate(at) for k in range(classes)],
        *[F.max(own).alias(f"_has{i}") for i, own in enumerate(at)],
    )
    for i in range(len(passes)):
        found = found.filter(F.col(f"_has{i}"))
    logits = F.array(*[_total([F.col(f"_l{i}_{k}") for i in range(len(passes))]) for k in range(classes)])
    return found.select(*keys, logits.alias("logits")).withColumn("pred", argmax("logits"))


def overlap_merge(windows: DataFrame, classes: int) -> DataFrame:
    """Mean logits where sliding windows overlap.

    ``windows`` rows are (frame_id, y0, x0, y, x, logits) in window coordinates.
    """
    mean = F.array(*[F.avg(F.col("logits")[i]) for i in range(classes)])
    return (
        windows.select(
            "frame_id",
            (F.col("y0") + F.col("y")).alias("y"),
            (F.col("x0") + F.col("x")).alias("x"),
            "logits",
        )
        .groupBy("frame_id", "y", "x")
        .agg(mean.alias("logits"), F.count(F.lit(1)).alias("overlaps"))
    )


def weighted_log_loss(
    df: DataFrame,
    weights: Sequence[float],
    ignore: int = 255,
    by: Sequence[str] = (),
    logits: str = "logits",
    gt: str = "gt",
) -> DataFrame:
    """Class-weighted cross-entropy, mean over valid pixels."""
    w = F.array(*[F.lit(float(v)) for v in weights])[F.col(gt)]
    loss = -F.array(*log_softmax(logits, len(weights)))[F.col(gt)] * w
    return (
        df.filter(F.col(gt) != ignore)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("valid"), F.avg(loss).alias("log_loss"))
    )


def _jaccard_sum(rows: DataFrame, keys: Sequence[str], value: Column, bounded: bool) -> DataFrame:
    """(keys.., gts, _loss): ``value`` summed over the Jaccard steps, errors falling.

    ``rows`` is (keys.., err, fg, n), one row per distinct error.
    """
    order = F.desc("err")
    if bounded:
        w = Window.partitionBy(*keys).orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = rows.withColumns({"cfg": F.sum("fg").over(upto), "cn": F.sum("n").over(upto)})
    else:
        cum = running(rows, keys, [order], {"cfg": ("sum", "fg"), "cn": ("sum", "n")})
    total = cum.groupBy(*keys).agg(F.sum("fg").alias("gts"))
    joined = cum.join(total, list(keys))
    gts = F.col("gts")

    def jaccard(cfg, cn):
        return 1.0 - (gts - cfg) / (gts + cn - cfg)

    here = jaccard(F.col("cfg"), F.col("cn"))
    prev_n, prev_fg = F.col("cn") - F.col("n"), F.col("cfg") - F.col("fg")
    before = F.when(prev_n > 0, jaccard(prev_fg, prev_n)).otherwise(0.0)
    return joined.groupBy(*keys, "gts").agg(F.sum(value * (here - before)).alias("_loss"))


def lovasz_score(
    df: DataFrame,
    by: Sequence[str],
    classes: int,
    weights: Sequence[float] | None = None,
    ignore: int = 255,
    prob: str = "prob",
    gt: str = "gt",
    bounded_groups: bool = False,
) -> DataFrame:
    """Jaccard surrogate per group.

    Rows of equal error are merged first: their order cannot change the sum,
    because the Jaccard steps between equal errors telescope. ``bounded_groups``
    says that a group is one frame, so a plain window may sort it; otherwise
    running sums are split over slices.
    """
    rows = (
        df.filter(F.col(gt) != ignore)
        .select(
            *by,
            # outer: no size filter is inferred that would repeat the prob expression
            F.posexplode_outer(F.col(prob)).alias("cls", "_p"),
            F.col(gt).alias("_gt"),
        )
        .select(
            *by,
            "cls",
            (F.col("_gt") == F.col("cls")).cast("bigint").alias("_fg"),
            F.abs((F.col("_gt") == F.col("cls")).cast("double") - F.col("_p")).alias("err"),
        )
        .groupBy(*by, "cls", "err")
        .agg(F.sum("_fg").alias("fg"), F.count(F.lit(1)).alias("n"))
    )
    per_class = _jaccard_sum(rows, [*by, "cls"], F.col("err"), bounded_groups).filter("gts > 0")
    wts = weights or [1.0] * classes
    wt = F.array(*[F.lit(float(v)) for v in wts])[F.col("cls")]
    return per_class.groupBy(*by).agg(
        (F.sum(F.col("_loss") * wt) / F.sum(wt)).alias("lovasz"),
        F.count(F.lit(1)).cast("bigint").alias("classes_present"),
    )


def lovasz_hinge(
    df: DataFrame,
    by: Sequence[str],
    ignore: int = 255,
    logit: str = "logit",
    gt: str = "gt",
    bounded_groups: bool = False,
) -> DataFrame:
    """(by.., hinge): two-class Lovasz loss of a logit per pixel, labels 0 and 1.

    Errors are 1 - logit on foreground and 1 + logit elsewhere; those below 0 take part in the
    order, not in the sum. A group whose rows are all ignored has loss 0, and one without
    foreground its largest error. See ``lovasz_score`` for ``bounded_groups``.
    """
    by = list(by)
    sign = 2.0 * F.col(gt) - 1.0
    rows = df.filter(F.col(gt) != ignore).select(*by, F.col(gt).cast("bigint").alias("_fg"), (1.0 - F.col(logit) * sign).alias("err"))
    rows = rows.groupBy(*by, "err").agg(F.sum("_fg").alias("fg"), F.count(F.lit(1)).alias("n"))
    loss = _jaccard_sum(rows, by, F.greatest("err", F.lit(0.0)), bounded_groups)
    groups = df.select(*by).distinct()
    return groups.join(loss, by, "left").select(*by, F.coalesce("_loss", F.lit(0.0)).alias("hinge"))


def kl_distill(
    df: DataFrame,
    alpha: float,
    temperature: float,
    by: Sequence[str] = (),
    classes: int = 3,
    student: str = "logits",
    teacher: str = "teacher",
    gt: str = "gt",
) -> DataFrame:
    """alpha * CE + (1 - alpha) * KL(teacher || student) * T^2, averaged over pixels."""
    ls = log_softmax(student, classes, temperature)
    lt = log_softmax(teacher, classes, temperature)
    kl = _total([F.exp(t) * (t - s) for s, t in zip(ls, lt)])
    agg = df.groupBy(*by).agg(
        F.avg(-F.array(*log_softmax(student, classes))[F.col(gt)]).alias("ce"),
        (F.avg(kl) * temperature * temperature).alias("kl"),
    )
    return agg.withColumn("total", alpha * F.col("ce") + (1 - alpha) * F.col("kl"))


def focal_score(
    df: DataFrame,
    classes: int,
    gamma: float = 2.0,
    alpha: float = 0.5,
    by: Sequence[str] = (),
    logits: str = "logits",
    gt: str = "gt",
) -> DataFrame:
    """Sigmoid focal loss, mean over pixels and classes."""
    terms = []
    for c in range(classes):
        z, t = F.col(logits)[c], (F.col(gt) == c).cast("double")
        p = 1.0 / (1.0 + F.exp(-z))
        miss = (1 - p) * t + p * (1 - t)
        weight = (alpha * t + (1 - alpha) * (1 - t)) * F.pow(miss, F.lit(gamma))
        bce = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
        terms.append(bce * weight)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.groupBy(*by).agg((F.avg(total) / classes).alias("focal"))


def _per_class(df, frame, by, classes, exprs, prob, gt):
    """Per-frame, per-class sums, then a mean over frames and classes."""
    aggs = []
    for c in range(classes):
        p, t = F.col(prob)[c], (F.col(gt) == c).cast("double")
        aggs += [F.sum(e(p, t)).alias(f"_{name}{c}") for name, e in exprs.items()]
    return df.groupBy(*by, frame).agg(*aggs)


def tversky_score(
    df: DataFrame,
    classes: int,
    alpha: float = 0.3,
    beta: float = 0.7,
    smooth: float = 1.0,
    by: Sequence[str] = (),
    frame: str = "frame_id",
    prob: str = "prob",
    gt: str = "gt",
) -> DataFrame:
    exprs = {
        "tp": lambda p, t: p * t,
        "fp": lambda p, t: p * (1 - t),
        "fn": lambda p, t: (1 - p) * t,
    }
    per = _per_class(df, frame, by, classes, exprs, prob, gt)
    loss = [
        1
        - (F.col(f"_tp{c}") + smooth)
        / (F.col(f"_tp{c}") + alpha * F.col(f"_fp{c}") + beta * F.col(f"_fn{c}") + smooth)
        for c in range(classes)
    ]
    return per.groupBy(*by).agg(F.avg(sum(loss[1:], loss[0]) / classes).alias("tversky"))


def soft_dice(
    df: DataFrame,
    classes: int,
    smooth: float = 1.0,
    exponent: float = 2.0,
    by: Sequence[str] = (),
    frame: str = "frame_id",
    prob: str = "prob",
    gt: str = "gt",
) -> DataFrame:
    exprs = {
        "num": lambda p, t: p * t,
        "den": lambda p, t: F.pow(p, F.lit(exponent)) + F.pow(t, F.lit(exponent)),
    }
    per = _per_class(df, frame, by, classes, exprs, prob, gt)
    loss = [
        1 - (2 * F.col(f"_num{c}") + smooth) / (F.col(f"_den{c}") + smooth) for c in range(classes)
    ]
    return per.groupBy(*by).agg(F.avg(sum(loss[1:], loss[0]) / classes).alias("dice_loss"))
