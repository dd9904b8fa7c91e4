"""Distribution, ranking and drift statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.ordered import exact_percentiles, running, value_counts

_ALL = "_all"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def mask_fraction_stats(
    df: DataFrame, fg: Column, frame: str = "frame_id", by: Sequence[str] = ()
) -> DataFrame:
    """Spread of the foreground share over frames, and degenerate-mask counts."""
    df, keys = _group(df, by)
    per = df.groupBy(*keys, frame).agg(
        (F.count_if(fg) / F.count(F.lit(1))).alias("share")
    )
    base = per.groupBy(*keys).agg(
        F.avg("share").alias("mean"),
        F.min("share").alias("min"),
        F.max("share").alias("max"),
        F.count_if(F.col("share") == 0).alias("all_zero"),
        F.count_if(F.col("share") > 0.9).alias("near_all_one"),
    )
    pct = exact_percentiles(per, keys, "share", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    out = base.join(pct.withColumnRenamed("n", "frames"), keys)
    return out if by else out.drop(_ALL)


def stat_block(df: DataFrame, by: Sequence[str], col: str | Column) -> DataFrame:
    """n, mean, median, quartiles and IQR of finite values; NULLs for an empty group."""
    v = _col(col).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    df, keys = _group(df, by)
    d = df.select(*keys, F.when(finite, v).alias("_v"))
    base = d.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    pct = exact_percentiles(d, keys, "_v", {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n")
    out = base.join(pct, keys, "left").withColumn("iqr", F.col("q75") - F.col("q25"))
    return out if by else out.drop(_ALL)


def _bin_of(v: Column, edges: Sequence[float]) -> Column:
    """Right-open bins, the last one closed; NULL outside."""
    last = len(edges) - 2
    out = F.when(v == edges[-1], last)
    for i in range(last, -1, -1):
        out = out.when((v >= edges[i]) & (v < edges[i + 1]), i)
    return out


def _spread(df, by, bins, edges):
    """Long rows from one array column per group, empty bins included."""
    lo = F.array(*[F.lit(float(e)) for e in edges[:-1]])
    hi = F.array(*[F.lit(float(e)) for e in edges[1:]])
    return df.select(*by, F.posexplode(bins).alias("bin", "n")).select(
        *by, "bin", lo[F.col("bin")].alias("lo"), hi[F.col("bin")].alias("hi"), "n"
    )


def histogram(
    df: DataFrame, col: str | Column, edges: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by.., bin, lo, hi, n) in one pass: a conditional count per bin, then unpivoted."""
    b = _bin_of(_col(col), edges)
    d = df.select(*by, b.alias("_b"))
    counts = [F.count_if(F.col("_b") == i) for i in range(len(edges) - 1)]
    return _spread(d.groupBy(*by).agg(F.array(*counts).alias("_bins")), by, F.col("_bins"), edges)


def weighted_histogram(
    df: DataFrame,
    col: str | Column,
    weight: str | Column,
    edges: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Weight sums per bin, as ``n``."""
    d = df.select(*by, _bin_of(_col(col), edges).alias("_b"), _col(weight).alias("_w"))
    sums = [
        F.coalesce(F.sum(F.when(F.col("_b") == i, F.col("_w"))), F.lit(0.0))
        for i in range(len(edges) - 1)
    ]
    return _spread(d.groupBy(*by).agg(F.array(*sums).alias("_bins")), by, F.col("_bins"), edges)


def peak_over_uniform(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """max bin * bins / total; 1 for an empty histogram."""
    top = F.max("n") * F.count(F.lit(1)) / F.sum("n")
    return hist.groupBy(*by).agg(F.when(F.sum("n") > 0, top).otherwise(1.0).alias("peak"))


def histogram_percentile(
    hist: DataFrame, qs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Midpoint of the first bin whose cumulative count reaches q * total.

    ``hist`` has one row per bin, so the window holds as many rows as bins.
    """
    hist, keys = _group(hist, by)
    w = Window.partitionBy(*keys).orderBy("bin")
    total = F.sum("n").over(Window.partitionBy(*keys))
    d = hist.withColumns(
        {"_cum": F.sum("n").over(w), "_total": total, "_mid": (F.col("lo") + F.col("hi")) / 2}
    )
    picks = [
        F.min(F.when(F.col("_cum") >= q * F.col("_total"), F.col("_mid"))).alias(name)
        for name, q in qs.items()
    ]
    out = d.groupBy(*keys).agg(*picks)
    return out if by else out.drop(_ALL)


def channel_histogram(
    df: DataFrame, by: Sequence[str] = (), channels: Sequence[str] = ("b", "g", "r")
) -> DataFrame:
    """(by.., channel, value, n)."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in channels]
    )
    return (
        df.select(*by, F.inline(rows))
        .groupBy(*by, "channel", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram_moments(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std recovered from a value histogram."""
    n, v = F.col("n"), F.col("value").cast("double")
    mean = F.sum(n * v) / F.sum(n)
    second = F.sum(n * v * v) / F.sum(n)
    return hist.groupBy(*by).agg(
        F.sum("n").alias("n"),
        mean.alias("mean"),
        F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"),
    )


def histogram_cosine(
    df: DataFrame, source: Sequence[str], frame: str = "frame_id", step: int = 16
) -> DataFrame:
    """Cosine of the (256/step)^3 colour histogram of each frame to the first frame
    of its source."""
    packed = (
        F.floor(F.col("b") / step) * 65536 + F.floor(F.col("g") / step) * 256
        + F.floor(F.col("r") / step)
    ).cast("int")
    h = df.groupBy(*source, frame, packed.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    norms = h.groupBy(*source, frame).agg(
        F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")
    )
    first = norms.groupBy(*source).agg(F.min_by(F.struct(frame, "norm"), frame).alias("_r"))
    ref = first.select(*source, F.col("_r")[frame].alias("_rf"), F.col("_r")["norm"].alias("_rn"))
    ref_h = h.join(
        ref.select(*source, F.col("_rf").alias(frame)), [*source, frame], "left_semi"
    ).select(*source, "cell", F.col("n").alias("_m"))
    dot = (
        h.join(ref_h, [*source, "cell"])
        .groupBy(*source, frame)
        .agg(F.sum(F.col("n") * F.col("_m")).alias("_dot"))
    )
    out = norms.join(dot, [*source, frame], "left").join(ref, list(source))
    return out.select(
        *source,
        frame,
        (F.coalesce(F.col("_dot"), F.lit(0)) / (F.col("norm") * F.col("_rn"))).alias("cosine"),
    )


def distinct_colours(df: DataFrame, by: Sequence[str], approximate: bool = False) -> DataFrame:
    packed = F.col("b") + F.col("g") * 256 + F.col("r") * 65536
    n = F.approx_count_distinct(packed) if approximate else F.count_distinct(packed)
    return df.groupBy(*by).agg(n.alias("colours"))


def colourfulness_agg(keep: Column | None = None) -> Column:
    """Opponent-colour spread and mean in one number, as an aggregate expression."""
    keep = F.lit(True) if keep is None else keep
    b, g, r = (F.col(c).cast("double") for c in "bgr")
    rg = F.when(keep, r - g)
    yb = F.when(keep, 0.5 * (r + g) - b)
    sd = F.hypot(F.stddev_pop(rg), F.stddev_pop(yb))
    mu = F.hypot(F.avg(rg), F.avg(yb))
    return F.coalesce(sd + 0.3 * mu, F.lit(0.0))


def colourfulness(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(colourfulness_agg().alias("colourfulness"))


def roc_auc(df: DataFrame, by: Sequence[str], score: str | Column, positive: Column) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; NULL with one class only.

    Rows collapse to distinct scores before anything is ordered.
    """
    df, keys = _group(df, by)
    d = df.select(*keys, _col(score).alias("score"), positive.cast("bigint").alias("_p"))
    counts = d.groupBy(*keys, "score").agg(
        F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg")
    )
    cum = running(counts, keys, ["score"], {"_below": ("sum", "neg")}, exclusive=True)
    won = F.col("pos") * (F.col("_below") + F.col("neg") / 2)
    agg = cum.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(won).alias("_won")
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    auc = F.when(both, F.col("_won") / (F.col("positives") * F.col("negatives")))
    out = agg.select(*keys, "positives", "negatives", auc.alias("auc"))
    return out if by else out.drop(_ALL)


def cliffs_delta(
    df: DataFrame, by: Sequence[str], value: str | Column, is_a: Column, is_b: Column
) -> DataFrame:
    """P(a > b) - P(a < b), exact; NULL when a side is empty."""
    df, keys = _group(df, by)
    d = df.select(
        *keys, _col(value).alias("v"), is_a.cast("bigint").alias("_a"), is_b.cast("bigint").alias("_b")
    ).filter(F.col("v").isNotNull() & ((F.col("_a") + F.col("_b")) > 0))
    counts = d.groupBy(*keys, "v").agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    cum = running(counts, keys, ["v"], {"_below": ("sum", "nb")}, exclusive=True)
    total = cum.groupBy(*keys).agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))
    above = F.col("n_b") - F.col("_below") - F.col("nb")
    score = F.sum(F.col("na").cast("decimal(38,0)") * (F.col("_below") - above))
    out = (
        cum.join(total, keys)
        .groupBy(*keys, "n_a", "n_b")
        .agg(score.cast("double").alias("_s"))
        .select(
            *keys,
            "n_a",
            "n_b",
            F.when(
                (F.col("n_a") > 0) & (F.col("n_b") > 0),
                F.col("_s") / (F.col("n_a").cast("double") * F.col("n_b")),
            ).alias("delta"),
        )
    )
    return out if by else out.drop(_ALL)


def unpivot(df: DataFrame, keep: Sequence[str], properties: dict[str, Column]) -> DataFrame:
    """(keep.., property, value) rows for a handful of named expressions."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("property"), c.cast("double").alias("value"))
            for n, c in properties.items()
        ]
    )
    return df.select(*keep, F.inline(rows))


def rank_effects(
    deltas: DataFrame, by: Sequence[str] = (), name: str = "property", delta: str = "delta"
) -> DataFrame:
    """Properties by absolute effect size, with direction. One row per property in."""
    deltas, keys = _group(deltas.filter(F.col(delta).isNotNull()), by)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.col(delta))), name)
    out = deltas.select(
        *keys,
        name,
        delta,
        F.row_number().over(w).alias("rank"),
        F.when(F.col(delta) < 0, "lower").otherwise("higher").alias("direction"),
    )
    return out if by else out.drop(_ALL)


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson; NULL with fewer than two rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.filter(both)
    ok = (F.count(F.lit(1)) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.when(ok, F.corr(x, y)).alias("corr")
    )


def threshold_sweep(
    df: DataFrame, prob: Column, taus: Sequence[float], frame: str = "frame_id", by: Sequence[str] = ()
) -> DataFrame:
    """Mean coverage percent per threshold; all thresholds in one scan."""
    n = F.count(F.lit(1))
    per = df.groupBy(*by, frame).agg(
        *[(100.0 * F.count_if(prob > t) / n).alias(f"_t{i}") for i, t in enumerate(taus)]
    )
    means = per.groupBy(*by).agg(*[F.avg(f"_t{i}").alias(f"_t{i}") for i in range(len(taus))])
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("tau"), F.col(f"_t{i}").alias("mean_pct"))
            for i, t in enumerate(taus)
        ]
    )
    return means.select(*by, F.inline(rows))


def soft_mass(
    df: DataFrame, prob: Column, other_mask: Column, frame: str = "frame_id", by: Sequence[str] = ()
) -> DataFrame:
    """Expected area of one model and its share outside / inside the other's mask."""
    per = df.groupBy(*by, frame).agg(
        F.sum(prob).alias("_m"),
        F.sum(F.when(other_mask, prob).otherwise(0.0)).alias("_in"),
        F.count_if(other_mask).alias("_area"),
    )
    m, inside = F.col("_m"), F.col("_in")
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(m).alias("mean_mass"),
        F.avg("_area").alias("mean_other_area"),
        F.when(F.sum(m) > 0, F.sum(m - inside) / F.sum(m)).alias("outside_pooled"),
        F.when(F.sum(m) > 0, F.sum(inside) / F.sum(m)).alias("inside_pooled"),
        F.avg(F.when(m > 1e-9, (m - inside) / m)).alias("outside_mean"),
    )


def partition_label(a: Column, b: Column) -> Column:
    return F.when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("neither")


def partition_stats(
    df: DataFrame, a: Column, b: Column, score: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Agreement cells of two masks with counts and score statistics."""
    d = df.select(*by, partition_label(a, b).alias("cell"), _col(score).alias("score"))
    return stat_block(d, [*by, "cell"], "score")


# Features: (by.., img_set, img_id, feat ARRAY<DOUBLE>).


def channel_moments(feat: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., channel, mean, std) over images; partial sums combine map-side."""
    return (
        feat.select(*by, F.posexplode("feat").alias("channel", "v"))
        .groupBy(*by, "channel")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    )


def _safe(std: Column) -> Column:
    return F.when(std > 1e-12, std).otherwise(1.0)


def channel_drift(feat: DataFrame, img_set: str, new: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """z of one set's channel means against a reference set, summarised per group."""
    m = channel_moments(feat.filter(F.col(img_set).isin(new, ref)), [*by, img_set])
    is_ref = F.col(img_set) == ref
    z = m.groupBy(*by, "channel").agg(
        F.max(F.when(is_ref, F.col("mean"))).alias("mu"),
        F.max(F.when(is_ref, F.col("std"))).alias("sd"),
        F.max(F.when(~is_ref, F.col("mean"))).alias("mn"),
    )
    z = z.select(*by, F.abs((F.col("mn") - F.col("mu")) / _safe(F.col("sd"))).alias("z"))
    return z.groupBy(*by).agg(
        F.count("z").alias("channels"),
        F.max("z").alias("max_abs_z"),
        F.percentile("z", F.lit(0.95)).alias("p95_abs_z"),
        F.avg("z").alias("mean_abs_z"),
        F.avg((F.col("z") > 3).cast("double")).alias("share_gt_3"),
    )


def _moment_arrays(feat: DataFrame) -> DataFrame:
    """One row: mean and std arrays over channels. Its size is the feature width."""
    m = channel_moments(feat, [])
    ordered = F.array_sort(F.collect_list(F.struct("channel", "mean", "std")))
    return m.agg(
        F.struct(
            F.transform(ordered, lambda s: s["mean"]).alias("mu"),
            F.transform(ordered, lambda s: s["std"]).alias("sd"),
        ).alias("m")
    )


def _p_of_sorted(a: Column, q: float) -> Column:
    pos = q * (F.size(a) - 1)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    return F.get(a, lo) + (F.get(a, hi) - F.get(a, lo)) * (pos - lo)


def image_drift(feat: DataFrame, img_set: str, new: str, ref: str, img: str = "img_id") -> DataFrame:
    """Per image of ``new``: max and p95 of |z| over channels against ``ref``.

    The reference moments are one small row, so images are scored where they lie.
    """
    ref_rows = feat.filter(F.col(img_set) == ref)
    rows = feat.filter(F.col(img_set) == new).withColumn("_m", _moment_arrays(ref_rows).scalar())
    z = F.zip_with(
        F.zip_with("feat", F.col("_m.mu"), lambda v, mu: v - mu),
        F.col("_m.sd"),
        lambda d, sd: F.abs(d / _safe(sd)),
    )
    rows = rows.withColumn("_z", F.array_sort(z))
    return rows.select(
        img,
        F.array_max("_z").alias("max_abs_z"),
        _p_of_sorted(F.col("_z"), 0.95).alias("p95_abs_z"),
    )


def outside_global_mean(feat: DataFrame, img_set: str, new: str, ref: str) -> DataFrame:
    """Share of new images whose mean activation leaves mean +- 3 std of the reference."""
    total = F.aggregate("feat", F.lit(0.0), lambda acc, v: acc + v)
    g = feat.select(F.col(img_set).alias("_s"), (total / F.size("feat")).alias("gm"))
    r = g.filter(F.col("_s") == ref).agg(
        F.struct(F.avg("gm").alias("mu"), F.stddev_pop("gm").alias("sd")).alias("m")
    )
    rows = g.filter(F.col("_s") == new).withColumn("_m", r.scalar())
    out = F.abs(F.col("gm") - F.col("_m.mu")) > 3 * F.col("_m.sd")
    return rows.agg(
        F.count(F.lit(1)).alias("images"), F.avg(out.cast("double")).alias("share_outside")
    )


def centroid_cosine(feat: DataFrame, img_set: str, a: str, b: str) -> DataFrame:
    m = channel_moments(feat.filter(F.col(img_set).isin(a, b)), [img_set])
    p = m.groupBy("channel").agg(
        F.max(F.when(F.col(img_set) == a, F.col("mean"))).alias("u"),
        F.max(F.when(F.col(img_set) == b, F.col("mean"))).alias("v"),
    )
    u, v = F.col("u"), F.col("v")
    norm = F.sqrt(F.sum(u * u)) * F.sqrt(F.sum(v * v)) + 1e-12
    return p.agg((F.sum(u * v) / norm).alias("cosine"))


def nearest_centroid(
    feat: DataFrame, name: str = "centroid", img: str = "img_id", is_ref: Column | None = None
) -> DataFrame:
    """Nearest named centroid per image in z-scaled space.

    Scales and centroids come from the reference rows; both are one small row
    (names x channels) that each image is compared with in place.
    """
    ref = feat if is_ref is None else feat.filter(is_ref)
    scale = _moment_arrays(ref)
    cents = channel_moments(ref, [name])
    per = cents.groupBy(name).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("channel", "mean"))), lambda s: s["mean"]
        ).alias("c")
    )
    packed = per.agg(F.collect_list(F.struct(F.col(name).alias("name"), "c")).alias("cs"))
    rows = feat.withColumns({"_m": scale.scalar(), "_cs": packed.scalar()})
    sd = F.col("_m.sd")

    def dist(c):
        diff = F.zip_with(
            F.zip_with("feat", c, lambda v, m: v - m), sd, lambda d, s: d / (s + 1e-6)
        )
        return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d))

    best = F.array_min(
        F.transform(F.col("_cs"), lambda e: F.struct(dist(e["c"]).alias("d"), e["name"].alias("name")))
    )
    return rows.withColumn("_b", best).select(
        img, F.col("_b.name").alias("nearest"), F.col("_b.d").alias("distance")
    )


def latency_summary(
    df: DataFrame,
    by: Sequence[str],
    ms: str = "ms",
    arm: str | None = None,
    baseline: str | None = None,
) -> DataFrame:
    """Timing spread per configuration and the ratio to a baseline arm."""
    base = df.groupBy(*by).agg(
        F.avg(ms).alias("mean_ms"),
        F.stddev_pop(ms).alias("std_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
    )
    pct = exact_percentiles(df, by, ms, {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95})
    out = base.join(pct, list(by)).withColumn("fps", 1000.0 / F.col("mean_ms"))
    if arm is None:
        return out
    rest = [c for c in by if c != arm]
    ref = out.filter(F.col(arm) == baseline).select(*rest, F.col("mean_ms").alias("_b"))
    joined = out.join(ref, rest, "left")
    return joined.withColumn("speedup", F.col("_b") / F.col("mean_ms")).drop("_b")


def calibration_range(
    feat: DataFrame, order: str, start: int, count: int, by: Sequence[str] = ("channel",),
    lo: float = 0.001, hi: float = 0.999,
) -> DataFrame:
    """Per-channel min, max and percentile range over rows start .. start+count-1."""
    from pixelmill.operators.ordered import row_index

    i = F.col("_i")
    rows = row_index(feat, [], [order], "_i").filter((i >= start) & (i < start + count))
    long = rows.select(F.posexplode("feat").alias("channel", "v"))
    ends = long.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return ends.join(exact_percentiles(long, by, "v", {"p_lo": lo, "p_hi": hi}), list(by))


def bbox(points: DataFrame, by: Sequence[str], axes: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    aggs = []
    for a in axes:
        aggs += [
            F.min(a).alias(f"min_{a}"),
            F.max(a).alias(f"max_{a}"),
            (F.max(a) - F.min(a)).alias(f"extent_{a}"),
            F.avg(a).alias(f"centre_{a}"),
        ]
    return points.groupBy(*by).agg(*aggs)
