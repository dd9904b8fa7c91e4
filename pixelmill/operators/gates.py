"""Quality gates.

Every gate returns rows (gate, group, observed, threshold, n_bad, passed);
``observed`` and ``threshold`` are doubles. ``run_gates`` unions them and
``assert_gates`` raises when one failed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.hamming import nearest_hamming
from pixelmill.operators.ordered import exact_percentiles
from pixelmill.operators.windows import morph
from pixelmill.session import cut_lineage


class GateError(AssertionError):
    """A quality gate did not pass."""


def gate_rows(
    df: DataFrame, name: str, observed: Column, threshold, n_bad: Column, passed: Column,
    group: Column | None = None,
) -> DataFrame:
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.select(
        F.lit(name).alias("gate"),
        (F.lit("all") if group is None else group.cast("string")).alias("group"),
        observed.cast("double").alias("observed"),
        thr.cast("double").alias("threshold"),
        n_bad.cast("bigint").alias("n_bad"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _bad_count(df: DataFrame, name: str, bad: Column, by: str | None, limit: int = 0) -> DataFrame:
    """Gate on the number of rows for which ``bad`` holds."""
    keys = [by] if by else []
    agg = df.groupBy(*keys).agg(F.count_if(bad).alias("_b"))
    b = F.col("_b")
    return gate_rows(agg, name, b, limit, b, b <= limit, F.col(by) if by else None)


def run_gates(gates: Iterable[DataFrame]) -> DataFrame:
    out = None
    for g in gates:
        out = g if out is None else out.unionByName(g)
    return out


def assert_gates(df: DataFrame) -> None:
    failed = [r["gate"] for r in df.filter(~F.col("passed")).select("gate").distinct().collect()]
    if failed:
        raise GateError(f"failed gates: {', '.join(sorted(failed))}")


def gate_file_counts(
    inventory: DataFrame, expected: DataFrame, channels: Sequence[str], key: str = "set_id"
) -> DataFrame:
    """Files per set and channel against the expected number: one row per channel.
    ``expected`` is (key, frames)."""
    wanted = expected.select(key, "frames", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    have = inventory.groupBy(key, "channel").agg(F.count(F.lit(1)).alias("_n"))
    j = wanted.join(have, [key, "channel"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    agg = j.groupBy("channel").agg(
        F.sum("_n").alias("_o"),
        F.sum("frames").alias("_e"),
        F.count_if(F.col("_n") != F.col("frames")).alias("_b"),
    )
    return gate_rows(agg, "file_counts", F.col("_o"), F.col("_e"), F.col("_b"), F.col("_b") == 0, F.col("channel"))


def gate_label_values(
    df: DataFrame, allowed: Sequence[int], label: str = "label", by: str | None = None
) -> DataFrame:
    """Pixels whose label is not allowed."""
    return _bad_count(df, "label_values", ~F.col(label).isin(list(allowed)), by)


def gate_depth_range(
    df: DataFrame, lo: int = 500, hi: int = 1500, depth: str = "depth_mm", by: str | None = None
) -> DataFrame:
    d = F.col(depth)
    return _bad_count(df, "depth_range", (d > 0) & ((d < lo) | (d > hi)), by)


def gate_frame_shape(df: DataFrame, h: int, w: int, frame: str = "frame_id") -> DataFrame:
    """Frames that are not a complete h x w grid."""
    per = df.groupBy(frame).agg(
        F.count(F.lit(1)).alias("_n"), F.max("y").alias("_y"), F.max("x").alias("_x"),
        F.min("y").alias("_y0"), F.min("x").alias("_x0"),
    )
    ok = (
        (F.col("_n") == h * w) & (F.col("_y") == h - 1) & (F.col("_x") == w - 1)
        & (F.col("_y0") == 0) & (F.col("_x0") == 0)
    )
    return _bad_count(per, "frame_shape", ~ok, None)


def gate_recode_conserved(
    df: DataFrame, old: str, new: str, mapping: dict[int, int], frame: str = "frame_id"
) -> DataFrame:
    """Per frame, each new label has as many pixels as the old labels mapped to it."""
    codes = sorted(set(mapping.values()))
    aggs = []
    for c in codes:
        src = [k for k, v in mapping.items() if v == c]
        aggs.append(
            (F.count_if(F.col(old).isin(src)) != F.count_if(F.col(new) == c)).cast("int").alias(f"_c{c}")
        )
    per = df.groupBy(frame).agg(*aggs)
    bad = sum((F.col(f"_c{c}") for c in codes), F.lit(0)) > 0
    return _bad_count(per, "recode_conserved", bad, None)


def gate_label_agreement(
    df: DataFrame, derived: str, source: Column, by: str | None = None
) -> DataFrame:
    """Derived labels that differ from what their source label implies."""
    return _bad_count(df, "label_agreement", ~F.col(derived).eqNullSafe(source), by)


def gate_negatives_clean(
    pixels: DataFrame, is_negative: Column, label: str = "label", frame: str = "frame_id",
    split: str | None = None,
) -> DataFrame:
    """Negative frames have all-zero labels, and none of them sits in val."""
    cols = [F.max(label).alias("_m")]
    if split:
        cols.append(F.max((F.col(split) == "val").cast("int")).alias("_v"))
    per = pixels.filter(is_negative).groupBy(frame).agg(*cols)
    bad = F.col("_m") > 0
    if split:
        bad = bad | (F.col("_v") > 0)
    return _bad_count(per, "negatives_clean", bad, None)


def gate_first_line(manifest: DataFrame, ok: Column, order: str = "line_no", by: str | None = None):
    """The first manifest line satisfies ``ok`` (a legacy-encoded frame)."""
    keys = [by] if by else []
    first = manifest.groupBy(*keys).agg(F.min_by(ok.cast("int"), order).alias("_ok"))
    good = F.col("_ok") == 1
    return gate_rows(
        first, "first_line", F.col("_ok"), 1, F.when(good, 0).otherwise(1), good,
        F.col(by) if by else None,
    )


def leak_verdicts(
    cand: DataFrame, forbidden: DataFrame, thresh: int, sha: str = "sha"
) -> DataFrame:
    """Verdict per candidate, first that applies: unreadable (no hash), exact, near, keep.

    Both sides are (id, sha, hash). Adds min_distance (0 for an exact copy; NULL only without
    a hash or if no forbidden row has one), nearest_id and verdict.
    """
    same = forbidden.filter(F.col(sha).isNotNull()).groupBy(sha).agg(F.min("id").alias("_exact"))
    j = nearest_hamming(cand, forbidden).join(same, sha, "left")
    readable = F.col("hash").isNotNull()
    exact = readable & F.col("_exact").isNotNull()
    verdict = (
        F.when(~readable, "REJECT_UNREADABLE")
        .when(exact, "REJECT_EXACTDUP")
        .when(F.col("min_distance") <= thresh, "REJECT_PHASH")
        .otherwise("KEEP")
    )
    return j.withColumns(
        {
            "verdict": verdict,
            "min_distance": F.when(exact, 0).otherwise(F.col("min_distance")),
            "nearest_id": F.when(exact, F.col("_exact")).otherwise(F.col("nearest_id")),
        }
    ).drop("_exact")


def gate_leak(verdicts: DataFrame) -> DataFrame:
    """No rejected candidate is left in the set."""
    return _bad_count(verdicts, "leak", F.col("verdict") != "KEEP", None)


#: What the summary reports, in this order.
_VERDICTS = {
    "n_reject_exactdup": "REJECT_EXACTDUP",
    "n_reject_phash": "REJECT_PHASH",
    "n_reject_unreadable": "REJECT_UNREADABLE",
    "n_kept": "KEEP",
}
_HISTOGRAM = 20


def leak_summary(verdicts: DataFrame, forbidden: DataFrame, thresh: int) -> DataFrame:
    """(metric, value): counts of verdicts, and how far away the nearest forbidden hashes are.

    The distribution (min, p1, p5, median, mean, max) and the counts at 0 to 20 bits are over
    readable candidates that are no exact copies; the distribution is NULL without any.
    """
    counts = verdicts.agg(
        F.count(F.lit(1)).cast("double").alias("n_candidates"),
        *[F.count_if(F.col("verdict") == v).cast("double").alias(k) for k, v in _VERDICTS.items()],
    )
    readable = forbidden.agg(F.count("hash").cast("double").alias("n_forbidden"), F.lit(float(thresh)).alias("phash_thresh"))
    near = verdicts.filter(F.col("verdict").isin("REJECT_PHASH", "KEEP") & F.col("min_distance").isNotNull())
    d = F.col("min_distance").cast("double")
    qs = {"min": 0.0, "p1": 0.01, "p5": 0.05, "median": 0.5, "max": 1.0}
    spread = exact_percentiles(near.select(d.alias("d")), [], "d", qs).agg(*[F.max(q).alias(q) for q in qs])
    hist = near.agg(
        F.avg(d).alias("mean"),
        *[F.count_if(F.col("min_distance") == k).cast("double").alias(f"at_{k:02d}") for k in range(_HISTOGRAM + 1)],
    )
    out = None
    for wide in (counts, readable, spread, hist):
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns])
        rows = wide.select(F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out


def gate_min_hamming(a: DataFrame, b: DataFrame, limit: int = 10) -> DataFrame:
    """The closest pair between two hash sets is further apart than ``limit``."""
    near = nearest_hamming(a, b)
    agg = near.agg(F.min("min_distance").alias("_m"), F.count_if(F.col("min_distance") <= limit).alias("_n"))
    return gate_rows(agg, "min_hamming", F.col("_m"), limit, F.col("_n"), F.col("_n") == 0)


def gate_depth_coverage(
    df: DataFrame, min_share: float = 0.55, mean_share: float = 0.75, depth: str = "depth_mm",
    frame: str = "frame_id",
) -> DataFrame:
    """Share of pixels with depth: minimum and mean over frames."""
    per = df.groupBy(frame).agg((F.count_if(F.col(depth) > 0) / F.count(F.lit(1))).alias("_s"))
    agg = per.agg(
        F.min("_s").alias("_min"), F.avg("_s").alias("_mean"),
        F.count_if(F.col("_s") < min_share).alias("_b"),
    )
    lo, mean = F.col("_min"), F.col("_mean")
    return gate_rows(agg, "depth_coverage_min", lo, min_share, F.col("_b"), lo >= min_share).unionByName(
        gate_rows(
            agg, "depth_coverage_mean", mean, mean_share,
            F.when(mean >= mean_share, 0).otherwise(1), mean >= mean_share,
        )
    )


def gate_isolation(
    df: DataFrame, mask: Column, changed: Column, guard: int = 12, frame: str = "frame_id",
    limit: int = 0,
) -> DataFrame:
    """Pixels further than ``guard`` from the mask of either run are unchanged."""
    d = df.select(frame, "y", "x", changed.alias("_chg"), mask.alias("_m"))
    d = morph(d, F.col("_m"), "dilate", guard, "square", frame, "_guard")
    return _bad_count(d, "isolation", (F.col("_guard") == 0) & F.col("_chg"), None, limit)


def gate_object_depth(df: DataFrame, is_object: Column, depth: str = "depth_mm", by: str | None = None):
    """Object pixels without depth."""
    return _bad_count(df, "object_depth", is_object & (F.col(depth) == 0), by)


def gate_asset_counts(
    assets: DataFrame, minimum: dict[str, int], category: str = "category"
) -> DataFrame:
    """At least so many assets per category; a category without any row counts as 0."""
    counts = assets.agg(
        *[F.count_if(F.col(category) == c).alias(f"_n{i}") for i, c in enumerate(minimum)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("_c"), F.col(f"_n{i}").alias("_n"), F.lit(m).alias("_m")
            )
            for i, (c, m) in enumerate(minimum.items())
        ]
    )
    long = counts.select(F.inline(rows))
    short = F.greatest(F.col("_m") - F.col("_n"), F.lit(0))
    return gate_rows(long, "asset_counts", F.col("_n"), F.col("_m"), short, short == 0, F.col("_c"))


def gate_split_disjoint(manifest: DataFrame, group: str = "set_id", split: str = "split") -> DataFrame:
    """Groups that occur in more than one split."""
    per = manifest.groupBy(group).agg(F.count_distinct(split).alias("_s"))
    return _bad_count(per, "split_disjoint", F.col("_s") > 1, None)


def gate_reproduced(joined: DataFrame, name: str = "reproduced", group: str | None = None) -> DataFrame:
    """Rows of ``join_reference`` outside their tolerance; later steps depend on this."""
    agg = joined.agg(F.max("diff").alias("_d"), F.count_if(~F.col("within")).alias("_b"))
    return gate_rows(agg, name, F.col("_d"), 0.0, F.col("_b"), F.col("_b") == 0)


def gate_protected_pixels(df: DataFrame, protected: Column, changed: Column, by: str | None = None):
    """Protected pixels that an edit changed."""
    return _bad_count(df, "protected_pixels", protected & changed, by)


def gate_binding(
    bound: DataFrame, points: DataFrame, nodes: DataFrame, by: Sequence[str] = ("sample_id",),
    max_p95: float = 0.1,
) -> DataFrame:
    """Weights sum to 1, the point is rebuilt from its segment and offset, and the 95 %
    offset is small. Also reports the number of edges in use."""
    by = list(by)
    j = bound.join(points.select(*by, "point_id", "px", "py", "pz").hint("merge"), [*by, "point_id"])
    for end in ("a", "b"):
        n = nodes.select(
            *by, F.col("node_id").alias(end),
            *[F.col(c).alias(f"_{end}{c[1]}") for c in ("nx", "ny", "nz")],
        )
        j = j.join(n.hint("merge"), [*by, end])
    err = F.lit(0.0)
    for c in "xyz":
        rebuilt = F.col(f"_a{c}") * F.col("weight_a") + F.col(f"_b{c}") * F.col("weight_b") + F.col(f"o{c}")
        err = err + (rebuilt - F.col(f"p{c}")) * (rebuilt - F.col(f"p{c}"))
    j = j.withColumns(
        {"_err": F.sqrt(err), "_ws": F.abs(F.col("weight_a") + F.col("weight_b") - 1.0)}
    )
    # one row, of which three gates are made
    agg = cut_lineage(j.agg(
        F.max("_ws").alias("_w"), F.count_if(F.col("_ws") >= 1e-6).alias("_wb"),
        F.max("_err").alias("_e"), F.count_if(F.col("_err") >= 1e-9).alias("_eb"),
        F.count_distinct(*by, "a", "b").alias("_used"),
    ))
    p95 = exact_percentiles(bound, [], "distance", {"_p": 0.95})
    p = F.col("_p")
    return run_gates(
        [
            gate_rows(agg, "bind_weights", F.round("_w", 9), 1e-6, F.col("_wb"), F.col("_wb") == 0),
            gate_rows(agg, "bind_rebuilt", F.round("_e", 6), 1e-9, F.col("_eb"), F.col("_eb") == 0),
            gate_rows(p95, "bind_offset_p95", p, max_p95, F.when(p < max_p95, 0).otherwise(1), p < max_p95),
            gate_rows(agg, "bind_edges_used", F.col("_used"), 1, F.lit(0), F.col("_used") >= 1),
        ]
    )


def gate_motion(
    displacement: DataFrame, boxes: DataFrame, labels_changed: DataFrame, clip: str = "clip",
    max_growth: float = 3.0, max_step: float = 0.5,
) -> DataFrame:
    """Clip checks: same point count, finite, labels kept, box growth and step bounded.

    ``displacement`` comes from frame_displacement, ``boxes`` is (clip, growth) and
    ``labels_changed`` is (clip, changed).
    """
    d = displacement

    def clips(df, name, observed, threshold, ok, worst=F.max):
        agg = df.agg(worst(observed).alias("_o"), F.count_if(~ok).alias("_b"))
        return gate_rows(agg, name, F.col("_o"), threshold, F.col("_b"), F.col("_b") == 0)

    return run_gates(
        [
            clips(d, "motion_point_count", (~F.col("same_count")).cast("int"), 0, F.col("same_count")),
            clips(d, "motion_finite", F.col("non_finite"), 0, F.col("non_finite") == 0),
            clips(d, "motion_step", F.col("max_displacement"), max_step, F.col("max_displacement") < max_step),
            clips(boxes, "motion_box_growth", F.col("growth"), max_growth, F.col("growth") < max_growth),
            clips(labels_changed, "motion_labels", F.col("changed"), 0, F.col("changed") == 0),
        ]
    )


def box_growth(points: DataFrame, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """(clip, growth): longest extent over all frames against the first frame."""
    axes = ("px", "py", "pz")
    per = points.groupBy(clip, frame).agg(
        *[F.min(a).alias(f"_lo{a}") for a in axes], *[F.max(a).alias(f"_hi{a}") for a in axes]
    )
    first = [F.min_by(F.col(f"_hi{a}") - F.col(f"_lo{a}"), frame).alias(f"_f{a}") for a in axes]
    agg = per.groupBy(clip).agg(
        *[(F.max(f"_hi{a}") - F.min(f"_lo{a}")).alias(f"_e{a}") for a in axes], *first
    )
    growth = F.greatest(*[F.col(f"_e{a}") for a in axes]) / F.greatest(
        *[F.col(f"_f{a}") + 1e-8 for a in axes]
    )
    return agg.select(clip, growth.alias("growth"))


def labels_changed(points: DataFrame, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """(clip, changed): points whose label is not the same in all frames."""
    per = points.groupBy(clip, "point_id").agg(
        F.count_distinct("label").alias("_n")
    )
    return per.groupBy(clip).agg(F.count_if(F.col("_n") > 1).alias("changed"))


