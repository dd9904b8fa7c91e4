"""Evaluation curves: (arm, idx, metrics..) with idx counting from 0 per arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.ordered import first_n, row_index, running


def tail_mean(
    evals: DataFrame, metrics: Sequence[str], n: int = 5, arm: str = "arm", idx: str = "idx"
) -> DataFrame:
    """Mean of the last n evaluations per arm."""
    last = first_n(evals, n, [arm], [F.desc(idx)])
    return last.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]
    )


def peak_and_final(
    evals: DataFrame, metric: str, arm: str = "arm", idx: str = "idx", min_evals: int = 4
) -> DataFrame:
    """Peak, first evaluation reaching it (1-based), final value and their gap."""
    best = F.max(F.struct(F.col(metric), (-F.col(idx)).alias("neg")))
    out = evals.groupBy(arm).agg(
        F.count(F.lit(1)).alias("evals"),
        best.alias("_b"),
        F.max_by(metric, idx).alias("final"),
    )
    return out.filter(F.col("evals") >= min_evals).select(
        arm,
        "evals",
        F.col(f"_b.{metric}").alias("peak"),
        (1 - F.col("_b.neg")).alias("peak_at"),
        "final",
        (F.col(f"_b.{metric}") - F.col("final")).alias("gap"),
    )


def align_loss_to_eval(
    evals: DataFrame, losses: DataFrame, arm: str = "arm", idx: str = "idx"
) -> DataFrame:
    """Mean training loss of the epoch that evaluation i falls into.

    With E epochs and n evaluations that is epoch min(floor((i+1) E / n) - 1, E - 1)
    in sorted order.
    """
    per_epoch = losses.groupBy(arm, "epoch").agg(F.avg("loss").alias("train_loss"))
    epochs = row_index(per_epoch, [arm], ["epoch"], "_j")
    sizes = per_epoch.groupBy(arm).agg(F.count(F.lit(1)).alias("_e")).join(
        evals.groupBy(arm).agg(F.count(F.lit(1)).alias("_n")), arm
    )
    j = F.least(
        F.floor((F.col(idx) + 1) * F.col("_e") / F.col("_n")) - 1, F.col("_e") - 1
    )
    placed = evals.join(sizes, arm, "left").withColumn("_j", j)
    return placed.join(epochs.select(arm, "_j", "train_loss"), [arm, "_j"], "left").drop(
        "_j", "_e", "_n"
    )


def delta_vs_baseline(
    metrics: DataFrame, values: Sequence[str], keys: Sequence[str], baseline: str, arm: str = "arm"
) -> DataFrame:
    """Difference of every other arm to the baseline arm, per key."""
    base = metrics.filter(F.col(arm) == baseline).select(
        *keys, *[F.col(v).alias(f"_b_{v}") for v in values]
    )
    rest = metrics.filter(F.col(arm) != baseline)
    return rest.join(base, list(keys)).select(
        arm, *keys, *[(F.col(v) - F.col(f"_b_{v}")).alias(f"delta_{v}") for v in values]
    )


def all_sets_agree(deltas: DataFrame, delta: str, arm: str = "arm") -> DataFrame:
    """Does a change move every set the same way, and which way."""
    return deltas.groupBy(arm).agg(
        F.count(F.lit(1)).alias("sets"),
        F.bool_and(F.col(delta) > 0).alias("all_up"),
        F.bool_and(F.col(delta) < 0).alias("all_down"),
    )


def running_best(
    evals: DataFrame, metric: str, arm: str = "arm", idx: str = "idx"
) -> DataFrame:
    """Best so far, flagged only where it strictly improves."""
    out = running(evals, [arm], [idx], {"_prev": ("max", metric)}, exclusive=True)
    improved = F.col("_prev").isNull() | (F.col(metric) > F.col("_prev"))
    return out.withColumns(
        {"is_best": improved, "best": F.greatest("_prev", metric)}
    ).drop("_prev")
