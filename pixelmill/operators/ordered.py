"""Ordered computations that never put one whole group into one task.

A plain ``Window.partitionBy(group).orderBy(..)`` sends a group to a single
task. When one group may hold a third of a very large table that task is the
job. ``running`` range-partitions on (group, order) instead, so a hot group is
spread over many slices, computes running values inside each slice and adds the
carried-over value of the earlier slices from a table that has one row per
(group, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import cut_lineage

_SLICE = "_slice"
_ALL = "_all"

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def _as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    aggs: dict[str, tuple[str, str | Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates per group in the given order.

    ``aggs`` maps an output name to ``(kind, column)`` with kind one of sum, max,
    min, count. ``order`` has to be a total order inside a group. With
    ``exclusive`` the current row is left out (NULL, or 0 for sum and count, on
    the first row).
    """
    df, keys = _keyed(df, by)
    order = [_as_column(c) for c in order]
    sliced = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            _SLICE, F.spark_partition_id()
        )
    )
    end = -1 if exclusive else Window.currentRow
    within = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    before = (
        Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = sliced.groupBy(*keys, _SLICE).agg(
        *[_AGG[kind](_as_column(c)).alias(f"_t_{name}") for name, (kind, c) in aggs.items()]
    )
    carried = totals.select(
        *keys,
        _SLICE,
        *[
            _AGG["sum" if kind == "count" else kind](F.col(f"_t_{name}"))
            .over(before)
            .alias(f"_c_{name}")
            for name, (kind, _) in aggs.items()
        ],
    )
    local = sliced.withColumns(
        {f"_l_{name}": _AGG[kind](_as_column(c)).over(within) for name, (kind, c) in aggs.items()}
    )
    # a NULL group is a group like others
    carried = carried.toDF(*[f"_k_{c}" if c in (*keys, _SLICE) else c for c in carried.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, _SLICE)]
    joined = local.join(carried, same, "left").drop(*[f"_k_{k}" for k in (*keys, _SLICE)])
    for name, (kind, _) in aggs.items():
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        else:
            value = F.greatest(here, there) if kind == "max" else F.least(here, there)
        joined = joined.withColumn(name, value)
    scratch = [_SLICE, *[f"_{p}_{n}" for p in "lc" for n in aggs]]
    if not by:
        scratch.append(_ALL)
    return joined.drop(*scratch)


def row_index(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "row_index"
) -> DataFrame:
    """0-based position of every row in its group; hot groups are split."""
    out = running(df, by, order, {name: ("count", F.lit(1))})
    return out.withColumn(name, F.col(name) - 1)


def first_n(
    df: DataFrame,
    n: int,
    by: Sequence[str],
    order: Sequence[str | Column],
) -> DataFrame:
    """The first ``n`` rows per group (or overall).

    Up to the session's group-limit threshold Spark keeps at most ``n`` rows per group in
    each map task, so no group arrives whole anywhere. Larger ``n`` goes through
    ``row_index``: the same rows by another plan.
    """
    cols = [_as_column(c) for c in order]
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        if not by:
            return df.orderBy(*cols).limit(n)
        w = Window.partitionBy(*by).orderBy(*cols)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return row_index(df, by, order, "_rn").filter(F.col("_rn") < n).drop("_rn")


def value_counts(df: DataFrame, by: Sequence[str], value: str | Column, weight=None) -> DataFrame:
    """(by.., value, n): rows collapsed to distinct finite values, map-side first."""
    v = _as_column(value)
    picked = df.select(*by, v.alias("value"), *([] if weight is None else [weight.alias("_w")]))
    picked = picked.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    n = F.count(F.lit(1)) if weight is None else F.sum("_w")
    return picked.groupBy(*by, "value").agg(n.alias("n"))


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str | Column, qs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated percentiles per group, plus ``n``.

    Works on distinct values and running counts, so neither a hot group nor a
    long value list has to fit in one task (``percentile`` would need both).
    """
    counts, keys = _keyed(value_counts(df, by, value), by)
    cum = running(counts, keys, ["value"], {"_cum": ("sum", "n")})
    total = cum.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sum("n").alias("_total"))
    # a NULL group is a group like others
    ranked = cum.join(total, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    v = F.col("value").cast("double")
    picks = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("_total") - 1)
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (at >= F.col("_cum") - F.col("n")) & (at < F.col("_cum"))
            picks.append(F.max(F.when(inside, v)).alias(f"_{end}_{name}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    agg = ranked.groupBy(*keys).agg(F.max("_total").alias("n"), *picks)
    out = agg.select(
        *keys,
        "n",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")
            ).alias(name)
            for name in qs
        ],
    )
    return out if by else out.drop(_ALL)
