"""Dataset mixing on manifests: (dataset, split?, set_id, base, line_no, ..)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.ordered import first_n
from pixelmill.operators.recode import offset_set_id, seeded_sample


def mix(sources: Sequence[tuple[str, DataFrame, int]]) -> DataFrame:
    """Union of (name, manifest, set-id offset) in the given order.

    Output order is (source_order, line_no).
    """
    parts = [
        offset_set_id(df, offset).withColumns(
            {"source_name": F.lit(name), "source_order": F.lit(i)}
        )
        for i, (name, df, offset) in enumerate(sources)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def oversample(
    df: DataFrame, mult: int, stride: int, cap: int = 4, split: str | None = "split"
) -> DataFrame:
    """``mult`` train copies at distinct set-id blocks; other splits once. Above ``cap`` is an error."""
    if mult > cap:
        raise ValueError(f"{mult} copies asked for, the cap is {cap}")
    mult = max(1, mult)
    copies = F.sequence(F.lit(0), F.lit(mult - 1))
    if split is not None:
        copies = F.when(F.col(split) == "train", copies).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("copy", F.explode(copies))
    return offset_set_id(rows, F.col("copy") * stride)


def target_fraction(
    base: DataFrame,
    negatives: DataFrame,
    frac: float,
    max_mult: int,
    seed: int,
    stride: int = 1000,
    key: str = "base",
) -> DataFrame:
    """Negatives making up ``frac`` of base + negatives.

    Enough unique ones: a seeded subsample. Otherwise all of them, repeated at most
    ``max_mult`` times. Two row counts reach the driver, nothing else.
    """
    wanted = round(frac * base.count() / (1.0 - frac))
    have = negatives.count()
    if have >= wanted:
        return seeded_sample(negatives, wanted, seed, key).withColumn("copy", F.lit(0))
    mult = max(1, min(max_mult, round(wanted / max(1, have))))
    return oversample(negatives, mult, stride, cap=max_mult, split=None)


def dose(subs: DataFrame, n: int, order: str = "base") -> DataFrame:
    """First n substitutes in sorted order."""
    return first_n(subs, n, [], [order])


def mix_report(df: DataFrame, source: str = "source_name", order: str = "source_order") -> DataFrame:
    """Rows and share per source, and the ratio to the first source."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    totals = counts.agg(
        F.struct(F.sum("n").alias("all"), F.min_by("n", "_o").alias("first")).alias("t")
    )
    t = totals.scalar()
    return counts.withColumn("_t", t).select(
        source,
        "n",
        (F.col("n") / F.col("_t.all")).alias("share"),
        (F.col("n") / F.col("_t.first")).alias("ratio"),
    )


def diff_manifests(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows only on one side, with multiplicity: (cols.., side, n)."""
    both = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    net = both.groupBy(*cols).agg(F.sum("_d").alias("_net"))
    return net.filter(F.col("_net") != 0).select(
        *cols,
        F.when(F.col("_net") > 0, "only_a").otherwise("only_b").alias("side"),
        F.abs("_net").alias("n"),
    )


def same_lines(a: DataFrame, b: DataFrame, order: str = "line_no", line: str = "base") -> DataFrame:
    """Ordered equality: one row (lines_a, lines_b, different, identical)."""
    x = a.select(F.col(order).alias("_o"), F.col(line).alias("_a"))
    y = b.select(F.col(order).alias("_o"), F.col(line).alias("_b"))
    j = x.join(y, "_o", "full_outer")
    bad = F.count_if(~F.col("_a").eqNullSafe(F.col("_b")))
    return j.agg(
        F.count("_a").alias("lines_a"),
        F.count("_b").alias("lines_b"),
        bad.alias("different"),
        (bad == 0).alias("identical"),
    )


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key. A map-side combined minimum, so a key that holds much
    of the table still costs one row per task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, "_f.*").select(*df.columns)


def dedup_content(
    df: DataFrame, order: Sequence[str], sha: str = "sha", title: str | None = None
) -> DataFrame:
    """First row per title, then per content hash; first seen wins."""
    if title is not None:
        df = first_per_key(df, title, order)
    return first_per_key(df, sha, order)
