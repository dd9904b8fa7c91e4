"""64-bit perceptual hash of pixel frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.geometry import resize_area, resize_nearest


def _basis(i: Column, k: int, n: int) -> Column:
    """cos(pi / n * (i + 0.5) * k) looked up in a literal table of n rows."""
    row = F.array(*[F.lit(math.cos(math.pi / n * (j + 0.5) * k)) for j in range(n)])
    return row[i]


def phash_bits(
    df: DataFrame, grey: Column, size: tuple[int, int], frame: str = "frame_id", n: int = 32, keep: int = 8
) -> DataFrame:
    """(frame, hash): signs of the low DCT corner against its median, first bit highest.

    The frame is brought to n x n (area average when shrinking, nearest when growing),
    then transformed one axis at a time; each step is a grouped sum.
    """
    src = df.select(frame, "y", "x", grey.cast("double").alias("_g"))
    if size[0] >= n and size[1] >= n:
        small = resize_area(src, size, (n, n), "_g", [frame])
    else:
        small = resize_nearest(src, size, (n, n))
    rows = small.groupBy(frame, "y").agg(
        *[F.sum(F.col("_g") * _basis(F.col("x"), k, n)).alias(f"_r{k}") for k in range(keep)]
    )
    cells = [
        F.sum(F.col(f"_r{kx}") * _basis(F.col("y"), ky, n)) for ky in range(keep) for kx in range(keep)
    ]
    low = rows.groupBy(frame).agg(F.array(*cells).alias("_c"))
    s = F.array_sort("_c")
    half = keep * keep // 2
    low = low.withColumn("_m", (s[half - 1] + s[half]) / 2)
    bits = F.transform(F.col("_c"), lambda v: F.when(v > F.col("_m"), 1).otherwise(0).cast("bigint"))
    packed = F.aggregate(
        bits, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit)
    )
    return low.select(frame, packed.alias("hash"))
