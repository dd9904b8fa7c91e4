"""Split manifests: ordered text files with one RGB/<base>.png per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.sources.text import read_lines

_BASE = r"^(?:.*/)?([^/]+?)(?:\.[A-Za-z]+)?$"
_NAME = r"^(\d+)_(\d+)_(\d+)_(.+)$"


def parse_frame_name(df: DataFrame, col: str) -> DataFrame:
    """Add base, set_id, src, anim and view. The view may hold ``_``; a bad name gives NULLs."""
    base = F.regexp_extract(F.col(col), _BASE, 1)
    df = df.withColumn("base", base)

    def part(i):
        return F.regexp_extract("base", _NAME, i)

    view = part(4)
    return df.withColumns(
        {
            "set_id": part(1).try_cast("int"),
            "src": part(2).try_cast("bigint"),
            "anim": part(3).try_cast("int"),
            "view": F.when(view != "", view),
        }
    )


def read_manifest(spark: SparkSession, path: str | list[str], dataset: str) -> DataFrame:
    """(dataset, split, line_no, base, set_id, src, anim, view).

    A split is ``<split>.txt`` or a folder ``<split>.txt/`` of ordered part files. Blank
    lines are skipped and not counted; line_no starts at 1 per split.
    """
    split = F.regexp_extract("path", r"([^/]+)\.txt(?:/[^/]*)?$", 1)
    lines = read_lines(spark, path, skip_blank=True, group=split).withColumn("split", split)
    out = parse_frame_name(lines.withColumn("_l", F.trim("line")), "_l")
    return out.select(
        F.lit(dataset).alias("dataset"),
        "split",
        "line_no",
        "base",
        "set_id",
        "src",
        "anim",
        "view",
    )


def write_manifest(df: DataFrame, path: str, splits: list[str]) -> None:
    """One ordered text output per split, ``<path>/<split>.txt``.

    Lines are range-partitioned by line_no, so small manifests become one part file and
    large ones several whose names sort in line order.
    """
    for split in splits:
        (
            df.filter(F.col("split") == split)
            .select("line_no", F.concat(F.lit("RGB/"), "base", F.lit(".png")).alias("value"))
            .repartitionByRange("line_no")
            .sortWithinPartitions("line_no")
            .select("value")
            .write.mode("overwrite")
            .text(f"{path}/{split}.txt")
        )
