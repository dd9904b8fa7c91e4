"""Line-oriented text with true line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(
    spark: SparkSession, path: str | list[str], skip_blank: bool = False, group: Column | None = None
) -> DataFrame:
    """(path, line_no, line), line_no from 1 per file, or per ``group`` with files in name order.

    Files of any size: Spark reads them in splits, lines are counted per split, and a prefix
    sum over the splits tells what each one starts at. Lines end with a line feed, with or
    without a carriage return before it; an empty end of the file is no line. With
    ``skip_blank``, lines of white space are neither returned nor counted.
    """
    where = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select(
        where["file_path"].alias("path"),
        where["file_block_start"].alias("_block"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    if skip_blank:
        raw = raw.filter(F.trim("line") != "")
    # rows of a split are numbered one by one, wherever their numbers start
    raw = raw.withColumn("_id", F.monotonically_increasing_id())
    of = F.col("path") if group is None else group
    splits = raw.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(of).orderBy("path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    rows = raw.join(starts, ["path", "_block"])
    return rows.select("path", (F.col("_id") + F.col("_start") + 1).cast("bigint").alias("line_no"), "line")
