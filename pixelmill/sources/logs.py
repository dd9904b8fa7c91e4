"""Training logs: two kinds of lines become two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.ordered import row_index
from pixelmill.sources.text import read_lines

# The two line formats.
VAL_LINE = (
    r"val:\s*mIoU=([0-9.]+)\s+IoU\(wire\)=([0-9.]+)\s+IoU\(bg\)=([0-9.]+)\s+IoU\(con\)=([0-9.]+)"
)
LOSS_LINE = r"ep\s+(\d+)\s+batch.*loss=([0-9.]+)"


def eval_rows(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(arm, idx, miou, wire, bg, con) from (arm, order, line); idx counts per arm."""
    hits = lines.filter(F.col("line").rlike(VAL_LINE))
    parsed = hits.select(
        "arm",
        order,
        *[
            F.regexp_extract("line", VAL_LINE, i).cast("double").alias(n)
            for i, n in enumerate(("miou", "wire", "bg", "con"), 1)
        ],
    )
    return row_index(parsed, ["arm"], [order], "idx").drop(order)


def loss_rows(lines: DataFrame) -> DataFrame:
    """(arm, epoch, loss)."""
    return lines.filter(F.col("line").rlike(LOSS_LINE)).select(
        "arm",
        F.regexp_extract("line", LOSS_LINE, 1).cast("bigint").alias("epoch"),
        F.regexp_extract("line", LOSS_LINE, 2).cast("double").alias("loss"),
    )


def read_eval_log(spark: SparkSession, path: str, arm: str) -> tuple[DataFrame, DataFrame]:
    """Evaluations and losses of one run's log file(s)."""
    lines = read_lines(spark, path).select(
        F.lit(arm).alias("arm"), "line_no", F.col("line")
    )
    return eval_rows(lines), loss_rows(lines)


def read_run_logs(spark: SparkSession, path: str, folder: str = r"([^/=]+)/[^/]+$") -> DataFrame:
    """(arm, line_no, line) of many runs; the arm is the name of a log's folder.

    Part files of one run count on in name order, so a log of any size may be in many files.
    """
    arm = F.url_decode(F.regexp_extract("path", folder, 1))
    return read_lines(spark, path, group=arm).select(arm.alias("arm"), "line_no", "line")
