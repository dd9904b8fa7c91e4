"""File inventory, per-frame CSVs, reports and staged pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_FRAME = "frame_idx bigint, dlo_coverage_pct double, dlo_pixels bigint"
_PLACE = r"([^/]+)/(\d+)/([^/]+)/([^/]+)\.[A-Za-z0-9]+$"


def parse_inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """(split, set_id, channel, base) from .../<split>/<set>/<channel>/<base>.<ext>; other
    paths are dropped."""
    def part(i):
        return F.regexp_extract(path, _PLACE, i)

    return paths.filter(F.col(path).rlike(_PLACE)).select(
        part(1).alias("split"),
        part(2).cast("int").alias("set_id"),
        part(3).alias("channel"),
        part(4).alias("base"),
    )


def inventory(spark: SparkSession, root_glob: str) -> DataFrame:
    """File listing; only paths are selected, so no file content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root_glob)
    return parse_inventory(files.select("path"))


def read_per_frame(spark: SparkSession, paths: str | list[str], schema: str = PER_FRAME) -> DataFrame:
    """Per-frame coverage CSVs of many runs; ``run`` is the folder of the file."""
    d = spark.read.schema(schema).csv(paths, header=True)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return d.select(F.url_decode(run).alias("run"), "*")


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result rows as csv (with header), json or parquet."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.csv(path, header=True)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt}")


def write_pixels(df: DataFrame, path: str, frame: str = "frame_id") -> None:
    """Stage pixel rows by split and set, clustered by frame.

    Only the partitions present in ``df`` are replaced, so an interrupted run goes on
    with the sets that are missing. ``rebalance`` lets adaptive execution size the files
    and split a set that holds much of the data.
    """
    (
        df.hint("rebalance", "split", "set_id")
        .sortWithinPartitions("split", "set_id", frame, "y", "x")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("split", "set_id")
        .parquet(path)
    )


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
