"""Session set-up and lineage control."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "pixelmill", **conf) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass in your own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # checkpoint files go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives executor loss."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partition count for tables that are about to grow by an explode."""
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


_BATCH_BYTES, _NO_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1)


def batches_by_rows(spark: SparkSession, on: bool = True) -> None:
    """Cut batches for Python by their rows only. Spark measures all columns of a batch again
    after every row to keep to its limit of bytes, which takes longer than writing a short row.
    Off, for long texts, the session's own limit holds again."""
    if on:
        spark.conf.set(_BATCH_BYTES, _NO_BYTES)
    elif spark.conf.get(_BATCH_BYTES, None) == _NO_BYTES:
        spark.conf.unset(_BATCH_BYTES)


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    sc = spark.sparkContext
    if any(p.startswith("pixelmill-") for p in sc._python_includes):
        return
    top = Path(__file__).resolve().parent
    # the driver serves this file to executors as they join, so it stays until the driver ends
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = Path(folder) / f"pixelmill-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(name))
