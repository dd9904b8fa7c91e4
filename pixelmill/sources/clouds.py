"""Point clouds (.npy) and skeletons (.npz) through the binary file source."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = r"(\d+)/[^/]*/(?:pcl|seg)_(\d+)\.npy$"


def _load(content) -> np.ndarray | None:
    try:
        return np.load(io.BytesIO(bytes(content)), allow_pickle=False)
    except (ValueError, OSError, EOFError):
        return None


def decode_points(files: DataFrame) -> DataFrame:
    """(set_id, sample_id, point_id, px, py, pz) from (set_id, sample_id, content).

    A file that is not an (N, 3) array gives one row with point_id -1.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, n, content in zip(batch.set_id, batch.sample_id, batch.content):
                a = _load(content)
                if a is None or a.ndim != 2 or a.shape[1] != 3:
                    a, ids = np.full((1, 3), np.nan), [-1]
                else:
                    ids = np.arange(len(a))
                a = a.astype("float64")
                yield pd.DataFrame(
                    {"set_id": s, "sample_id": n, "point_id": ids, "px": a[:, 0], "py": a[:, 1], "pz": a[:, 2]}
                )

    return files.select("set_id", "sample_id", "content").mapInPandas(
        decode, "set_id int, sample_id bigint, point_id int, px double, py double, pz double"
    )


def decode_labels(files: DataFrame) -> DataFrame:
    """(set_id, sample_id, point_id, label); point_id -1 for a bad file."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, n, content in zip(batch.set_id, batch.sample_id, batch.content):
                a = _load(content)
                if a is None or a.ndim != 1:
                    a, ids = np.array([-1]), [-1]
                else:
                    ids = np.arange(len(a))
                yield pd.DataFrame(
                    {"set_id": s, "sample_id": n, "point_id": ids, "label": a.astype("int32")}
                )

    return files.select("set_id", "sample_id", "content").mapInPandas(
        decode, "set_id int, sample_id bigint, point_id int, label int"
    )


def _pairs(clouds: DataFrame, labels: DataFrame) -> DataFrame:
    """(set_id, sample_id, content, _seg): the files of samples that have both."""
    keys = ["set_id", "sample_id"]
    seg = labels.select(*keys, F.col("content").alias("_seg"))
    return clouds.select(*keys, "content").join(seg, keys)


def _both(content, seg) -> tuple[np.ndarray, np.ndarray] | None:
    """Points and labels of a sample; None for a bad file or different lengths."""
    a, q = _load(content), _load(seg)
    fine = a is not None and q is not None and a.ndim == 2 and a.shape[1] == 3 and q.ndim == 1
    return (a, q) if fine and len(a) == len(q) else None


def labelled_points(clouds: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, skipped): clouds with their labels; ``skipped`` counts the samples
    dropped for a bad file or different lengths, as one row.

    The two files of a sample meet before they are read, so each is read once and points are
    neither joined nor grouped. A file's points go out together, many small files in one batch.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for s, n, content, seg in zip(batch.set_id, batch.sample_id, batch.content, batch._seg):
                both = _both(content, seg)
                if both is None:
                    continue
                held.append((s, n, *both))
                size += len(both[0])
                if size >= _ROWS:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    def faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = sum(_both(content, seg) is None for content, seg in zip(batch.content, batch._seg))
            yield pd.DataFrame({"n": [n]})

    points = _pairs(clouds, labels).mapInPandas(
        decode, "set_id int, sample_id bigint, point_id int, px double, py double, pz double, label int"
    )
    bad = _pairs(clouds, labels).select("content", "_seg").mapInPandas(faults, "n bigint")
    return points, bad.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("skipped"))


#: Points that go out together.
_ROWS = 1 << 16


def _rows(held: list) -> pd.DataFrame:
    size = np.array([len(a) for _, _, a, _ in held])
    xyz = np.concatenate([a.astype("float64") for _, _, a, _ in held])
    return pd.DataFrame(
        {
            "set_id": np.repeat([s for s, *_ in held], size),
            "sample_id": np.repeat([n for _, n, *_ in held], size),
            "point_id": np.arange(len(xyz)) - np.repeat(np.cumsum(size) - size, size),
            "px": xyz[:, 0], "py": xyz[:, 1], "pz": xyz[:, 2],
            "label": np.concatenate([q.astype("int32") for *_, q in held]),
        }
    )


def _binary(spark: SparkSession, glob: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(glob)
    return files.select(
        F.regexp_extract("path", pattern, 1).try_cast("int").alias("set_id"),
        F.regexp_extract("path", pattern, 2).try_cast("bigint").alias("sample_id"),
        "content",
    ).filter(F.col("set_id").isNotNull())


def read_point_clouds(spark: SparkSession, cloud_glob: str, label_glob: str):
    """Labelled points of ``<set>/<any>/pcl_NNNN.npy`` and ``seg_NNNN.npy`` files."""
    return labelled_points(_binary(spark, cloud_glob, _ID), _binary(spark, label_glob, _ID))


def decode_skeletons(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from (set_id, sample_id, content) of .npz files with nodes and adj."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, n, content in zip(batch.set_id, batch.sample_id, batch.content):
                a = np.load(io.BytesIO(bytes(content)))["nodes"].astype("float64")
                yield pd.DataFrame(
                    {"set_id": s, "sample_id": n, "node_id": np.arange(len(a)), "nx": a[:, 0], "ny": a[:, 1], "nz": a[:, 2]}
                )

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, n, content in zip(batch.set_id, batch.sample_id, batch.content):
                a, b = np.nonzero(np.triu(np.load(io.BytesIO(bytes(content)))["adj"], 1))
                yield pd.DataFrame({"set_id": s, "sample_id": n, "a": a, "b": b})

    src = files.select("set_id", "sample_id", "content")
    return (
        src.mapInPandas(nodes, "set_id int, sample_id bigint, node_id int, nx double, ny double, nz double"),
        src.mapInPandas(edges, "set_id int, sample_id bigint, a int, b int"),
    )


def read_skeletons(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and upper-triangle edges of ``<set>/skeletons/NNN.npz`` files."""
    return decode_skeletons(_binary(spark, glob, r"(\d+)/[^/]*/(\d+)\.npz$"))
