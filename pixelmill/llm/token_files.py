"""Token ids in flat files that can be memory-mapped, and reading them back.

A data set is a folder. Each part of it, in order, has three files of little-endian numbers
without headers:

* ``part-N-*.tokens``: unsigned 16-bit ids (32-bit if the vocabulary needs it), text after text
* ``part-N-*.offsets``: unsigned 64-bit, texts + 1 values, each text's first id in its part
* ``part-N-*.ids``: signed 64-bit document ids

``manifest`` (Parquet) has a row per part with the names and the base, the number of ids in
all parts before. A text's place in the whole is its part's base plus its offset. Bases are
a prefix sum over the parts, so parts are written at the same time and never rewritten. A
task that is repeated writes other files; only those in the manifest count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.llm.encoding import encoded, kept, tokenizer
from pixelmill.session import cut_lineage

#: Stands for a null document id in the files.
NO_ID = -(1 << 63)

_PARTS = "part int, name string, width int, n_docs long, n_tokens long"


def _open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + urlparse(folder).path)


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending doc_id order.

    ``folder`` has to be reachable by all executors. Null texts are empty (only the end id);
    null ids come first; repeated ids stay apart and lie next to each other. An empty table
    gives a manifest without rows. Texts are spread by ranges of (doc_id, hash of the text),
    so no id is too frequent. Memory: one Arrow batch and the kept segments.
    """
    width = 2 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, root = _open_folder(folder)
        docs_, tokens, out = 0, 0, None
        for batch in batches:
            if out is None:
                fs.create_dir(root)
                out = [fs.open_output_stream(f"{root}/{name}.{k}") for k in ("tokens", "offsets", "ids")]
                out[1].write(np.zeros(1, dtype="<u8").tobytes())
            kept(path).trim()
            for e in encoded(batch, path):
                n = len(e.range) - 1
                ids = np.insert(e.ids, e.range[1:], end_id)
                out[0].write(ids.astype(f"<u{width}").tobytes())
                ends = tokens + e.range[1:] + np.arange(1, n + 1)
                out[1].write(ends.astype("<u8").tobytes())
                col = batch.column(0).slice(e.first, n).fill_null(NO_ID)
                out[2].write(col.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs_, tokens = docs_ + n, tokens + len(ids)
        if out is not None:
            for f in out:
                f.close()
            row = ([part], [name], [width], [docs_], [tokens])
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], _names(_PARTS))

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie")
    )
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    parts = cut_lineage(rows.mapInArrow(run, _PARTS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    parts.withColumn("base", base).write.mode("overwrite").parquet(f"{folder}/manifest")


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(",")]


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a mounted folder, else read."""
    if fs.get_file_info(path).size == 0:
        return np.empty(0, dtype=kind)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(str(PurePosixPath(path)), dtype=kind, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read_tokens(spark: SparkSession, folder: str, rows: int = 512) -> DataFrame:
    """(doc_id, start, ids) per text from the files: ids as little-endian unsigned 32-bit.

    ``start`` is the number of ids of all texts before it in the data set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_folder(folder)
        for batch in batches:
            for p in batch.to_pylist():
                at = f"{root}/{p['name']}"
                tokens = _mapped(fs, f"{at}.tokens", f"<u{p['width']}")
                offsets = _mapped(fs, f"{at}.offsets", "<u8").astype(np.int64)
                ids = np.asarray(_mapped(fs, f"{at}.ids", "<i8"))
                for a in range(0, len(ids), rows):
                    b = min(len(ids), a + rows)
                    some = [tokens[x:y].astype("<u4").tobytes() for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[a:b], pa.int64(), mask=ids[a:b] == NO_ID),
                            pa.array(p["base"] + offsets[a:b], pa.int64()),
                            pa.array(some, pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )

    parts = spark.read.parquet(f"{folder}/manifest").select("part", "name", "width", "base")
    # one part, one task: the manifest itself is small
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return parts.mapInArrow(run, "doc_id long, start long, ids binary")
