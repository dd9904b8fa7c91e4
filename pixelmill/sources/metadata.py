"""Run metadata and object manifests (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# View names when the metadata does not list any.
DEFAULT_VIEWS = ["front", "back", "left", "right", "top", "bottom"]
SLOT_VIEWS = ["view0", "view1", "view2", "view3", "view4", "view5"]

_DOC = "splits map<string,array<string>>, source_frames_per_set map<string,int>, dataset_mode string"

OBJECT_SCHEMA = (
    "objects array<struct<slug:string,file:string,category:string,license:string,"
    "n_points:int,natural_scale_range:array<double>,grasp_axis_local:array<double>,"
    "graspable_on_wire:boolean,pose_family:string>>"
)


def run_metadata(docs: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """``splits`` (path, split, set_id), ``views`` (path, position, view) and
    ``frames_per_set`` (path, set_id, frames) from JSON text in a column.

    View names: the slot-name list, else the keys of the views map, else the default of
    the dataset mode.
    """
    d = docs.select(
        "path",
        F.from_json(value, _DOC).alias("m"),
        F.from_json(
            F.get_json_object(value, "$.views.view_slot_names"), "array<string>"
        ).alias("slots"),
        F.map_keys(
            F.from_json(F.get_json_object(value, "$.views"), "map<string,string>")
        ).alias("keys"),
    )

    def some(c):
        return F.when(F.size(c) > 0, F.col(c))

    default = F.when(
        F.col("m.dataset_mode") == "phase9", F.array(*[F.lit(v) for v in SLOT_VIEWS])
    ).otherwise(F.array(*[F.lit(v) for v in DEFAULT_VIEWS]))
    views = F.coalesce(some("slots"), some("keys"), default)
    split_rows = d.select("path", F.explode("m.splits").alias("split", "_s"))
    return {
        "splits": split_rows.select("path", "split", F.explode("_s").alias("_v")).select(
            "path", "split", F.col("_v").try_cast("int").alias("set_id")
        ),
        "views": d.select("path", F.posexplode(views).alias("position", "view")),
        "frames_per_set": d.select(
            "path", F.explode("m.source_frames_per_set").alias("_k", "frames")
        ).select("path", F.col("_k").try_cast("int").alias("set_id"), "frames"),
    }


def read_run_metadata(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    docs = spark.read.text(path, wholetext=True)
    return run_metadata(docs.select(F.col("_metadata.file_path").alias("path"), "value"))


def object_rows(manifests: DataFrame) -> DataFrame:
    """One row per object of manifests holding ``objects``; defaults filled in.

    Scale range defaults to 0.20..0.40, category to ``unknown``; the grasp axis is
    normalised, and NULL unless it is a non-zero 3-vector.
    """
    o = manifests.select(F.inline("objects"))
    two = F.size("natural_scale_range") == 2
    axis = F.col("grasp_axis_local")
    norm = F.sqrt(F.aggregate(axis, F.lit(0.0), lambda acc, v: acc + v * v))
    good = (F.size(axis) == 3) & (norm > 1e-9)
    return o.select(
        "slug",
        "file",
        F.coalesce("category", F.lit("unknown")).alias("category"),
        "license",
        "n_points",
        F.when(two, F.col("natural_scale_range")[0]).otherwise(0.20).alias("scale_lo"),
        F.when(two, F.col("natural_scale_range")[1]).otherwise(0.40).alias("scale_hi"),
        F.when(good, F.transform(axis, lambda v: v / norm)).alias("grasp_axis"),
        F.coalesce("graspable_on_wire", F.lit(False)).alias("graspable_on_wire"),
        "pose_family",
    )


def read_object_manifest(spark: SparkSession, path: str | list[str], multi_line: bool = True):
    return object_rows(spark.read.schema(OBJECT_SCHEMA).json(path, multiLine=multi_line))
