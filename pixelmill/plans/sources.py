"""Queries of sources, sinks and streams.

Sinks are exercised by writing rows derived from the tables into a fresh scratch
folder and reading them back.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pixelmill.operators import metrics as m
from pixelmill.operators import splits as sp
from pixelmill.plans.digest import digest, digest_sql
from pixelmill.plans.fixtures import (
    MAN,
    PIX,
    PTS,
    SKEL,
    frame_pixels,
    manifest,
    pixels,
    points,
    skeleton,
    table,
)
from pixelmill.plans.registry import query, r6
from pixelmill.session import scratch_dir
from pixelmill.sources import clouds, manifests, metadata, tables
from pixelmill.streaming import monitors as mo

SPLIT = "CASE WHEN set_id <= 31 THEN 'train' WHEN set_id <= 35 THEN 'val' ELSE 'test' END"


@query(
    "S1, S2, S10",
    f"""WITH {MAN}, s AS (SELECT *, {SPLIT} AS split FROM man)
    SELECT 'all' AS dataset, split, row_number() OVER (PARTITION BY split ORDER BY src) AS line_no, base, set_id, src, anim, view FROM s""",
)
def manifest_roundtrip(spark, sf):
    path = scratch_dir(spark, "manifest")
    man = sp.split_by_range(manifest(spark, sf))
    manifests.write_manifest(man, path, ["train", "val", "test"])
    return manifests.read_manifest(spark, f"{path}/*.txt", "all")


@query(
    "S2",
    f"""WITH {MAN} SELECT base, set_id, src, anim, view FROM man
    UNION ALL SELECT 'bad-' || base, NULL, NULL, NULL, NULL FROM man WHERE src % 3 = 0""",
)
def parse_frame_name(spark, sf):
    man = manifest(spark, sf).select("base", "src")
    names = man.select(F.concat(F.lit("RGB/"), "base", F.lit(".png")).alias("line"))
    bad = man.filter(F.col("src") % 3 == 0).select(
        F.concat(F.lit("RGB/bad-"), "base", F.lit(".png")).alias("line")
    )
    return manifests.parse_frame_name(names.unionByName(bad), "line").drop("line")


def _metadata(spark, sf):
    """One metadata document per dataset, written as files and read back."""
    man = sp.split_by_range(manifest(spark, sf))
    sets = man.groupBy("dataset", "split", "set_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    key = F.lpad(F.col("set_id").cast("string"), 3, "0")
    per = sets.groupBy("dataset", "split").agg(
        F.collect_list(key).alias("s"),
        F.collect_list(F.struct(key.alias("k"), F.col("n").alias("v"))).alias("f"),
    )
    doc = per.groupBy("dataset").agg(
        F.map_from_entries(F.collect_list(F.struct("split", "s"))).alias("splits"),
        F.map_from_entries(F.flatten(F.collect_list("f"))).alias("source_frames_per_set"),
    )
    lang = F.col("dataset")
    views = (
        F.when(lang == "en", F.lit('{"view_slot_names": ["a", "b"], "x": 1}'))
        .when(lang == "de", F.lit('{"front": {"look": [0, 0, -1]}, "top": {}}'))
        .otherwise(F.lit("{}"))
    )
    mode = F.when(lang == "fr", "phase9").otherwise("other")
    text = F.concat(
        F.lit('{"name": "'), lang, F.lit('", "dataset_mode": "'), mode, F.lit('", "views": '), views,
        F.lit(', "splits": '), F.to_json("splits"),
        F.lit(', "source_frames_per_set": '), F.to_json("source_frames_per_set"), F.lit("}"),
    )
    path = scratch_dir(spark, "metadata")
    doc.select("dataset", text.alias("value")).repartition("dataset").write.partitionBy("dataset").text(path)
    parts = metadata.read_run_metadata(spark, f"{path}/dataset=*/*.txt")
    name = F.regexp_extract("path", r"dataset=([^/]+)/", 1)
    return {k: d.withColumn("dataset", name).drop("path") for k, d in parts.items()}


@query(
    "S3",
    f"""WITH {MAN}, s AS (SELECT dataset, {SPLIT} AS split, set_id, count(*) AS n FROM man GROUP BY ALL)
    SELECT dataset, split, set_id, CAST(n AS INTEGER) AS frames FROM s""",
)
def run_metadata_splits(spark, sf):
    meta = _metadata(spark, sf)
    return meta["splits"].join(meta["frames_per_set"], ["dataset", "set_id"])


@query(
    "S3",
    """WITH d AS (SELECT DISTINCT lang AS dataset FROM documents), v AS (SELECT dataset, unnest(CASE dataset WHEN 'en' THEN ['a', 'b'] WHEN 'de' THEN ['front', 'top']
      WHEN 'fr' THEN ['view0', 'view1', 'view2', 'view3', 'view4', 'view5'] ELSE ['front', 'back', 'left', 'right', 'top', 'bottom'] END) AS view,
      unnest(CASE WHEN dataset IN ('en', 'de') THEN range(2) ELSE range(6) END) AS p FROM d) SELECT dataset, view, CAST(p AS INTEGER) AS position FROM v""",
)
def run_metadata_views(spark, sf):
    return _metadata(spark, sf)["views"]


@query(
    "S4",
    """SELECT p_name || p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE p_type END AS category,
      CASE WHEN p_partkey % 4 = 0 THEN 0.2::DOUBLE ELSE p_size/100.0::DOUBLE END AS scale_lo, CASE WHEN p_partkey % 4 = 0 THEN 0.4::DOUBLE ELSE p_size/50.0::DOUBLE END AS scale_hi,
      CASE WHEN p_partkey % 5 <> 0 THEN round(p_size/sqrt(p_size*p_size + 9.0), 6) END AS ax, p_partkey % 2 = 1 AS graspable_on_wire FROM part""",
)
def object_manifest(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    obj = F.struct(
        F.concat("p_name", k.cast("string")).alias("slug"),
        F.lit("x.npz").alias("file"),
        F.when(k % 3 != 0, F.col("p_type")).alias("category"),
        F.when(k % 4 != 0, F.array(size / 100.0, size / 50.0)).alias("natural_scale_range"),
        F.when(k % 5 != 0, F.array(size, F.lit(3.0), F.lit(0.0))).alias("grasp_axis_local"),
        F.when(k % 2 == 1, F.lit(True)).alias("graspable_on_wire"),
    )
    path = scratch_dir(spark, "objects")
    docs = p.groupBy(F.floor(k / 10).alias("doc")).agg(F.collect_list(obj).alias("objects"))
    docs.select(F.to_json(F.struct("objects")).alias("value")).write.text(path)
    o = metadata.read_object_manifest(spark, path, multi_line=False)
    return o.select(
        "slug", "category", "scale_lo", "scale_hi",
        r6(F.col("grasp_axis")[0]).alias("ax"), "graspable_on_wire",
    )


def _encode_clouds(df):
    """(set_id, sample_id, content, seg): .npy bytes per cloud, as two files would hold them."""

    def npy(a) -> bytes:
        buf = io.BytesIO()
        np.save(buf, a)
        return buf.getvalue()

    def encode(batches):
        for batch in batches:
            out = []
            for s, n, *axes, label in zip(batch.set_id, batch.sample_id, batch.px, batch.py, batch.pz, batch.label):
                a = np.stack(axes[: 2 if n % 17 == 3 else 3], axis=1).astype("float32")
                out.append((s, n, npy(a), npy(np.asarray(label, dtype="int8"))))
            yield pd.DataFrame(out, columns=["set_id", "sample_id", "content", "seg"])

    cols = ["px", "py", "pz", "label"]
    # a file holds its whole cloud
    per = df.groupBy("set_id", "sample_id").agg(F.array_sort(F.collect_list(F.struct("point_id", *cols))).alias("p"))
    per = per.select("set_id", "sample_id", *[F.col(f"p.{c}").alias(c) for c in cols])
    return per.mapInPandas(encode, "set_id int, sample_id bigint, content binary, seg binary")


def _cloud_files(spark, sf):
    enc = _encode_clouds(points(spark, sf))
    keys = ["set_id", "sample_id"]
    return enc.select(*keys, "content"), enc.select(*keys, F.col("seg").alias("content"))


@query(
    "S5",
    f"""WITH {PTS} SELECT sample_id, count(*) AS n, CAST(sum((mx + 2*my + 3*mz)*(point_id + 1)) AS BIGINT) AS place, CAST(sum(label*(point_id + 1)) AS BIGINT) AS labels
    FROM pts WHERE sample_id % 17 <> 3 GROUP BY sample_id""",
)
def read_point_clouds(spark, sf):
    pts, _ = clouds.labelled_points(*_cloud_files(spark, sf))
    k = F.col("point_id") + 1
    milli = sum(
        ((i + 1) * F.round(F.col(a) * 1000).cast("bigint") for i, a in enumerate(("px", "py", "pz"))),
        F.lit(0).cast("bigint"),
    )
    return pts.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(milli * k).alias("place"),
        F.sum(F.col("label") * k).alias("labels"),
    )


@query("S5", "SELECT count(*) FILTER (p_partkey % 17 = 3) AS skipped FROM part")
def skipped_point_clouds(spark, sf):
    return clouds.labelled_points(*_cloud_files(spark, sf))[1]


@query(
    "S6",
    f"""WITH {SKEL} SELECT e.sample_id, CAST(e.a AS INTEGER) AS a, CAST(e.b AS INTEGER) AS b, round(n.nx, 3) AS nx, round(n.ny, 3) AS ny
    FROM skel_edges e JOIN skel_nodes n ON n.sample_id = e.sample_id AND n.node_id = e.a""",
)
def read_skeletons(spark, sf):
    nodes, edges = skeleton(spark, sf)

    def encode(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("node_id")
        adj = np.zeros((len(left), len(left)), dtype=np.int8)
        adj[right.a, right.b] = adj[right.b, right.a] = 1
        buf = io.BytesIO()
        np.savez(buf, nodes=left[["nx", "ny", "nz"]].to_numpy("float32"), adj=adj)
        return pd.DataFrame(
            [(0, left.sample_id.iloc[0], buf.getvalue())], columns=["set_id", "sample_id", "content"]
        )

    files = nodes.groupBy("sample_id").cogroup(edges.groupBy("sample_id")).applyInPandas(
        encode, "set_id int, sample_id bigint, content binary"
    )
    n, e = clouds.decode_skeletons(files)
    at = n.select("sample_id", F.col("node_id").alias("a"), F.round("nx", 3).alias("nx"), F.round("ny", 3).alias("ny"))
    return e.join(at, ["sample_id", "a"]).select("sample_id", "a", "b", "nx", "ny")


@query(
    "S8, S11",
    f"""WITH {PIX} SELECT 'cam=' || camera AS run, frame_id AS frame_idx, round(100.0*count(*) FILTER (pred_a > 0)/count(*), 6) AS dlo_coverage_pct, count(*) FILTER (pred_a > 0) AS dlo_pixels
    FROM pix GROUP BY camera, frame_id""",
)
def per_frame_reports(spark, sf):
    cov = m.coverage(pixels(spark, sf), F.col("pred_a") > 0, "frame_id", ["camera"])
    rows = cov.select(
        "camera",
        F.col("frame_id").alias("frame_idx"),
        r6(F.col("pct")).alias("dlo_coverage_pct"),
        F.col("fg_px").alias("dlo_pixels"),
    ).persist()
    path = scratch_dir(spark, "reports")
    for cam in ("c1", "c2", "c3", "c4"):
        tables.write_report(rows.filter(F.col("camera") == cam).drop("camera"), f"{path}/cam={cam}", "csv")
    rows.unpersist()
    return tables.read_per_frame(spark, f"{path}/*/*.csv")


@query(
    "S9",
    f"""WITH {MAN} SELECT {SPLIT} AS split, set_id, CASE WHEN src % 2 = 0 THEN 'rgb' ELSE 'label' END AS channel, count(*) AS files, min(base) AS first_base FROM man GROUP BY ALL""",
)
def inventory(spark, sf):
    man = sp.split_by_range(manifest(spark, sf))
    ch = F.when(F.col("src") % 2 == 0, "rgb").otherwise("label")
    path = F.format_string("file:/data/%s/%03d/%s/%s.png", "split", "set_id", ch, "base")
    junk = man.select(F.concat(F.lit("file:/data/"), "base", F.lit(".txt")).alias("path"))
    inv = tables.parse_inventory(man.select(path.alias("path")).unionByName(junk))
    return inv.groupBy("split", "set_id", "channel").agg(
        F.count(F.lit(1)).alias("files"), F.min("base").alias("first_base")
    )


@query(
    "S12",
    f"""WITH {PIX}, s AS (SELECT CASE WHEN set_id = 34 THEN 'val' ELSE 'train' END AS split, set_id, y, x, CASE WHEN set_id = 33 THEN gt + 1 ELSE gt END AS gt, depth_mm FROM pix) """
    + digest_sql("s", "split, set_id", ["gt", "depth_mm"]),
)
def staged_pixels(spark, sf):
    px = pixels(spark, sf).select("frame_id", "set_id", "y", "x", "gt", "depth_mm")
    px = px.withColumn("split", F.when(F.col("set_id") == 34, "val").otherwise("train"))
    path = scratch_dir(spark, "pixels")
    tables.write_pixels(px, path)
    # staging one set again replaces that set only
    again = px.filter(F.col("set_id") == 33).withColumn("gt", F.col("gt") + 1)
    tables.write_pixels(again, path)
    return digest(tables.read_pixels(spark, path), ["split", "set_id"], ["gt", "depth_mm"])


# ---- streams


def _stream(spark, sf, name):
    src = table(spark, sf, name)
    return (
        spark.readStream.schema(src.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    )


@query(
    "T1",
    """SELECT DISTINCT event_type AS arm, user_id AS step FROM events WHERE user_id % 6 = 0 OR user_id >= 26""",
)
def stream_new_evals(spark, sf):
    ev = _stream(spark, sf, "events").select(
        F.col("event_type").alias("arm"), F.col("user_id").alias("step"), F.col("ts").cast("timestamp").alias("ts")
    )
    path = scratch_dir(spark, "evals")
    # the table spans less than that, so that every repeat falls within
    mo.run_available(mo.new_evals(ev, ts="ts", within="1000 days").select("arm", "step"), f"{path}/checkpoint", f"{path}/out")
    return spark.read.schema("arm string, step bigint").parquet(f"{path}/out")


@query(
    "T2",
    """WITH s AS (SELECT DISTINCT event_type AS arm, ts FROM events), g AS (SELECT arm, lag(ts) OVER (PARTITION BY arm ORDER BY ts) AS a, ts AS b FROM s)
    SELECT arm, CAST(epoch_us(a) AS BIGINT) AS last_seen_us, CAST(epoch_us(b) AS BIGINT) AS resumed_us FROM g WHERE b - a > INTERVAL 900 SECOND""",
)
def stream_stall_alerts(spark, sf):
    ev = _stream(spark, sf, "events").select(
        F.col("event_type").alias("arm"), F.col("ts").cast("timestamp").alias("ts")
    )
    path = scratch_dir(spark, "stalls")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mo.ROCKSDB)
    mo.run_available(mo.stall_detector(ev, 900, live=False), f"{path}/checkpoint", f"{path}/out")
    out = spark.read.schema("arm string, last_seen timestamp, resumed timestamp").parquet(f"{path}/out")
    return out.select(
        "arm",
        F.unix_micros("last_seen").alias("last_seen_us"),
        F.unix_micros("resumed").alias("resumed_us"),
    )


@query("T3", f"WITH {PIX} SELECT gt, pred_a AS pred, count(*) AS n FROM pix GROUP BY ALL")
def stream_running_confusion(spark, sf):
    ids = _stream(spark, sf, "part").select(F.col("p_partkey").alias("frame_id"))
    path = scratch_dir(spark, "confusion")
    live = mo.running_confusion(frame_pixels(ids), pred="pred_a")
    mo.run_available(live, f"{path}/checkpoint", mode="update", each=mo.batch_writer(f"{path}/out"))
    return mo.latest_per_key(spark.read.parquet(f"{path}/out"), ["gt", "pred"], "n")


@query(
    "T4",
    f"""WITH {PIX} SELECT frame_id, count(*) FILTER (pred_a > 0) AS fg_px, round(100.0*count(*) FILTER (pred_a > 0)/count(*), 6) AS pct FROM pix GROUP BY frame_id""",
)
def stream_frame_coverage(spark, sf):
    ids = _stream(spark, sf, "part").select(F.col("p_partkey").alias("frame_id"))
    path = scratch_dir(spark, "coverage")
    each = mo.frame_coverage_writer(f"{path}/out", lambda: F.col("pred_a") > 0)
    mo.run_available(frame_pixels(ids), f"{path}/checkpoint", each=each)
    out = spark.read.parquet(f"{path}/out")
    return out.select("frame_id", "fg_px", r6(F.col("pct")).alias("pct"))
