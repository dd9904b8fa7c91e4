import json

import numpy as np

from pixelmill.sources import clouds, logs, manifests, metadata, tables


def test_manifest_lines_and_bad_names(spark, tmp_path):
    (tmp_path / "train.txt").write_text("RGB/032_0000_00_front.png\n\nRGB/001_0002_03_view_1.png\nRGB/oops.png\n")
    rows = manifests.read_manifest(spark, str(tmp_path / "*.txt"), "d").orderBy("line_no").collect()
    assert [(r["split"], r["line_no"], r["set_id"], r["src"], r["anim"], r["view"]) for r in rows] == [
        ("train", 1, 32, 0, 0, "front"),
        ("train", 2, 1, 2, 3, "view_1"),
        ("train", 3, None, None, None, None),
    ]


def test_point_cloud_files(spark, tmp_path):
    for s, n in ((3, 4), (5, 4)):
        (tmp_path / f"{s:03d}" / "pc").mkdir(parents=True)
        np.save(tmp_path / f"{s:03d}" / "pc" / "pcl_0007.npy", np.arange(n * 3, dtype="float32").reshape(n, 3))
        np.save(tmp_path / f"{s:03d}" / "pc" / "seg_0007.npy", np.arange(n if s == 3 else n - 1))
    pts, skipped = clouds.read_point_clouds(
        spark, str(tmp_path / "*/pc/pcl_*.npy"), str(tmp_path / "*/pc/seg_*.npy")
    )
    rows = pts.orderBy("point_id").collect()
    assert [(r["set_id"], r["sample_id"], r["px"], r["label"]) for r in rows] == [(3, 7, 3.0 * i, i) for i in range(4)]
    assert skipped.first()["skipped"] == 1


def test_skeleton_files(spark, tmp_path):
    (tmp_path / "002" / "skeletons").mkdir(parents=True)
    adj = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]])
    np.savez(tmp_path / "002" / "skeletons" / "004.npz", nodes=np.eye(3), adj=adj)
    nodes, edges = clouds.read_skeletons(spark, str(tmp_path / "*/skeletons/*.npz"))
    assert nodes.count() == 3
    assert sorted((r["set_id"], r["sample_id"], r["a"], r["b"]) for r in edges.collect()) == [(2, 4, 0, 1), (2, 4, 1, 2)]


def test_logs_and_metadata_and_inventory(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("val: mIoU=0.5 IoU(wire)=0.6 IoU(bg)=0.9 IoU(con)=0.1\nnoise\nep 3 batch 1/2 loss=0.25\n")
    evals, losses = logs.read_eval_log(spark, str(log), "a")
    assert tuple(evals.select("arm", "idx", "wire", "con").first()) == ("a", 0, 0.6, 0.1)
    assert tuple(losses.first()) == ("a", 3, 0.25)
    doc = tmp_path / "metadata.json"
    doc.write_text(json.dumps({"splits": {"train": ["000", "001"]}, "views": {}, "source_frames_per_set": {"000": 7}}, indent=1))
    meta = metadata.read_run_metadata(spark, str(doc))
    assert sorted(r["set_id"] for r in meta["splits"].collect()) == [0, 1]
    assert meta["views"].count() == 6
    (tmp_path / "ds" / "train" / "004" / "rgb").mkdir(parents=True)
    (tmp_path / "ds" / "train" / "004" / "rgb" / "0001_00_front.png").write_bytes(b"x")
    inv = tables.inventory(spark, str(tmp_path / "ds"))
    assert tuple(inv.first()) == ("train", 4, "rgb", "0001_00_front")


def test_line_numbers_of_files_read_in_splits(spark, tmp_path):
    from pixelmill.sources.text import read_lines

    lines = [f"line {i} " + "x" * (i * 37 % 90) if i % 11 else " " * (i % 2) for i in range(700)]
    (tmp_path / "train.txt").mkdir()
    for part, some in (("part-0", lines[:500]), ("part-1", lines[500:])):
        (tmp_path / "train.txt" / part).write_text("\r\n".join(some) + "\n" * (part == "part-0"))
    (tmp_path / "val.txt").write_text("\n".join(lines[:9]))
    old = [spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_lines(spark, str(tmp_path / "train.txt"))
        assert spark.read.text(str(tmp_path / "train.txt")).rdd.getNumPartitions() >= 8
        got = {(r["path"][-6:], r["line_no"]): r["line"] for r in df.collect()}
        want = {("part-0", i + 1): x for i, x in enumerate(lines[:500])} | {("part-1", i + 1): x for i, x in enumerate(lines[500:])}
        assert got == want
        rows = manifests.read_manifest(spark, str(tmp_path / "*.txt"), "d").collect()
        full = [x for x in lines if x.strip()]
        assert {r["line_no"]: r["base"] for r in rows if r["split"] == "train"} == {i + 1: x.strip() for i, x in enumerate(full)}
        assert sorted(r["line_no"] for r in rows if r["split"] == "val") == list(range(1, 9))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
