import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pixelmill.operators import blobs, distance, geometry, metrics, recode, windows


def test_morph_literals(frame, grid):
    df = frame(["00000", "01000", "00000", "00011", "00011"])
    m = F.col("v") == 1
    assert grid(windows.morph(df, m, "dilate", 1), "morph") == ["11100", "11100", "11111", "00111", "00111"]
    assert grid(windows.morph(df, m, "erode", 1), "morph") == ["00000"] * 4 + ["00001"]
    cross = windows.morph(df, m, "dilate", 1, "ellipse")
    assert grid(cross, "morph") == ["01000", "11100", "01011", "00111", "00111"]


def test_erode_mask_dilate_are_nested(frame):
    df = frame(["0110", "1110", "0110", "0001"], ["1111", "1111", "1111", "1111"])
    d = windows.morph(df, F.col("v") == 1, "dilate", 1, out="d")
    d = windows.morph(d, F.col("v") == 1, "erode", 1, out="e")
    assert d.filter("NOT (d >= v AND v >= e)").count() == 0


def test_box_reflects_at_the_border(frame):
    df = frame(["123", "456", "789"])
    d = windows.box_sums(df, {"s": F.col("v")}, 3, (3, 3))
    got = {(r["y"], r["x"]): r["s"] for r in d.collect()}
    a = np.pad(np.arange(1, 10).reshape(3, 3), 1, mode="symmetric")
    for y in range(3):
        for x in range(3):
            assert got[(y, x)] == a[y : y + 3, x : x + 3].sum()


@pytest.mark.parametrize("radius", [None, 4, 12])
def test_distance_is_exact_at_any_radius(frame, radius):
    rng = np.random.default_rng(1)
    grids = [["".join("1" if v < p else "0" for v in row) for row in rng.random((9, 11))] for p in (0.04, 0.2, 0.0)]
    df = frame(*grids)
    out = distance.mask_nearest(df, F.col("v") == 1, radius, at=("ny", "nx")).collect()
    assert len(out) == 3 * 99
    for r in out:
        seeds = [(y, x) for y, line in enumerate(grids[r["frame_id"]]) for x, c in enumerate(line) if c == "1"]
        best = min((((y - r["y"]) ** 2 + (x - r["x"]) ** 2, y, x) for y, x in seeds), default=None)
        if best is None or (radius and best[0] > radius * radius):
            assert r["dist"] is None
        else:
            assert r["dist"] == pytest.approx(best[0] ** 0.5) and (r["ny"], r["nx"]) == best[1:]


def test_width_of_a_large_square(spark):
    n = spark.range(110 * 110).select(
        F.lit(None).cast("bigint").alias("frame_id"), F.expr("int(id div 110)").alias("y"), F.expr("int(id % 110)").alias("x")
    )
    inside = F.col("y").between(10, 99) & F.col("x").between(10, 99)
    out = blobs.local_width(n, inside).collect()
    assert [(r["y"], r["x"], r["width"]) for r in sorted(out)] == [
        (y, x, 90.0) for y in (54, 55) for x in (54, 55)
    ]


def test_frames_of_many_sizes_and_batches(spark):
    rng = np.random.default_rng(3)
    rows = []
    for f, (h, w) in enumerate([(3, 4), (40, 30), (3, 4), (1, 1), (25, 50), (10, 10), (2, 200)] * 3):
        rows += [(f"f{f}", y + 5, x - 2, float(rng.random()), int(rng.random() < 0.05)) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "frame string, y int, x int, v double, s int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    out = distance.value_of_nearest(df, F.col("s") == 1, ["v"], frame="frame").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows)
    seeds = {}
    for f, y, x, v, s in rows:
        if s:
            seeds.setdefault(f, []).append((y, x, v))
    for r in out:
        best = min((((y - r["y"]) ** 2 + (x - r["x"]) ** 2, y, x, v) for y, x, v in seeds.get(r["frame"], [])), default=None)
        assert (r["dist"], r["v_near"]) == ((None, None) if best is None else (best[0] ** 0.5, best[3]))


def test_components_ids_do_not_depend_on_partitions(spark, frame):
    g = ["1010001", "1010101", "1111101", "0000000", "1100011"]
    df = frame(g)
    out = {}
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for c in (4, 8):
            rows = blobs.connected_components(df, F.col("v") == 1, c).collect()
            out[parts, c] = {(r["y"], r["x"]): r["blob"] for r in rows}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out["1", 8] == out["8", 8] and out["1", 4] == out["8", 4]
    assert len(set(out["8", 8].values())) == 4
    assert out["8", 8][(1, 4)] == 0


def test_diagonal_contact_joins_only_with_eight_neighbours(frame):
    df = frame(["10", "01"])
    n = [blobs.blob_runs(df, F.col("v") == 1, c).select("blob").distinct().count() for c in (4, 8)]
    assert n == [2, 1]


def test_empty_mask_has_no_blobs(frame):
    assert blobs.blob_runs(frame(["00", "00"]), F.col("v") == 1).count() == 0


def test_top_blobs_keeps_the_largest(frame):
    df = frame(["1011101", "0000000", "1100000"])
    r = blobs.top_blobs(blobs.blob_runs(df, F.col("v") == 1), 2).first()
    assert (r["top_areas"], r["blobs"], r["px"]) == ([3, 2], 4, 7)


def test_nearest_resize_and_flip(frame, grid):
    df = frame(["12", "34"])
    assert grid(geometry.resize_nearest(df, (2, 2), (4, 4)), "v") == ["1122", "1122", "3344", "3344"]
    assert grid(geometry.resize_nearest(frame(["1234"]), (1, 4), (1, 2)), "v") == ["13"]
    assert grid(geometry.hflip(df, 2), "v") == ["21", "43"]


def test_recode_fails_on_an_unknown_label(frame):
    ok = recode.recode_labels(frame(["012345"]), col="v")
    assert [r["label3"] for r in ok.orderBy("x").collect()] == [0, 1, 1, 1, 2, 0]
    with pytest.raises(PySparkException, match="unexpected label 7"):
        recode.recode_labels(frame(["07"]), col="v").collect()


def test_iou_is_symmetric_and_empty_modes(spark):
    rows = [(0, 0)] * 5 + [(1, 1)] * 3 + [(1, 0)] * 2
    df = spark.createDataFrame(rows, "gt int, pred int")
    a = {r["cls"]: r["iou"] for r in metrics.class_metrics(metrics.confusion(df)).collect()}
    b = {r["cls"]: r["iou"] for r in metrics.class_metrics(metrics.confusion(df, gt="pred", pred="gt")).collect()}
    assert a == b == {0: 5 / 7, 1: 3 / 5, 2: 0.0}
    for mode, want in (("null", None), ("one", 1.0)):
        got = metrics.class_metrics(metrics.confusion(df), empty=mode).filter("cls = 2").first()
        assert got["iou"] == want
