"""What is summed up where frames and clouds are: nothing is exchanged or broadcast after the pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import blobs as bl
from pixelmill.operators import cloud as cl
from pixelmill.operators import compare as cmp
from pixelmill.operators import gates
from pixelmill.plans import fixtures

VIEWS = cl.canonical_views()


@pytest.fixture(scope="module")
def frames(spark):
    ids = spark.range(3, 9).withColumnRenamed("id", "frame_id").repartition(2, "frame_id")
    return fixtures.frame_pixels(ids)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def above(df) -> str:
    """The plan down to the first visit of Python."""
    return plan(df).partition("MapInArrow")[0]


def median(v):
    return float(np.median(v)) if len(v) else None


def test_ring_contrast(frames):
    out = bl.ring_contrast_frames(frames, F.col("gt") == 2, F.col("gt") == 1, "g", 3, 1, 1)
    assert "Exchange" not in above(out)
    rows = {}
    for r in frames.collect():
        rows.setdefault(r["frame_id"], {})[r["y"], r["x"]] = r
    got = {r["frame_id"]: r for r in out.collect()}
    for f, px in rows.items():
        t = [q for q, r in px.items() if r["gt"] == 2]
        a = [q for q, r in px.items() if r["gt"] == 1]
        if not (t and a):
            assert f not in got
            continue
        near = [q for q in a if any(max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= 3 for p in t)]
        g = lambda some: median([px[q]["g"] for q in some])
        r = got[f]
        assert (r["target_px"], r["around_px"], r["ring_px"]) == (len(t), len(a), len(near))
        assert r["margin"] == abs(g(t) - g(near or a))


def test_failure_frames(frames):
    out = cmp.failure_frames(frames, F.col("gt") == 1, F.col("pred_a") == 1, (24, 32), by=["camera"])
    assert "Exchange" not in above(out)
    counts = frames.groupBy("frame_id").agg(F.count_if(F.expr("gt = 1 and pred_a = 1")).alias("tp"), F.count_if(F.expr("gt = 1 and pred_a <> 1")).alias("fn"))
    want = {r["frame_id"]: (r["tp"], r["fn"]) for r in counts.collect()}
    assert {r["frame_id"]: (r["tp"], r["fn"]) for r in out.collect()} == want


def test_matched_ab(frames):
    # NULL predictions are neither hit nor miss; the camera differs within a frame
    odd = frames.withColumns({"camera": F.when(F.col("y") < 9, "u").otherwise(F.col("camera")), "pred_a": F.when(F.col("x") != 4, F.col("pred_a"))})
    a, b, g = F.col("pred_a") == 1, F.col("pred_b") == 1, F.col("gt") == 1
    out = cmp.matched_ab(odd, g, a, b, 2.0, 5.0, 2, by=["camera"])
    assert "Exchange" not in above(out) and "Join" not in plan(out)
    want = odd.groupBy("camera", "frame_id").agg(F.count_if(~g & a).alias("n"), F.count_if(~g & a & ~b).alias("m"))
    key = lambda r: (r["camera"], r["frame_id"])
    got = {key(r): r for r in out.collect()}
    assert {k: (r["fp_a_px"], r["removed_fp_px"]) for k, r in got.items()} == {key(r): (r["n"], r["m"]) for r in want.collect()}
    tops = {r["frame_id"]: r for r in bl.top_blobs(bl.blob_runs(odd, ~g & a), 2).collect()}
    for (_, f), r in got.items():
        assert r["top_blobs_a"] == (tops[f]["top_areas"] if f in tops else [])
        assert r["n_fp_blobs_a"] == (tops[f]["blobs"] if f in tops else 0)


def test_domain_summary(frames):
    out = cmp.domain_summary(frames, F.col("gt") == 1, "camera")
    # five sums and percentiles look at what was kept, one row per frame
    assert "MapInArrow" not in plan(out)
    share = frames.groupBy("camera").agg(F.avg((F.col("gt") == 1).cast("double")).alias("m"))
    want = {r["camera"]: pytest.approx(r["m"]) for r in share.collect()}
    assert {r["camera"]: r["fg_mean"] for r in out.collect()} == want


@pytest.fixture(scope="module")
def clouds(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.range(5000).withColumnRenamed("id", "p_partkey").write.parquet(f"{sf}/part.parquet")
    return sf


def test_tasks_of_clouds(spark, clouds):
    few = fixtures.points(spark, clouds, fixtures.CLOUDS).rdd.getNumPartitions()
    assert few < fixtures.points(spark, clouds).rdd.getNumPartitions()


def test_pixels_and_points(spark, clouds):
    p = fixtures.points(spark, clouds).filter("sample_id < 3")
    z = cl.z_buffer(cl.project(p, VIEWS), (24, 32), big_scale=1.5)
    near = cl.nearest_point(cl.unproject(z, VIEWS, (24, 32)), p, 1, ["sample_id"], ["view", "y", "x", "label6"], carry=["label"])
    want = {}
    for r in near.collect():
        n, ok = want.get(r["label6"], (0, 0))
        want[r["label6"]] = n + 1, ok + (r["near_label"] + 1 == r["label6"])
    # pixels that come twice meet each with each, as in a join
    for pixels, times in ((z, 1), (z.unionAll(z), 4)):
        out = cl.label_consistency(p, pixels, VIEWS, (24, 32))
        assert "Join" not in plan(out)
        assert {r["label6"]: (r["n"], r["agree"]) for r in out.collect()} == {k: (n * times, ok * times) for k, (n, ok) in want.items()}
    out = cl.roundtrip_error(p, z, VIEWS, (24, 32))
    assert "Join" not in plan(out)
    d = {}
    for r in near.collect():
        d.setdefault((r["sample_id"], r["view"]), []).append(r["distance"])
    got = {(r["sample_id"], r["view"]): (r["mean"], r["p95"], r["max"], r["n"]) for r in out.collect()}
    assert got == {k: (pytest.approx(np.mean(v)), pytest.approx(np.percentile(v, 95)), max(v), len(v)) for k, v in d.items()}


def test_lost_points_in_one_visit(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0), (0, 3, float("nan"), 0.0, 0.0), (1, 1, None, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "sample_id int, point_id int, px double, py double, pz double")
    out = cl.nearest_point(p, p, 1, exclude_self=True)
    assert plan(out).count("MapInArrow") == 1
    got = {(r["sample_id"], r["point_id"]): (r["rank"], r["near_id"], r["distance"]) for r in out.collect()}
    assert got == {(0, 1): (1, 2, 1.0), (0, 2): (1, 1, 1.0), (0, 3): (1, None, None), (1, 1): (1, None, None)}


def test_gate_binding_broadcasts_nothing(spark, clouds, monkeypatch):
    plans = []
    monkeypatch.setattr(gates, "cut_lineage", lambda d: plans.append(plan(d)) or d)
    nodes, edges = fixtures.skeleton(spark, clouds, "part", "p_partkey")
    p = fixtures.points(spark, clouds).filter("sample_id < 9")
    gates.gate_binding(cl.bind_to_edge(p, nodes, edges), p, nodes)
    assert plans and all("Broadcast" not in x for x in plans)
