"""Clouds and frames that fit a task are worked on whole: results by brute force, no pair lists."""

import itertools
import math
import random

from pixelmill.operators import cloud


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd(seed, clouds, n):
    """Points of several clouds: a crowd, some equal ones, an outlier and one without a place."""
    rnd, rows = random.Random(seed), []
    for c in range(clouds):
        for i in range(n):
            at = [rnd.uniform(-1, 1) for _ in range(3)] if i % 3 else [0.25, 0.5, rnd.choice((0.0, 0.3))]
            rows.append((c, i, i % 3, *at))
        rows += [(c, n, 0, 1e9, 1e9, 1e9), (c, n + 1, 0, float("nan"), 0.0, 0.0)]
    return rows


POINTS = "sample_id bigint, point_id int, label int, px double, py double, pz double"


def test_within_radius_lists_no_pairs(spark):
    rows = crowd(1, 3, 40)
    p = spark.createDataFrame(rows, POINTS)
    for k in (None, 4):
        want = set()
        for a in rows:
            near = [b[1] for b in rows if b[0] == a[0] and sum((x - y) ** 2 for x, y in zip(a[3:], b[3:])) <= 0.25]
            want |= {(a[0], a[1], b) for b in sorted(near)[:k]}
        out = cloud.within_radius(p, p, 0.5, k)
        assert {(r["sample_id"], r["point_id"], r["near_id"]) for r in out.collect()} == want
        assert "Join" not in plan(out)


def test_cross_view_error_lists_no_pairs(spark):
    rnd = random.Random(2)
    rows = [(s, v, y, x, rnd.randint(900, 1100)) for s in range(2) for v in ("front", "back") for y in range(24) for x in range(32) if rnd.random() < 0.4]
    px = spark.createDataFrame(rows, "sample_id bigint, view string, y int, x int, depth_mm int")
    views = cloud.canonical_views()
    world = cloud.unproject(px, views, (24, 32)).collect()
    want = {}
    for s in range(2):
        sides = [[[r[a] for a in cloud.AXES] for r in world if r["sample_id"] == s and r["view"] == v] for v in ("front", "back")]
        best = [min(math.dist(a, b) for b in sides[1]) for a in sides[0]]
        best = [d for d in best if d < 0.1]
        want[s] = (len(best), sum(best) / len(best))
    out = cloud.cross_view_error(px, views, [("front", "back")], (24, 32), 0.1)
    got = {r["sample_id"]: r for r in out.collect()}
    assert set(got) == set(want)
    for s, (n, mean) in want.items():
        assert got[s]["matches"] == n and abs(got[s]["mean_error"] - mean) < 1e-12
    assert "Join" not in plan(out)


def test_z_buffer_keeps_its_minimum_in_place(spark):
    rows = [(0, None, 7, 0.0, 0.0, 0.0), (0, 5, 2, 0.0, 0.0, 0.0), (0, -3, None, 0.0, 0.0, 0.0), (1, 2**31 - 1, 4, 0.1, 0.1, 0.5), (1, -(2**31), 0, 0.1, 0.1, 0.6)]
    p = spark.createDataFrame(rows, POINTS)
    out = cloud.z_buffer(cloud.project(p, {"front": cloud.canonical_views()["front"]}), (24, 32), radius=0)
    got = {r["sample_id"]: (r["point_id"], r["label6"]) for r in out.collect()}
    # no id comes first, as in any order of Spark
    assert got == {0: (None, 0), 1: (-(2**31), 1)}
    assert "SortAggregate" not in plan(out)


def test_boxes_and_ranges_sort_a_frame_once(spark):
    from pyspark.sql import functions as F

    from pixelmill.operators import compare, windows

    rnd = random.Random(3)
    v = {(f, y, x): rnd.choice((None, 0.0, 1.5, 7.0)) for f in range(2) for y in range(6) for x in range(9) if rnd.random() < 0.9}
    px = spark.createDataFrame([(*k, c) for k, c in v.items()], "frame_id bigint, y int, x int, v double")
    near = {
        k: [v[n] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (n := (k[0], k[1] + dy, k[2] + dx)) in v and v[n] is not None] for k in v
    }
    ranges = windows.local_range(px, F.col("v"), 3)
    sums = windows.box_sums(px, {"s": F.col("v"), "n": F.lit(1)}, 3, (6, 9), "clip")
    for r in ranges.collect():
        some = near[r["frame_id"], r["y"], r["x"]]
        assert r["range"] == (max(some) - min(some) if some else None)
    for r in sums.collect():
        some = near[r["frame_id"], r["y"], r["x"]]
        assert r["s"] == (sum(some) if some else None)
    sharp = compare.new_sharp_edges(px, F.col("v"), F.col("v") * 2, F.col("x") > 2)
    for out in (ranges, sums, sharp):
        first = plan(out).split("Initial Plan")[0]
        assert first.count(" Sort [") <= 1 and "Join" not in first


def test_both_files_of_a_sample_are_read_once(spark):
    import io

    import numpy as np

    from pixelmill.sources import clouds

    def npy(a):
        buf = io.BytesIO()
        np.save(buf, a)
        return buf.getvalue()

    xyz = np.arange(12.0).reshape(4, 3)
    pcl = [(1, 1, npy(xyz)), (1, 2, npy(xyz[:, :2])), (1, 3, npy(xyz)), (1, 4, b"no array"), (2, 5, npy(xyz)), (2, 6, npy(xyz))]
    seg = [(1, i, npy(np.arange(3 if i == 3 else 4, dtype="int8"))) for i in (1, 2, 3, 4)] + [(2, 5, npy(np.arange(4)))]
    kind = "set_id int, sample_id bigint, content binary"
    points, skipped = clouds.labelled_points(spark.createDataFrame(pcl, kind), spark.createDataFrame(seg, kind))
    got = sorted((r["sample_id"], r["point_id"], r["px"], r["label"]) for r in points.collect())
    assert got == [(s, i, 3.0 * i, i) for s in (1, 5) for i in range(4)]
    assert skipped.collect()[0]["skipped"] == 3
    assert plan(points).split("Initial Plan")[0].count("MapInPandas") == 1


def test_bind_to_edge_meets_in_one_visit(spark):
    rnd = random.Random(5)
    nodes = [(c, i, *(rnd.uniform(-1, 1) for _ in range(3))) for c in range(3) for i in range(6)] + [(0, 9, float("nan"), 0.0, 0.0)]
    edges = [(c, i, i + 1) for c in range(2) for i in range(5)] + [(0, 5, 9), (1, 3, 77)]
    rows = crowd(6, 3, 20)
    at = {(c, i): xyz for c, i, *xyz in nodes}
    want = {}
    for c, i, _, *q in rows:
        if q[0] != q[0]:
            want[c, i] = (None, None)
            continue
        best = []
        for s, a, b in edges:
            if s == c and (s, b) in at and b != 9:
                ev, pv = [y - x for x, y in zip(at[s, a], at[s, b])], [y - x for x, y in zip(at[s, a], q)]
                t = max(0.0, min(1.0, sum(x * y for x, y in zip(pv, ev)) / max(sum(x * x for x in ev), 1e-12)))
                best.append((sum((x - t * y) ** 2 for x, y in zip(pv, ev)), a, b))
        if best:
            want[c, i] = min(best)[1:]
    n = spark.createDataFrame(nodes, "sample_id bigint, node_id int, nx double, ny double, nz double")
    out = cloud.bind_to_edge(spark.createDataFrame(rows, POINTS), n, spark.createDataFrame(edges, "sample_id bigint, a int, b int"))
    assert {(r["sample_id"], r["point_id"]): (r["a"], r["b"]) for r in out.collect()} == want
    assert "Join" not in plan(out) and "checkpoint" not in plan(out).lower()


def test_dbscan_of_small_clouds_makes_no_rounds(spark):
    rows = crowd(7, 3, 45)
    eps = {0: 0.3, 1: 0.45}
    want = {}
    for c, label in itertools.product(range(3), range(3)):
        own = {r[1]: r[3:] for r in rows if r[0] == c and r[2] == label}
        near = {i: [j for j in own if label in eps and math.dist(own[i], own[j]) <= eps[label]] for i in own}
        core = {i for i in own if len(near[i]) >= 3}
        root = {i: i for i in core}
        for _ in core:
            for i in core:
                root[i] = min(root[j] for j in near[i] if j in core)
        for i in own:
            want[c, i] = root[i] if i in core else min((root[j] for j in near[i] if j in core), default=-1)
    out = cloud.dbscan(spark.createDataFrame(rows, POINTS), eps, 3)
    assert {(r["sample_id"], r["point_id"]): r["cluster"] for r in out.collect()} == want
    assert "Join" not in plan(out)


def test_a_task_makes_few_frames(spark):
    from pixelmill.plans import fixtures

    assert fixtures._tasks(spark, spark.range(5000)) >= 10
