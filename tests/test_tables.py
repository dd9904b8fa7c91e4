import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import celltree, cloud, gates, hamming, joins, losses, mix, recode, skeleton, splits


def test_banded_hamming_equals_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 14))) for b in base]

    def signed(v):
        return v - (1 << 64) if v >= 1 << 63 else v

    a = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(near)], "id bigint, hash bigint")
    b = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(base)], "id bigint, hash bigint")
    got = {r["id"]: (r["min_distance"], r["nearest_id"]) for r in joins.nearest_hamming(a, b, 10).collect()}
    for i, v in enumerate(near):
        best = min(((v ^ w).bit_count(), j) for j, w in enumerate(base))
        assert got[i] == (best if best[0] <= 10 else (None, None))


@pytest.mark.parametrize("crowd", [1024, 3])
@pytest.mark.parametrize("limit", [None, 20])
def test_nearest_hash_at_any_distance(spark, crowd, limit, monkeypatch):
    monkeypatch.setattr(hamming, "CROWD", crowd)
    monkeypatch.setattr(hamming, "BLOCK", 70)
    rng = random.Random(6)
    bad = [rng.getrandbits(64) for _ in range(90)] + [0, (1 << 64) - 1]
    # many near-equal hashes share bands; some candidates are near, most are far, some are unreadable
    bad += [0xABCD ^ (1 << i) for i in range(64)] + bad[:5]
    cand = [rng.getrandbits(64) for _ in range(150)] + bad[:10] + [b ^ 0b1011 << 7 for b in bad[60:80]] + [0xABCD] * 30

    def signed(v):
        return None if v is None else v - (1 << 64) if v >= 1 << 63 else v

    a = spark.createDataFrame([(i, signed(v)) for i, v in enumerate([*cand, None])], "id bigint, hash bigint")
    b = spark.createDataFrame([(i, signed(v)) for i, v in enumerate([*bad, None])], "id bigint, hash bigint")
    got = {r["id"]: (r["min_distance"], r["nearest_id"]) for r in hamming.nearest_hamming(a, b, limit).collect()}
    assert len(got) == len(cand) + 1 and got[len(cand)] == (None, None)
    best = [min(((v ^ w).bit_count(), j) for j, w in enumerate(bad)) for v in cand]
    for i, x in enumerate(best):
        assert got[i] == (x if limit is None or x[0] <= limit else (None, None))
    if limit is None:
        pair = hamming.closest_pair(a.filter("id < 150"), b).first()
        assert tuple(pair) == min((x[0], i, x[1]) for i, x in enumerate(best[:150]))
        assert hamming.closest_pair(a, b.filter("hash is null")).first()[0] is None
        assert gates.gate_min_hamming(a.limit(0), b).first()["passed"]


def test_leak_summary(spark):
    rows = [(0, "x", 0), (1, "a", 1), (2, None, 3), (3, "d", (1 << 13) - 1), (4, "e", None), (5, "x", None)]
    cand = spark.createDataFrame(rows, "id bigint, sha string, hash bigint")
    bad = spark.createDataFrame([(7, "x", 0), (8, "q", None)], "id bigint, sha string, hash bigint")
    v = gates.leak_verdicts(cand, bad, 2)
    got = {r["id"]: (r["verdict"], r["min_distance"], r["nearest_id"]) for r in v.collect()}
    assert got == {
        0: ("REJECT_EXACTDUP", 0, 7), 1: ("REJECT_PHASH", 1, 7), 2: ("REJECT_PHASH", 2, 7), 3: ("KEEP", 13, 7),
        4: ("REJECT_UNREADABLE", None, None), 5: ("REJECT_UNREADABLE", None, None),
    }
    s = {r["metric"]: r["value"] for r in gates.leak_summary(v, bad, 2).collect()}
    want = {"n_candidates": 6, "n_forbidden": 1, "n_reject_exactdup": 1, "n_reject_phash": 2, "n_reject_unreadable": 2, "n_kept": 1}
    assert {k: s[k] for k in want} == want
    assert [s[k] for k in ("min", "median", "max", "p5")] == [1, 2, 13, 1.1] and abs(s["mean"] - 16 / 3) < 1e-12
    assert s["at_01"] == s["at_02"] == s["at_13"] == 1 and sum(s[f"at_{k:02d}"] for k in range(21)) == 3
    none = {r["metric"]: r["value"] for r in gates.leak_summary(v.limit(0), bad, 2).collect()}
    assert none["min"] is None and none["n_kept"] == 0


def test_neighbours_equal_brute_force_with_a_hot_cell(spark):
    rng = np.random.default_rng(4)
    tight = rng.normal(0, 0.001, (60, 3))
    wide = rng.uniform(-3, 3, (40, 3))
    pts = np.concatenate([tight, wide, [[50.0, 0, 0]]])
    df = spark.createDataFrame(
        [(0, i, *map(float, p)) for i, p in enumerate(pts)],
        "sample_id bigint, point_id int, px double, py double, pz double",
    )
    out = cloud.nearest_point(df, df, 3, exclude_self=True).collect()
    got = {(r["point_id"], r["rank"]): r["near_id"] for r in out}
    for i, p in enumerate(pts):
        d = [(((p - q) ** 2).sum(), j) for j, q in enumerate(pts) if j != i]
        assert [got[(i, k)] for k in (1, 2, 3)] == [j for _, j in sorted(d)[:3]]


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_points_in_a_deep_tree(spark, k, exclude, monkeypatch):
    monkeypatch.setattr(celltree, "LEAF", 5)
    monkeypatch.setattr(celltree, "FAN", 3)
    rng = np.random.default_rng(8)
    tight = rng.normal(5, 1e-6, (150, 3))
    wide = rng.uniform(-3, 3, (120, 3))
    same = np.tile([[1.0, 2.0, 3.0]], (20, 1))
    grid = rng.integers(0, 3, (60, 3)).astype(float)
    pts = np.concatenate([tight, wide, same, grid, [[1e9, 0, 0]], [[0, -1e9, 5]]])
    rows = [(s, i, *map(float, p)) for s in (0, 1) for i, p in enumerate(pts) if s == 0 or i % 40 == 0]
    odd = [(0, 900, float("nan"), 0.0, 0.0), (0, 901, None, 1.0, 1.0), (1, 902, float("-inf"), 0.0, 0.0), (7, 903, 0.0, float("nan"), 0.0)]
    df = spark.createDataFrame(rows + odd, "sample_id bigint, point_id int, px double, py double, pz double").repartition(3)
    b = df.filter("point_id % 3 > 0").withColumn("label", F.col("point_id") % 7)
    got = {}
    for r in cloud.nearest_point(df, b, k, carry=["label"], exclude_self=exclude).collect():
        got.setdefault((r["sample_id"], r["point_id"]), []).append((r["rank"], r["distance"], r["near_id"], r["near_label"]))
    for s, i, *p in odd:
        assert got.pop((s, i)) == [(1, None, None, None)]
    for s, i, *p in rows:
        d = [(float(((np.array(p) - q[2:]) ** 2).sum()), q[1]) for q in rows if q[0] == s and q[1] % 3 and not (exclude and q[1] == i)]
        want = [(n + 1, j, j % 7) for n, (_, j) in enumerate(sorted(d)[:k])]
        some = sorted(got[(s, i)])
        assert [(x[0], x[2], x[3]) for x in some] == want
        assert np.allclose([x[1] for x in some], [x**0.5 for x, _ in sorted(d)[:k]])


def test_a_crowd_and_an_outlier_take_few_rounds(spark):
    """A million points in one small place and one at 1e9; each finds its copy."""
    n = 1_000_000
    u = [F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1 << 30)) / float(1 << 30) for j in range(3)]
    far = F.when(F.col("id") == 0, 1e9).otherwise(0.0)
    b = spark.range(n).select(F.lit(0).alias("sample_id"), F.col("id").alias("point_id"), (u[0] * 1e-3 + far).alias("px"), (u[1] * 1e-3).alias("py"), (u[2] * 1e-3).alias("pz"))
    a = b.filter("point_id % 50 = 0 or point_id = 7").withColumn("px", F.when(F.col("point_id") == 7, float("nan")).otherwise(F.col("px")))
    t = time.time()
    r = cloud.nearest_point(a, b).agg(F.count_if(F.col("near_id") == F.col("point_id")).alias("same"), F.count_if(F.col("near_id").isNull()).alias("none")).first()
    assert (r["same"], r["none"]) == (n // 50, 1) and time.time() - t < 240


def brute_dbscan(pts, eps, least):
    near = {i: [j for j, q in pts.items() if sum((a - b) ** 2 for a, b in zip(p, q)) <= eps * eps] for i, p in pts.items()}
    core = {i for i in pts if len(near[i]) >= least}
    out, seen = {}, {}
    for i in sorted(core):
        todo = [i]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen[c] = i
                todo += [j for j in near[c] if j in core]
    for i in pts:
        out[i] = seen[i] if i in core else min((seen[j] for j in near[i] if j in core), default=-1)
    return out


@pytest.mark.parametrize("least", [1, 3, 8])
def test_dbscan_equals_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(celltree, "LEAF", 4)
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(0, 0.02, (90, 3)), rng.uniform(-1, 1, (150, 3)), np.tile([[3.0, 3.0, 3.0]], (9, 1)), [[0.1 * i, 5, 5] for i in range(12)]])
    rows = [(s, i % 2, i, *map(float, p)) for s in (0, 1) for i, p in enumerate(pts) if s == 0 or i > 200]
    odd = [(0, 1, 900, float("nan"), 0.0, 0.0), (0, 1, 901, None, 0.0, 0.0), (0, 2, 902, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "sample_id bigint, label int, point_id bigint, px double, py double, pz double")
    eps = {0: 0.2, 1: 0.35}
    got = {(r["sample_id"], r["label"], r["point_id"]): r["cluster"] for r in cloud.dbscan(df, eps, least).collect()}
    want = {(s, c, i): -1 for s, c, i, *_ in odd}
    for s in (0, 1):
        for c, e in eps.items():
            some = {i: p for t, d, i, *p in rows if (t, d) == (s, c)}
            want |= {(s, c, i): x for i, x in brute_dbscan(some, e, least).items()}
    assert got == want


def test_dbscan_of_a_crowd(spark):
    """A million points within one eps, and a chain that leads to them."""
    n = 1_000_000
    u = [F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1 << 30)) / float(1 << 30) for j in range(3)]
    chain = F.col("id") < 5
    px = F.when(chain, F.col("id") * 0.9 - 4.1).otherwise(u[0] * 0.5)
    df = spark.range(n).select(F.lit(0).alias("sample_id"), F.lit(0).alias("label"), F.col("id").alias("point_id"), px.alias("px"), F.when(chain, 0.0).otherwise(u[1] * 0.5).alias("py"), F.when(chain, 0.0).otherwise(u[2] * 0.5).alias("pz"))
    t = time.time()
    r = cloud.dbscan(df, 1.0, 3).groupBy("cluster").count().collect()
    # the first of the chain has too few neighbours and hangs on to the second
    assert [tuple(x) for x in r] == [(1, n)] and time.time() - t < 300


def test_points_far_from_segments(spark):
    rng = np.random.default_rng(5)
    nodes = [(s, i, *map(float, p)) for s in (0, 1) for i, p in enumerate(rng.uniform(-2, 2, (90, 3)))] + [(0, 90, 1e6, 0.0, 0.0), (0, 91, float("nan"), 0.0, 0.0)]
    edges = [(s, i, i + 1) for s in (0, 1) for i in range(89)] + [(0, 0, 90), (0, 1, 91)]
    pts = [(s, i, *map(float, p)) for s in (0, 1) for i, p in enumerate(rng.uniform(-3, 3, (60, 3)))] + [(0, 60, -1e7, 4.0, 4.0)]
    odd = [(0, 70, float("nan"), 0.0, 0.0), (1, 71, None, 0.0, 0.0)]
    n = spark.createDataFrame(nodes, "sample_id bigint, node_id int, nx double, ny double, nz double")
    e = spark.createDataFrame(edges, "sample_id bigint, a int, b int")
    p = spark.createDataFrame(pts + odd, "sample_id bigint, point_id int, px double, py double, pz double")
    got = {(r["sample_id"], r["point_id"]): r for r in cloud.bind_to_edge(p, n, e).collect()}
    assert all(got.pop((s, i))["distance"] is None for s, i, *_ in odd) and len(got) == len(pts)
    at = {(s, i): np.array(x) for s, i, *x in nodes}
    for s, i, *x in pts:
        best = []
        for t, a, b in edges:
            if t == s and b != 91:
                v, d = np.array(x) - at[s, a], at[s, b] - at[s, a]
                best.append((np.linalg.norm(v - np.clip(v @ d / max(d @ d, 1e-12), 0, 1) * d), a, b))
        assert got[s, i]["distance"] == pytest.approx(min(best)[0]) and (got[s, i]["a"], got[s, i]["b"]) == min(best)[1:]


def test_segments_and_bfs_of_a_small_tree(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 4, 5)], "sample_id bigint, a int, b int")
    rows = skeleton.segments(edges).orderBy("seg_start", "seg_next", "pos").collect()
    chains = {}
    for r in rows:
        chains.setdefault((r["seg_start"], r["seg_next"]), []).append(r["node_id"])
    assert sorted(chains.values()) == [[0, 1, 2], [2, 3], [2, 4, 5]]
    roots = spark.createDataFrame([(1, 2)], "sample_id bigint, root int")
    depth = {r["node_id"]: (r["parent"], r["depth"]) for r in skeleton.bfs_parents(edges, roots).collect()}
    assert depth == {2: (None, 0), 1: (2, 1), 3: (2, 1), 4: (2, 1), 0: (1, 2), 5: (4, 2)}


def test_dbscan_noise_and_border(spark):
    xs = [0.0, 0.1, 0.2, 0.3, 5.0, 9.0, 9.1]
    df = spark.createDataFrame(
        [(0, 1, i, x, 0.0, 0.0) for i, x in enumerate(xs)],
        "sample_id bigint, label int, point_id int, px double, py double, pz double",
    )
    got = {r["point_id"]: r["cluster"] for r in cloud.dbscan(df, 0.15, 3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: -1, 5: -1, 6: -1}


def test_split_holds_out_whole_groups(spark):
    df = spark.range(1000).select((F.col("id") % 20).alias("set_id"), "id")
    out = splits.split_by_group(df, "set_id", 0.15, 1)
    assert out.groupBy("set_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.filter("split = 'val'").select("set_id").distinct().count() == 3
    one = df.filter("set_id = 4")
    assert splits.split_by_group(one, "set_id", 0.5, 1, none_if_single=True).filter("split = 'val'").count() == 0


def test_evenly_spaced_matches_truncated_linspace(spark):
    df = spark.range(23).select(F.lit("a").alias("g"), "id")
    got = sorted(r["id"] for r in recode.evenly_spaced(df, ["g"], ["id"], 6).collect())
    assert got == [j * 22 // 5 for j in range(6)]


def test_failed_gate_raises(spark):
    df = spark.createDataFrame([(0,), (9,)], "label int")
    rows = gates.run_gates([gates.gate_label_values(df, [0, 1, 9]), gates.gate_label_values(df, [0, 1])])
    assert sorted(r["passed"] for r in rows.collect()) == [False, True]
    with pytest.raises(gates.GateError, match="label_values"):
        gates.assert_gates(rows)


def test_licence_filter(spark):
    names = ["CC0", "cc by-nc 4.0", "CC BY 4.0", "cc-by-nd", None, "Public Domain", "CC BY-SA 3.0"]
    df = spark.createDataFrame([(n,) for n in names], "licence string")
    assert [r[0] for r in recode.licence_filter(df).collect()] == ["CC0", "CC BY 4.0", "Public Domain", "CC BY-SA 3.0"]


def test_oversample_never_gives_fewer_copies_than_asked(spark):
    man = spark.createDataFrame([(1, "1_a", 0, "train"), (2, "2_a", 1, "val")], "set_id int, base string, line_no int, split string")
    with pytest.raises(ValueError):
        mix.oversample(man, 5, 100)


@pytest.mark.parametrize("bounded", [False, True])
def test_lovasz_hinge(spark, bounded):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(6):
        z, t = np.round(rng.normal(0, 2, 40), 1), (rng.random(40) < (0, 0.3, 1, 0.5, 0.5, 0.5)[g]).astype(int)
        skip = rng.random(40) < (0, 0, 0, 0.3, 1.1, 0)[g]
        rows += [(g, float(a), 255 if s else int(b)) for a, b, s in zip(z, t, skip)]
        z, t = z[~skip], t[~skip]
        err = 1 - z * (2 * t - 1)
        order = np.argsort(-err, kind="stable")
        e, f = err[order], t[order]
        jac = 1 - (f.sum() - np.cumsum(f)) / (f.sum() + np.cumsum(1 - f)) if len(f) else np.zeros(0)
        want[g] = float(np.maximum(e, 0) @ np.diff(np.r_[0, jac])) if len(f) else 0.0
    df = spark.createDataFrame(rows, "g int, logit double, gt int")
    got = {r["g"]: r["hinge"] for r in losses.lovasz_hinge(df, ["g"], bounded_groups=bounded).collect()}
    assert got == pytest.approx(want)
