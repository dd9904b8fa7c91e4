"""Whole-frame morphology and blobs against definitions, with odd frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import raster


def brute_morph(pix, op, k, kernel):
    widths = raster.half_widths(kernel, k)
    for grow in raster.STEPS[op]:
        pick = max if grow else min
        pix = {(y, x): pick(pix[q] for dy, w in widths.items() for dx in range(-w, w + 1) if (q := (y + dy, x + dx)) in pix) for y, x in pix}
    return pix


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(2)
    out = {}
    for f, (h, w) in enumerate([(1, 1), (1, 9), (7, 1), (8, 13), (8, 13), (20, 5), (6, 6)]):
        out[f] = {(y + f, x - 3): int(rng.random() < (0.35 if f != 6 else 1.0)) for y in range(h) for x in range(w)}
    for q in list(out[4])[::7]:
        del out[4][q]
    return out


@pytest.fixture(scope="module")
def px(spark, frames):
    rows = [(f, y, x, v, "kept") for f, pix in frames.items() for (y, x), v in pix.items()]
    return spark.createDataFrame(rows, "frame_id bigint, y int, x int, v int, note string").repartition(5)


@pytest.mark.parametrize("k", [0, 1, 2, 5])
def test_morphology(px, frames, k):
    jobs = [raster.Morph(F.col("v") == 1, op, k, kernel, f"{op}_{kernel}") for op in raster.STEPS for kernel in ("square", "ellipse")]
    out = raster.morphs(px, jobs)
    assert out.columns[:5] == px.columns
    rows = out.collect()
    for f, pix in frames.items():
        mine = [r for r in rows if r["frame_id"] == f]
        assert len(mine) == len(pix)
        for j in jobs:
            want = brute_morph(pix, j.op, k, j.kernel)
            assert {(r["y"], r["x"]): r[j.out] for r in mine} == want


@pytest.mark.parametrize("connectivity", [4, 8])
def test_blobs(px, frames, connectivity):
    got = raster.connected_components(px, F.col("v") == 1, connectivity).collect()
    runs = raster.blob_runs(px, F.col("v") == 1, connectivity).collect()
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 8 or not (dy and dx))]
    for f, pix in frames.items():
        on = sorted(q for q, v in pix.items() if v)
        want = {}
        for q in on:
            todo = [q]
            while todo:
                c = todo.pop()
                if c not in want:
                    want[c] = q[0] * 65536 + q[1]
                    todo += [n for dy, dx in near if (n := (c[0] + dy, c[1] + dx)) in pix and pix[n]]
        assert {(r["y"], r["x"]): r["blob"] for r in got if r["frame_id"] == f} == want
        assert {(r["line"], x): r["blob"] for r in runs if r["frame_id"] == f for x in range(r["start"], r["stop"] + 1)} == want
    assert raster.connected_components(px.limit(0), F.col("v") == 1).count() == 0


def test_a_spiral_is_one_blob():
    n = 201
    grid = np.zeros((n, n), dtype=bool)
    y, x, dy, dx, step = n // 2, n // 2, 0, 1, 2
    grid[y, x] = True
    while 0 <= y + dy * step < n and 0 <= x + dx * step < n:
        for _ in range(step):
            y, x = y + dy, x + dx
            grid[y, x] = True
        dy, dx, step = dx, -dy, step + (2 if dy else 0)
    yy, xx = np.nonzero(grid)
    first, last, root = raster.frame_blobs(yy, xx, np.array([0]), 0)
    assert len(set(root.tolist())) == 1 and len(first) > 300


def traced(on):
    """The outer border of one 8-connected set of pixels, walked clockwise; its length."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    start = min(on)
    if len(on) == 1:
        return 0.0
    at, came, length, first = start, 4, 0.0, None
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            to = (at[0] + ring[d][0], at[1] + ring[d][1])
            if to in on:
                break
        if (at, d) == first:
            return length
        first = first or (at, d)
        length += 2**0.5 if d % 2 else 1.0
        at, came = to, (d + 4) % 8


def test_contours_and_rectangles(spark):
    rng = np.random.default_rng(7)
    grids = [(rng.random((9, 11)) < p).astype(int) for p in (0.2, 0.4, 0.5, 0.6, 0.8)] * 3
    nest = np.zeros((11, 11), dtype=int)
    nest[0:11, 0] = nest[0:11, 10] = nest[0, :] = nest[10, :] = 1
    nest[2:9, 2] = nest[2:9, 8] = nest[2, 2:9] = nest[8, 2:9] = 1
    nest[5, 5] = 1
    grids += [nest, np.eye(8, dtype=int), np.ones((4, 7), dtype=int)]
    rows = [(f, y, x, int(v)) for f, g in enumerate(grids) for (y, x), v in np.ndenumerate(g)]
    px = spark.createDataFrame(rows, "frame_id bigint, y int, x int, v int")
    got = {(r["frame_id"], r["blob"]): r for r in raster.outlines(px, F.col("v") == 1).collect()}
    blobs = {}
    for r in raster.connected_components(px, F.col("v") == 1).collect():
        blobs.setdefault((r["frame_id"], r["blob"]), set()).add((r["y"], r["x"]))
    assert set(got) == set(blobs)
    for key, on in blobs.items():
        r = got[key]
        assert r["area"] == len(on) and r["contour"] == pytest.approx(traced(on))
        best = (0.0, 0.0, 0.0)
        pts = sorted(on)
        for i, (y0, x0) in enumerate(pts):
            for y1, x1 in pts[i + 1 :]:
                dy, dx = y1 - y0, x1 - x0
                u, v = ([a * dx + b * dy for b, a in on], [b * dx - a * dy for b, a in on])
                a, b, n = max(u) - min(u), max(v) - min(v), dx * dx + dy * dy
                some = (a * b / n, -max(a, b) / n**0.5, min(a, b) / n**0.5)
                best = some if best == (0.0, 0.0, 0.0) or some < best else best
        assert (r["rect_long"], r["rect_short"]) == pytest.approx((-best[1], best[2]))
