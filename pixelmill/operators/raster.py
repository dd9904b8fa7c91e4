"""Morphology and blobs of whole frames, worked on as arrays.

A frame is one image, so its size is bounded. Spark brings frames together once; each task
then takes as many whole frames as an Arrow batch holds, and any number of masks in the same
pass. Blobs come from row runs: overlapping runs of neighbouring rows are united in rounds
that halve the paths to the first run, for all frames of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.operators.distance import Pass, _whole_frames, by_size, places, together

_ROW = 65536

#: What each operation does in turn: True grows, False shrinks.
STEPS = {"dilate": [True], "erode": [False], "open": [False, True], "close": [True, False]}


class Morph(NamedTuple):
    """A mask, what is done to it with a (2k+1) kernel, and the column for it."""

    mask: Column
    op: str
    k: int = 1
    kernel: str = "square"
    out: str = "morph"


def half_widths(kernel: str, k: int) -> dict[int, int]:
    """Half width of the structuring element in each row offset."""
    if kernel == "square":
        return {dy: k for dy in range(-k, k + 1)}
    if kernel == "ellipse":
        return {dy: round(math.sqrt(k * k - dy * dy)) for dy in range(-k, k + 1)}
    raise ValueError(f"unknown kernel {kernel}")


def _window_any(grid: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Whether any cell within k along the axis is set; windows double until they are wide enough."""
    if not k:
        return grid
    pad = [(0, 0)] * grid.ndim
    pad[axis] = (k, k)
    x = np.moveaxis(np.pad(grid, pad), axis, -1)
    n, size, cover = grid.shape[axis], 2 * k + 1, 1
    while 2 * cover <= size:
        x = x[..., :-cover] | x[..., cover:]
        cover *= 2
    rest = size - cover
    x = x[..., :n] | x[..., rest : rest + n]
    return np.moveaxis(x, -1, axis)


def _grown(grid: np.ndarray, kernel: str, k: int) -> np.ndarray:
    widths = half_widths(kernel, k)
    if kernel == "square":
        return _window_any(_window_any(grid, k, 2), k, 1)
    rows = {w: _window_any(grid, w, 2) for w in set(widths.values())}
    out = np.zeros_like(grid)
    h = grid.shape[1]
    for dy, w in widths.items():
        if abs(dy) < h:
            out[:, max(0, -dy) : h - max(0, dy)] |= rows[w][:, max(0, dy) : h - max(0, -dy)]
    return out


def morphed(grid: np.ndarray, present: np.ndarray, op: str, k: int, kernel: str) -> np.ndarray:
    """One operation on (frame, y, x) of booleans; cells that aren't present are ignored."""
    for grow in STEPS[op]:
        grid = _grown(grid & present, kernel, k) if grow else ~_grown(~grid & present, kernel, k)
    return grid


def morph_step(mask: str, op: str, k: int, kernel: str, out: str) -> tuple[Callable, T.StructField]:
    """One operation as a step of a pass; ``mask`` is 1, 0 or -1 for not there."""

    def run(rows, starts):
        import pyarrow as pa

        y, x = places(rows)
        given, values = rows.column(mask).to_numpy(), np.zeros(rows.num_rows, dtype=np.int32)
        for at, f, yy, xx, shape in by_size(y, x, starts):
            grid, present = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
            grid[f, yy, xx] = given[at] == 1
            present[f, yy, xx] = given[at] >= 0
            values[at] = morphed(grid, present, op, k, kernel)[f, yy, xx]
        return rows.append_column(out, pa.array(values, pa.int32()))

    return run, T.StructField(out, T.IntegerType())


def morphs(df: DataFrame, jobs: Sequence[Morph], frame: str = "frame_id") -> DataFrame:
    """All operations in one pass over whole frames, each 0/1 in its column.

    Pixels outside the frame, and those whose mask is NULL, are ignored.
    """
    p = Pass(df, frame)
    for i, j in enumerate(jobs):
        p.step(*morph_step(p.mask(j.mask, f"_mask{i}"), j.op, j.k, j.kernel, j.out))
    return p.run()


def _numbers(rows, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are there) of a column; 0 where there is none."""
    import pyarrow.compute as pc

    column = rows.column(name)
    there = pc.is_valid(column).to_numpy(zero_copy_only=False) if column.null_count else np.ones(len(column), dtype=bool)
    return np.where(there, column.to_numpy(zero_copy_only=False).astype(np.float64), 0.0), there


def _either(v: np.ndarray, ok: np.ndarray, axis: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The next cell ``by`` along the axis, the one on the other side where there is none."""

    def moved(a, step):
        out = np.zeros_like(a)
        to, of = [slice(None)] * 3, [slice(None)] * 3
        to[axis], of[axis] = (slice(0, -1), slice(1, None)) if step > 0 else (slice(1, None), slice(0, -1))
        out[tuple(to)] = a[tuple(of)]
        return out

    near, there = moved(v, by), moved(ok, by)
    return np.where(there, near, moved(v, -by)), there | moved(ok, -by)


def stencils(v: np.ndarray, ok: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """gx, gy and lap of (frame, y, x) of numbers, each with where it is there."""
    c = (v, ok)
    left, right = _either(v, ok, 2, -1), _either(v, ok, 2, 1)
    (lu, ld), (cu, cd), (ru, rd) = ((_either(*n, 1, -1), _either(*n, 1, 1)) for n in (left, c, right))
    with np.errstate(invalid="ignore", over="ignore"):
        gx = (ru[0] + 2 * right[0] + rd[0]) - (lu[0] + 2 * left[0] + ld[0])
        gy = (ld[0] + 2 * cd[0] + rd[0]) - (lu[0] + 2 * cu[0] + ru[0])
        lap = 2 * (lu[0] + ru[0] + ld[0] + rd[0]) - 8 * v
    corners = lu[1] & ru[1] & ld[1] & rd[1]
    return {"gx": (gx, corners & left[1] & right[1]), "gy": (gy, corners & cu[1] & cd[1]), "lap": (lap, corners & ok)}


def box_ranges(v: np.ndarray, ok: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Most minus least in a box cut at the edge, and where there is any; NaN is the most."""
    there = _window_any(_window_any(ok, half, 2), half, 1)
    hi, lo = np.where(ok, v, -np.inf), np.where(ok & ~np.isnan(v), v, np.inf)
    number = _window_any(_window_any(ok & ~np.isnan(v), half, 2), half, 1)
    for axis in (2, 1):
        for name, worst, pick in (("hi", -np.inf, np.maximum), ("lo", np.inf, np.minimum)):
            a = hi if name == "hi" else lo
            pad = [(0, 0)] * 3
            pad[axis] = (half, half)
            a, n = np.moveaxis(np.pad(a, pad, constant_values=worst), axis, -1), a.shape[axis]
            a = np.moveaxis(pick.reduce([a[..., i : i + n] for i in range(2 * half + 1)]), -1, axis)
            hi, lo = (a, lo) if name == "hi" else (hi, a)
    with np.errstate(invalid="ignore"):
        return np.where(number, hi - lo, np.nan), there


def box_totals(v: np.ndarray, ok: np.ndarray, half: int, mirror: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums in a box, and where there is any number; rows first, from left to right, then columns."""
    for axis in (2, 1):
        n = v.shape[axis]
        at = np.arange(-half, n + half)
        at = np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at)) if mirror else at
        inside = (at >= 0) & (at < n)
        at = np.where(inside, at, 0)
        shape = [1, 1, 1]
        shape[axis] = len(at)
        there = np.moveaxis(np.take(ok, at, axis) & inside.reshape(shape), axis, -1)
        wide = np.where(there, np.moveaxis(np.take(v, at, axis), axis, -1), 0.0)
        total, any_ = np.zeros_like(wide[..., :n]), np.zeros(wide[..., :n].shape, dtype=bool)
        for i in range(2 * half + 1):
            total = total + wide[..., i : i + n]
            any_ |= there[..., i : i + n]
        v, ok = np.moveaxis(total, -1, axis), np.moveaxis(any_, -1, axis)
    return v, ok


def grid_step(names: Sequence[str], run, fields: Sequence[T.StructField], size: tuple[int, int] | None = None):
    """A step of a pass: ``run`` takes grids (values, there, pixel present) of the columns
    ``names`` and gives (values, there) for ``fields``. With ``size`` a grid is the whole image, otherwise what a frame has."""

    def step(rows, starts):
        import pyarrow as pa

        y, x = places(rows)
        given = [_numbers(rows, n) for n in names]
        got = [(np.zeros(len(y)), np.zeros(len(y), dtype=bool)) for _ in fields]
        for at, f, yy, xx, (n, h, w) in by_size(y, x, starts):
            if size:
                h, w, yy, xx = *size, y[at], x[at]
            grids, present = [], np.zeros((n, h, w), dtype=bool)
            present[f, yy, xx] = True
            for v, ok in given:
                grid, there = np.zeros((n, h, w)), np.zeros((n, h, w), dtype=bool)
                grid[f, yy, xx], there[f, yy, xx] = v[at], ok[at]
                grids.append((grid, there, present))
            for (v, ok), (grid, there) in zip(got, run(*grids)):
                v[at], ok[at] = grid[f, yy, xx], there[f, yy, xx]
        for (v, ok), field in zip(got, fields):
            long = isinstance(field.dataType, T.LongType)
            rows = rows.append_column(field.name, pa.array(v.astype(np.int64) if long else v, mask=~ok))
        return rows

    return step, *fields


def ridge_step(mask: str, d2: str, inner: str, out: str, tol: float) -> tuple[Callable, T.StructField, T.StructField]:
    """``inner``, the root of ``d2``, and 1 in ``out`` where it is a 3 x 3 maximum inside the mask."""

    def run(rows, starts):
        import pyarrow as pa

        y, x = places(rows)
        far = rows.column(d2).to_numpy(zero_copy_only=False).astype(np.float64)
        dist, top = np.sqrt(far), np.full(len(y), -np.inf)
        for at, f, yy, xx, (n, h, w) in by_size(y, x, starts):
            grid = np.full((n, h + 2, w + 2), -np.inf)
            grid[f, yy + 1, xx + 1] = np.where(np.isnan(dist[at]), -np.inf, dist[at])
            grid = np.maximum.reduce([grid[:, :, i : i + w] for i in range(3)])
            top[at] = np.maximum.reduce([grid[:, i : i + h] for i in range(3)])[f, yy, xx]
        on = (rows.column(mask).to_numpy() == 1) & (dist > 0) & (dist >= top - tol)
        rows = rows.append_column(inner, pa.array(dist, mask=np.isnan(dist)))
        return rows.append_column(out, pa.array(on.astype(np.int32)))

    return run, T.StructField(inner, T.DoubleType()), T.StructField(out, T.IntegerType())


def blob_step(mask: str, reach: int, out: str = "blob", area: str | None = None) -> tuple[Callable, ...]:
    """Blob ids of mask pixels, NULL elsewhere, and their blob's pixels; rows sorted by y, x."""

    def run(rows, starts):
        import pyarrow as pa

        on = np.flatnonzero(rows.column(mask).to_numpy() == 1)
        blob, size = np.zeros(rows.num_rows, dtype=np.int64), np.zeros(rows.num_rows, dtype=np.int64)
        outside = np.ones(rows.num_rows, dtype=bool)
        outside[on] = False
        if len(on):
            y, x = (v[on] for v in places(rows))
            frame = np.searchsorted(starts, on, side="right")
            own = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
            first, last, root = frame_blobs(y, x, own, reach)
            blob[on] = np.repeat(y[root] * _ROW + x[root], last - first + 1)
            count = np.bincount(root, weights=last - first + 1, minlength=len(on)).astype(np.int64)
            size[on] = np.repeat(count[root], last - first + 1)
        rows = rows.append_column(out, pa.array(blob, mask=outside))
        return rows.append_column(area, pa.array(size)) if area else rows

    fields = [T.StructField(n, T.LongType()) for n in (out, area) if n]
    return run, *fields


def _over_frames(df: DataFrame, frame: str, order: Sequence[str], run: Callable, schema: T.StructType) -> DataFrame:
    """``run`` gives one table for a table of whole frames."""

    def each(batches):
        for rows, starts in _whole_frames(batches, frame):
            yield from run(rows, starts).to_batches()

    return together(df, frame, order).mapInArrow(each, schema)


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest one that pairs (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root = shorter
    return root


def frame_blobs(y: np.ndarray, x: np.ndarray, starts: np.ndarray, reach: int):
    """Runs of foreground pixels sorted by (frame, y, x), and the first run of each one's blob.

    Gives (first pixel of each run, last pixel of each run, its blob's first pixel), as places.
    """
    n = len(y)
    new = np.zeros(n, dtype=bool)
    new[starts] = True
    new[1:] |= (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], n] - 1
    which = np.searchsorted(starts, first, side="right")
    # one number line for all rows of all frames, with room between them
    width = int(x.max() - x.min()) + 4
    height = int(y.max() - y.min()) + 2
    line = (which * height + y[first] - y.min()) * width + 1 - x.min()
    begin, end = line + x[first], line + x[last]
    lo = np.searchsorted(end, begin + width - reach, side="left")
    hi = np.searchsorted(begin, end + width + reach, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(first)), count)
    b = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
    return first, last, first[united(len(first), a, b)]


def _reach(connectivity: int) -> int:
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return 1 if connectivity == 8 else 0


def blob_runs(df: DataFrame, mask: Column, connectivity: int = 8, frame: str = "frame_id") -> DataFrame:
    """(frame, line, start, stop, blob): the runs of a mask with their blob."""
    import pyarrow as pa

    reach = _reach(connectivity)
    d = df.filter(mask).select(frame, "y", "x")
    kind = d.schema
    names = [(frame, frame), ("line", "y"), ("start", "x"), ("stop", "x")]
    schema = T.StructType([*[T.StructField(n, kind[c].dataType) for n, c in names], T.StructField("blob", T.LongType())])

    def run(rows, starts):
        y, x = places(rows)
        first, last, root = frame_blobs(y, x, starts, reach)
        cols = [rows.column(c).take(pa.array(at)) for c, at in ((frame, first), ("y", first), ("x", first), ("x", last))]
        cols.append(pa.array(y[root] * _ROW + x[root]))
        return pa.table(cols, names=schema.fieldNames())

    return _over_frames(d, frame, "yx", run, schema)


def connected_components(df: DataFrame, mask: Column, connectivity: int = 8, frame: str = "frame_id") -> DataFrame:
    """Foreground pixels with their blob id, all other columns kept."""
    p = Pass(df.filter(mask), frame, "yx")
    return p.step(*blob_step(p.mask(F.lit(1), "_mask"), _reach(connectivity))).run()


def outer_contours(lab: np.ndarray, size: int) -> np.ndarray:
    """Length of the outer border of each of ``size`` blobs, as a walk from pixel to pixel.

    ``lab`` is (frame, y, x) of blob numbers, -1 for background, with background all round.
    Each 2 x 2 square shows the steps that the walk takes there: one straight step past two
    neighbours, a diagonal one across a square that lacks a pixel, and one on either side of
    two that touch at a corner. A step belongs to the background region it lies on, and the
    region to the left of a blob's first pixel is the one outside it; others are holes.
    """
    f, y, x = np.nonzero(lab < 0)
    starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    first, last, root = frame_blobs(y, x, starts, 0)
    region = np.full(lab.shape, -1, dtype=np.int64)
    region[f, y, x] = np.repeat(root, last - first + 1)
    flat = lab.ravel()
    own = np.flatnonzero(flat >= 0)
    numbers, at = np.unique(flat[own], return_index=True)
    outside = np.full(size, -1, dtype=np.int64)
    outside[numbers] = region.ravel()[own[at] - 1]

    quads = [np.s_[:, :-1, :-1], np.s_[:, :-1, 1:], np.s_[:, 1:, :-1], np.s_[:, 1:, 1:]]
    fg = [lab[q] >= 0 for q in quads]
    count = sum(v.astype(np.int8) for v in fg)
    blob = np.maximum.reduce([lab[q] for q in quads])
    corner = (count == 2) & (fg[0] == fg[3])
    length = np.zeros(size)
    for q, v in zip(quads, fg):
        # each background pixel of the square; two neighbours share one straight step
        for where, step in ((count == 3, math.sqrt(2)), (corner, math.sqrt(2)), ((count == 2) & ~corner, 0.5)):
            at = where & ~v
            b = blob[at]
            outer = region[q][at] == outside[b]
            length += np.bincount(b[outer], minlength=size) * step
    return length


def least_rectangle(points: list[tuple[int, int]]) -> tuple[float, float]:
    """(longer, shorter) side of the rectangle of least area around points, the longer one of equals.

    A side of it lies on an edge of the convex hull, so every edge is tried.
    """
    points = sorted(set(points))
    if len(points) == 1:
        return 0.0, 0.0

    def chain(some):
        out = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(points) + chain(points[::-1])
    best = None
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1]):
        dx, dy = x1 - x0, y1 - y0
        along = [x * dx + y * dy for x, y in hull]
        across = [y * dx - x * dy for x, y in hull]
        a, b = max(along) - min(along), max(across) - min(across)
        long, short, square = max(a, b), min(a, b), dx * dx + dy * dy
        key = (a * b / square, -long * long / square)
        if best is None or key < best[0]:
            best = key, long / math.sqrt(square), short / math.sqrt(square)
    return best[1:]


def outlines(df: DataFrame, mask: Column, frame: str = "frame_id") -> DataFrame:
    """(frame, blob, area, contour, rect_long, rect_short) of 8-connected blobs.

    ``contour`` is the length of the closed outer border from pixel centre to pixel centre,
    0 for one pixel; the rectangle is the one of least area around the pixel centres.
    """
    import pyarrow as pa

    d = df.filter(mask).select(frame, "y", "x")
    real = [T.StructField(c, T.DoubleType()) for c in ("contour", "rect_long", "rect_short")]
    long = [T.StructField(c, T.LongType()) for c in ("blob", "area")]
    schema = T.StructType([d.schema[frame], *long, *real])

    def run(rows, starts):
        y, x = places(rows)
        first, last, root = frame_blobs(y, x, starts, 1)
        roots, number = np.unique(root, return_inverse=True)
        pixel = np.repeat(number, last - first + 1)
        contour = np.zeros(len(roots))
        for at, f, yy, xx, (n, h, w) in by_size(y, x, starts):
            lab = np.full((n, h + 2, w + 2), -1, dtype=np.int64)
            lab[f, yy + 1, xx + 1] = pixel[at]
            contour += outer_contours(lab, len(roots))
        # the ends of runs have the same hull as all pixels
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(len(roots) + 1))
        ends = np.stack([first[order], last[order]], axis=1)
        sides = []
        for lo, hi in zip(bounds, bounds[1:]):
            at = ends[lo:hi].ravel()
            sides.append(least_rectangle(list(zip(x[at].tolist(), y[at].tolist()))))
        sides = np.array(sides).reshape(-1, 2)
        cols = [
            rows.column(frame).take(pa.array(roots)),
            pa.array(y[roots] * _ROW + x[roots]),
            pa.array(np.bincount(pixel, minlength=len(roots))),
            *(pa.array(v) for v in (contour, sides[:, 0], sides[:, 1])),
        ]
        return pa.table(cols, names=schema.fieldNames())


    return _over_frames(d, frame, "yx", run, schema)
