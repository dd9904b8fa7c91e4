"""Exact Euclidean distance fields on pixel tables.

A frame is one image, so its size is bounded. Spark brings frames together and sorts them;
each task then works on as many whole frames as an Arrow batch holds, frames of one size in
one array. Along columns the nearest seed above and below is known at once; along rows the
lower envelope of the parabolas of all columns gives the nearest seed at any distance. The
squared distance and the seed's rank in (y, x) are packed in one long, so ties go to the
smaller (y, x). Columns that aren't used pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.session import batches_by_rows

#: Longest side of a frame: the packed long holds squared distance times pixels below 2**61.
MAX_SIDE = 1 << 15


def nearest_seed(seed: np.ndarray) -> np.ndarray:
    """Flat index (y * width + x) of the nearest seed for all cells of ``seed`` (frame, y, x).

    -1 in frames without seeds.
    """
    n, h, w = seed.shape
    if max(h, w) > MAX_SIDE:
        raise ValueError(f"a frame of {h} x {w} pixels is larger than {MAX_SIDE} on a side")
    unit = np.int64(h * w)
    far = np.int64(1) << 62
    ys = np.arange(h, dtype=np.int64)[None, :, None]
    above = np.maximum.accumulate(np.where(seed, ys, -4 * MAX_SIDE), axis=1)
    below = np.minimum.accumulate(np.where(seed, ys, 4 * MAX_SIDE)[:, ::-1], axis=1)[:, ::-1]
    sy = np.where(ys - above <= below - ys, above, below)
    seen = seed.any(axis=1)
    cols = np.flatnonzero(seen.any(axis=0))
    if not len(cols):
        return np.full(seed.shape, -1, dtype=np.int64)
    sy = np.ascontiguousarray(sy[:, :, cols].reshape(n * h, -1).T)
    gap = np.tile(np.arange(h, dtype=np.int64), n)[None, :] - sy
    start = gap * gap * unit + sy * w + cols[:, None]
    start[np.repeat(~seen[:, cols], h, axis=0).T] = far

    # one stack of columns per row: which column wins, and from which x on
    lines = np.arange(n * h)
    top = np.zeros(n * h, dtype=np.int64)
    item = np.zeros(start.shape, dtype=np.int64)
    since = np.zeros(start.shape, dtype=np.int64)
    since[0] = np.iinfo(np.int64).min
    for q in range(1, len(cols)):
        live = lines[start[q] < far]
        while len(live):
            t = top[live]
            at = item[t, live]
            wide = cols[q] - cols[at]
            rise = start[q, live] - start[at, live] + unit * (cols[q] ** 2 - cols[at] ** 2)
            x = rise // (2 * unit * wide) + 1
            stays = x > since[t, live]
            put = stays & (x < w)
            rows, level = live[put], t[put] + 1
            top[rows] = level
            item[level, rows] = q
            since[level, rows] = x[put]
            live = live[~stays]
            top[live] -= 1
    level = np.zeros((n * h, w), dtype=np.int64)
    for k in range(1, int(top.max()) + 1):
        rows = np.flatnonzero(top >= k)
        level[rows, np.maximum(since[k, rows], 0)] = k
    level = np.maximum.accumulate(level, axis=1)
    won = item[level, lines[:, None]]
    flat = sy[won, lines[:, None]] * w + cols[won]
    flat = flat.reshape(n, h, w)
    flat[~seen.any(axis=1)] = -1
    return flat


def _whole_frames(batches: Iterator, frame: str) -> Iterator:
    """Tables of whole frames with the starts of the frames; rows come sorted by frame."""
    import pyarrow as pa

    held, key = [], None

    def cut(parts):
        table = pa.concat_tables(parts).combine_chunks()
        code = table.column(frame).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code.indices.to_numpy()
        return table, np.flatnonzero(np.r_[True, code[1:] != code[:-1]])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and table.column(frame)[0].as_py() != key:
            yield cut(held)
            held = []
        whole, starts = cut([table])
        last = int(starts[-1])
        if last:
            yield cut([*held, whole.slice(0, last)])
            held, whole = [], whole.slice(last)
        held.append(whole)
        key = whole.column(frame)[0].as_py()
    if held:
        yield cut(held)


def by_size(y: np.ndarray, x: np.ndarray, starts: np.ndarray):
    """(rows, frame, y, x, shape) of frames of one size, a few million cells at a time."""
    which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)]))
    y0, x0 = np.minimum.reduceat(y, starts), np.minimum.reduceat(x, starts)
    size = np.stack([np.maximum.reduceat(y, starts) - y0, np.maximum.reduceat(x, starts) - x0]) + 1
    for h, w in np.unique(size, axis=1).T:
        same = np.flatnonzero((size[0] == h) & (size[1] == w))
        # at least one frame
        step = max(1, (1 << 22) // int(h * w))
        for some in (same[i : i + step] for i in range(0, len(same), step)):
            place = np.full(len(starts), -1)
            place[some] = np.arange(len(some))
            at = np.flatnonzero(place[which] >= 0)
            f = which[at]
            yield at, place[f], y[at] - y0[f], x[at] - x0[f], (len(some), int(h), int(w))


def places(rows) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(c).to_numpy().astype(np.int64) for c in "yx")


def together(df: DataFrame, frame: str, order: Sequence[str] = ()) -> DataFrame:
    """Whole frames in one task, sorted by frame and ``order``; ``_whole`` has to be kept until
    they are used. A window, so rows that are partitioned by frame stay where they are."""
    batches_by_rows(df.sparkSession)
    w = Window.partitionBy(frame)
    place = F.row_number().over(w.orderBy(*order)) if order else F.count(F.lit(1)).over(w)
    return df.withColumn("_whole", place)


def groups_of(rows, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, first row of each group) by the values of some columns."""
    import pyarrow as pa

    key, most = np.zeros(rows.num_rows, dtype=np.int64), 1
    for c in by if rows.num_rows else ():
        column = rows.column(c).combine_chunks()
        if pa.types.is_integer(column.type) and not column.null_count:
            code = column.to_numpy().astype(np.int64)
            wide = int(code.max()) - int(code.min()) + 1
            code = code - code.min()
        else:
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            wide = int(code.max()) + 1
        if wide >= 1 << 31:
            values, code = np.unique(code, return_inverse=True)
            wide = len(values)
        if most * wide >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            most = len(values)
        key, most = key * wide + code, most * wide
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return group, first


def group_percentiles(v: np.ndarray, mask: np.ndarray, group: np.ndarray, n: int, q: float) -> tuple[np.ndarray, np.ndarray]:
    """(percentile of each of n groups' values under the mask, whether it has any); linear
    between two values, NaN is the largest."""
    at = np.flatnonzero(mask)
    at = at[np.lexsort((v[at], group[at]))]
    count = np.bincount(group[at], minlength=n)
    some = np.flatnonzero(count)
    out = np.full(n, np.nan)
    pos, first = (count[some] - 1) * q, (np.cumsum(count) - count)[some]
    lo, hi = np.floor(pos), np.ceil(pos)
    a, b = v[at[first + lo.astype(np.int64)]], v[at[first + hi.astype(np.int64)]]
    with np.errstate(invalid="ignore"):
        out[some] = np.where((lo == hi) | (a == b), a, (hi - pos) * a + (pos - lo) * b)
    return out, count > 0


def group_counts(group: np.ndarray, n: int, *masks: np.ndarray) -> list[np.ndarray]:
    """For each mask its rows in each of n groups."""
    return [np.bincount(group[m], minlength=n).astype(np.int64) for m in masks]


def pa_array(v: np.ndarray):
    import pyarrow as pa

    return pa.array(v)


def with_nulls(v: np.ndarray, there: np.ndarray):
    """An Arrow array that is NULL where there is none."""
    import pyarrow as pa

    return pa.array(v, mask=~there)


class Pass:
    """Steps on whole frames, as arrays, in one visit of Python.

    Spark brings a frame's rows together unless the table is partitioned by frame already, and
    sorts them. What Python gives back counts as unpartitioned, so steps that build on each other
    belong in one pass. Only ``df``'s columns and those asked for come back.
    """

    def __init__(self, df: DataFrame, frame: str = "frame_id", order: Sequence[str] = ()):
        self.df, self.frame, self.order = df, frame, order
        self.given, self.steps, self.fields = {}, [], []

    def mask(self, column: Column, name: str) -> str:
        """A 0/1 column for the steps; NULL is -1."""
        self.given[name] = F.coalesce(column.cast("int"), F.lit(-1))
        return name

    def step(self, run, *fields: T.StructField) -> Pass:
        """``run`` takes (table, starts of the frames) and gives the table with ``fields``."""
        self.steps.append(run)
        self.fields += fields
        return self

    def nearest(self, seed: str, values: dict[str, str], prefix: str = "_edt_", kinds: dict | None = None) -> Pass:
        """Add d2, y, x and ``values`` (column: new name) of the nearest pixel with ``seed`` 1."""
        kinds = kinds or {c: self.df.schema[c].dataType for c in values}
        new = [T.StructField(f"{prefix}{c}", T.LongType()) for c in ("d2", "y", "x")]
        new += [T.StructField(n, kinds[c]) for c, n in values.items()]
        return self.step(lambda rows, starts: _nearest(rows, starts, seed, values, prefix), *new)

    def run(self, drop: Sequence[str] = (), only: str | None = None) -> DataFrame:
        """The table with the new columns but ``drop``; with ``only``, rows where it isn't NULL."""
        names, steps, frame = [f.name for f in self.fields], self.steps, self.frame
        d = together(self.df.withColumns(self.given).drop(*names), frame, self.order)
        out = [f for f in self.df.schema.fields if f.name not in names and f.name not in drop]
        out += [f for f in self.fields if f.name not in drop]
        keep = [f.name for f in out]

        def run(batches):
            import pyarrow.compute as pc

            for rows, starts in _whole_frames(batches, frame):
                for step in steps:
                    rows = step(rows, starts)
                if only:
                    rows = rows.filter(pc.is_valid(rows.column(only)))
                yield from rows.select(keep).to_batches()

        return d.mapInArrow(run, T.StructType(out))


    def collapse(self, by: Sequence[str], make, fields: Sequence[T.StructField]) -> DataFrame:
        """(by.., frame, fields..): a row for each group of a frame's rows, made where the frame
        is, so that no pixel is exchanged afterwards. ``make`` takes (table after the steps,
        starts of the frames, group of each row, number of groups) and gives arrays for ``fields``.
        """
        steps, frame, keys = self.steps, self.frame, [*by, self.frame]
        d = together(self.df.withColumns(self.given), frame, self.order)
        schema = T.StructType([*[self.df.schema[c] for c in keys], *fields])

        def run(batches):
            import pyarrow as pa

            for rows, starts in _whole_frames(batches, frame):
                for step in steps:
                    rows = step(rows, starts)
                group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
                first = starts
                if by:
                    rows = rows.append_column("_frame", pa.array(group))
                    inner, at = groups_of(rows, ["_frame", *by])
                    group, first = (inner, at) if len(at) > len(starts) else (group, first)
                out = [rows.column(c).take(pa.array(first)) for c in keys]
                out += make(rows, starts, group, len(first))
                yield from pa.table(out, names=schema.fieldNames()).to_batches()

        return d.mapInArrow(run, schema)


def _nearest(rows, starts: np.ndarray, seed: str, values: dict[str, str], prefix: str):
    import pyarrow as pa

    y, x = places(rows)
    sown = rows.column(seed).to_numpy() == 1
    found = np.full(len(y), -1, dtype=np.int64)
    for at, f, yy, xx, shape in by_size(y, x, starts):
        grid = np.full(shape, -1, dtype=np.int64)
        s = sown[at]
        grid[f[s], yy[s], xx[s]] = at[s]
        near = nearest_seed(grid >= 0)[f, yy, xx]
        ok = near >= 0
        found[at[ok]] = grid[f[ok], near[ok] // shape[2], near[ok] % shape[2]]
    none = found < 0
    src = np.where(none, 0, found)
    d2 = (y - y[src]) ** 2 + (x - x[src]) ** 2
    for name, v in zip(("d2", "y", "x"), (d2, y[src], x[src])):
        rows = rows.append_column(f"{prefix}{name}", pa.array(v, pa.int64(), mask=none))
    take = pa.array(src, pa.int64(), mask=none)
    for old, new in values.items():
        rows = rows.append_column(new, rows.column(old).take(take))
    return rows


def _with_nearest(df: DataFrame, seed: Column, frame: str, values: dict[str, str]) -> DataFrame:
    """Add _edt_d2, _edt_y, _edt_x and ``values`` (column: new name) of the nearest seed pixel."""
    p = Pass(df, frame)
    return p.nearest(p.mask(seed, "_edt_seed"), values).run()


def mask_nearest(
    df: DataFrame,
    seed: Column,
    max_dist: float | None = None,
    frame: str = "frame_id",
    out: str = "dist",
    at: tuple[str, str] | None = None,
) -> DataFrame:
    """Add the distance to the nearest seed pixel, and optionally its position.

    Exact at any distance; NULL in frames without a seed, and beyond ``max_dist`` if one is
    asked for. One row per pixel; missing pixels are no seeds.
    """
    d = _with_nearest(df, seed, frame, {})
    near = F.lit(True) if max_dist is None else F.col("_edt_d2") <= max_dist * max_dist
    cols = {out: F.when(near, F.sqrt(F.col("_edt_d2").cast("double")))}
    if at:
        cols[at[0]] = F.when(near, F.col("_edt_y")).cast("int")
        cols[at[1]] = F.when(near, F.col("_edt_x")).cast("int")
    return d.withColumns(cols).drop("_edt_d2", "_edt_y", "_edt_x")


def value_of_nearest(
    df: DataFrame,
    seed: Column,
    values: Sequence[str],
    max_dist: float | None = None,
    frame: str = "frame_id",
    suffix: str = "_near",
) -> DataFrame:
    """Add ``dist`` and the values of the nearest seed pixel, as ``<value><suffix>``."""
    d = _with_nearest(df, seed, frame, {v: f"{v}{suffix}" for v in values})
    near = F.lit(True) if max_dist is None else F.col("_edt_d2") <= max_dist * max_dist
    cols = {f"{v}{suffix}": F.when(near, F.col(f"{v}{suffix}")) for v in values}
    cols["dist"] = F.when(near, F.sqrt(F.col("_edt_d2").cast("double")))
    return d.withColumns(cols).drop("_edt_d2", "_edt_y", "_edt_x")


def signed_distance(
    df: DataFrame, mask: Column, max_dist: float | None = None, frame: str = "frame_id",
    out: str = "signed",
) -> DataFrame:
    """Positive outside the mask, negative inside; NULL without a border or beyond ``max_dist``."""
    p = Pass(df, frame)
    p.nearest(p.mask(mask, "_edt_in"), {}, "_edt_in_").nearest(p.mask(~mask, "_edt_out"), {}, "_edt_out_")
    scratch = [f"_edt_{side}_{c}" for side in ("in", "out") for c in "yx"]

    def dist(d2):
        near = F.lit(True) if max_dist is None else F.col(d2) <= max_dist * max_dist
        return F.when(near, F.sqrt(F.col(d2).cast("double")))

    d = p.run(scratch).withColumn(out, dist("_edt_in_d2") - dist("_edt_out_d2"))
    return d.drop("_edt_in_d2", "_edt_out_d2")


def edge_profile(
    df: DataFrame,
    value: Column,
    mask: Column,
    band: int = 4,
    step: float = 0.25,
    min_px: int = 4,
    by: Sequence[str] = (),
    frame: str = "frame_id",
) -> DataFrame:
    """Mean value per signed-distance bin: (by.., bin, centre, n, mean)."""
    d = df.select(*by, frame, "y", "x", value.cast("double").alias("_v"), mask.alias("_in"))
    d = signed_distance(d, F.col("_in"), band + 1, frame, "_edt_sd")
    d = d.filter(F.abs(F.col("_edt_sd")) <= band)
    b = F.floor((F.col("_edt_sd") + band) / step).cast("int")
    return (
        d.select(*by, b.alias("bin"), "_v")
        .filter(F.col("bin") < int(2 * band / step))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
        .filter(F.col("n") >= min_px)
        .withColumn("centre", (F.col("bin") + 0.5) * step - band)
    )


def ramp_width(profile: DataFrame, by: Sequence[str] = (), lo: float = 0.1, hi: float = 0.9):
    """Distance between the first crossings of two levels, linearly interpolated.

    A profile has a few dozen bins, which bounds the window.
    """
    keys = list(by) or ["_all"]
    p = profile if by else profile.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("bin")
    p = p.withColumns({"_edt_m2": F.lead("mean").over(w), "_edt_c2": F.lead("centre").over(w)})

    def cross(level):
        a, b = F.col("mean") - level, F.col("_edt_m2") - level
        hit = (a * b <= 0) & (F.col("mean") != F.col("_edt_m2"))
        at = F.col("centre") + (level - F.col("mean")) / (F.col("_edt_m2") - F.col("mean")) * (
            F.col("_edt_c2") - F.col("centre")
        )
        return F.min_by(F.when(hit, at), F.when(hit, F.col("bin")))

    out = p.groupBy(*keys).agg(cross(lo).alias("_lo"), cross(hi).alias("_hi"))
    out = out.select(*keys, F.abs(F.col("_lo") - F.col("_hi")).alias("width"))
    return out if by else out.drop("_all")
