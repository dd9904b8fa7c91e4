"""Point-cloud operators: projection, splatting, neighbours, clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions.seeded import normal, uniform
from pixelmill.operators import celltree
from pixelmill.operators.components import components
from pixelmill.operators.distance import group_percentiles, groups_of, value_of_nearest
from pixelmill.operators.ordered import exact_percentiles, row_index
from pixelmill.operators.raster import united
from pixelmill.operators.windows import morph
from pixelmill.session import cut_lineage

AXES = ("px", "py", "pz")


def directional_light(
    points: DataFrame,
    direction: Sequence[float],
    ambient: float = 0.65,
    gain: float = 0.45,
    span: float = 1.6,
    cloud: Sequence[str] = ("sample_id",),
    channels: Sequence[str] = ("b", "g", "r"),
) -> DataFrame:
    """Scale point colour by how far the point sits toward the light."""
    mid = points.groupBy(*cloud).agg(
        *[((F.min(a) + F.max(a)) / 2).alias(f"_c{a}") for a in AXES]
    )
    j = points.join(mid, list(cloud))
    along = sum(
        ((F.col(a) - F.col(f"_c{a}")) * float(d) for a, d in zip(AXES, direction)), F.lit(0.0)
    )
    t = -along / max(span, 1e-6)
    k = ambient + gain * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * t))
    lit = {
        c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) * k))).cast("int")
        for c in channels
    }
    return j.withColumns(lit).drop(*[f"_c{a}" for a in AXES])


# Render frustum and view directions.
FRUSTUM, IMG_H, IMG_W = 1.1, 480, 640
NEAR_MM, RANGE_MM = 500.0, 1000.0


def view_matrix(look: Sequence[float], up: Sequence[float]) -> list[list[float]]:
    """Rows right, down, forward of an orthographic camera, in world coordinates."""

    def unit(v):
        n = math.sqrt(sum(c * c for c in v))
        return [c / n for c in v]

    def cross(a, b):
        return [
            a[1] * b[2] - a[2] * b[1],
            a[2] * b[0] - a[0] * b[2],
            a[0] * b[1] - a[1] * b[0],
        ]

    forward = unit(look)
    right = unit(cross(forward, up))
    return [right, cross(forward, right), forward]


def _rotation(view: Column, views: dict[str, list[list[float]]]) -> Column:
    """Nine numbers of a view's matrix from a literal map (as many rows as views)."""
    items = []
    for name, m in views.items():
        items += [F.lit(name), F.array(*[F.lit(float(c)) for row in m for c in row])]
    return F.create_map(*items)[view]


def project(points: DataFrame, views: dict[str, list[list[float]]]) -> DataFrame:
    """Camera coordinates cx, cy, cz of every point in every view, added to the row."""
    turns = [F.struct(F.lit(v).alias("view"), *[F.lit(float(c)).alias(f"_r{i}") for i, c in enumerate(c for row in m for c in row)]) for v, m in views.items()]
    d = points.select("*", F.inline(F.array(*turns)))
    dots = {
        out: sum((F.col(a) * F.col(f"_r{3 * i + j}") for j, a in enumerate(AXES)), F.lit(0.0))
        for i, out in enumerate(("cx", "cy", "cz"))
    }
    return d.withColumns(dots).drop(*[f"_r{i}" for i in range(9)])


def _scale(size: tuple[int, int]) -> float:
    return size[0] / (2 * FRUSTUM)


def to_pixel(df: DataFrame, size: tuple[int, int] = (IMG_H, IMG_W)) -> DataFrame:
    """Add rounded pixel u, v, quantised depth_mm and in_frustum to projected points."""
    s, (h, w) = _scale(size), size
    mm = (F.col("cz") + FRUSTUM) / (2 * FRUSTUM) * RANGE_MM + NEAR_MM
    return df.withColumns(
        {
            "u": F.rint(F.col("cx") * s + w / 2.0).cast("int"),
            "v": F.rint(F.col("cy") * s + h / 2.0).cast("int"),
            "depth_mm": F.floor(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), mm))).cast("int"),
            "in_frustum": F.col("cz").between(-FRUSTUM, FRUSTUM),
        }
    )


def _disc(r: int) -> list[tuple[int, int]]:
    span = range(-r, r + 1)
    return [(dx, dy) for dy in span for dx in span if dx * dx + dy * dy <= r * r]


def z_buffer(
    projected: DataFrame,
    size: tuple[int, int] = (IMG_H, IMG_W),
    keys: Sequence[str] = ("sample_id", "view"),
    radius: int = 1,
    big_label: int = 3,
    big_scale: float = 1.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Nearest point per pixel: (keys.., y, x, depth_mm, point_id, label6, carry..).

    Each point is splatted as a disc, a bigger one for ``big_label`` when ``big_scale``
    exceeds 1. Ties in depth go to the lower point id. A minimum per pixel, so it
    combines map-side and does not depend on order.
    """
    h, w = size

    def offsets(r):
        return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in _disc(r)])

    splat = offsets(radius)
    if big_scale > 1.0:
        span = 2 * radius + 1
        big = max(radius + 1, round((span * big_scale - 1) / 2.0))
        splat = F.when(F.col("label") == big_label, offsets(big)).otherwise(splat)
    d = to_pixel(projected, size).filter("in_frustum")
    label6 = F.when(F.col("label").between(0, 4), F.col("label") + 1).otherwise(0)
    fits = not carry and d.schema["point_id"].dataType.typeName() in ("byte", "short", "integer")
    # depth, point and label in one long, which a hash table keeps in place: 16, 33 and 3 bits
    point = F.coalesce(F.col("point_id").cast("bigint") + _NO_POINT, F.lit(0).cast("bigint"))
    packed = F.shiftleft(F.col("depth_mm").cast("bigint"), 36) + F.shiftleft(point, 3) + label6
    d = d.withColumn("_o", F.explode(splat))
    d = d.withColumns({"x": F.col("u") + F.col("_o.dx"), "y": F.col("v") + F.col("_o.dy")})
    d = d.filter(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    if not fits:
        best = F.min(F.struct("depth_mm", "point_id", label6.alias("label6"), *carry))
        return d.groupBy(*keys, "y", "x").agg(best.alias("_b")).select(*keys, "y", "x", "_b.*")
    b = F.col("_b")
    point = F.shiftright(b, 3).bitwiseAND(F.lit((1 << 33) - 1))
    return d.groupBy(*keys, "y", "x").agg(F.min(packed).alias("_b")).select(
        *keys, "y", "x",
        F.shiftright(b, 36).cast("int").alias("depth_mm"),
        F.when(point > 0, point - _NO_POINT).cast(d.schema["point_id"].dataType).alias("point_id"),
        b.bitwiseAND(F.lit(7)).cast("int").alias("label6"),
    )


#: What lifts an integer point id above 0, which stands for none.
_NO_POINT = (1 << 31) + 1


def dense(
    df: DataFrame, size: tuple[int, int], keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Every pixel of every frame that has at least one row; missing values are 0."""
    h, w = size
    frames = df.select(*keys).distinct()
    cells = frames.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("_i"))
    grid = cells.select(
        *keys,
        F.floor(F.col("_i") / w).cast("int").alias("y"),
        (F.col("_i") % w).alias("x"),
        *[F.lit(0).cast(df.schema[v].dataType).alias(v) for v in values],
        F.lit(False).alias("_hit"),
    )
    rows = grid.unionByName(df.select(*keys, "y", "x", *values, F.lit(True).alias("_hit")))
    best = F.max(F.struct("_hit", *values))
    return rows.groupBy(*keys, "y", "x").agg(best.alias("_b")).select(
        *keys, "y", "x", *[F.col(f"_b.{v}").alias(v) for v in values]
    )


def fill_gaps(
    df: DataFrame, frame: str, depth: str = "depth_mm", values: Sequence[str] = ("label6",)
) -> DataFrame:
    """Close one-pixel gaps of a dense depth frame from the nearest valid pixel."""
    valid = F.col(depth) > 0
    d = morph(df, valid, "close", 1, "square", frame, "_closed")
    cols = [depth, *values]
    d = value_of_nearest(d, valid, cols, 2, frame, "_near")
    fill = (F.col("_closed") == 1) & (F.col(depth) == 0)
    d = d.withColumn("filled", fill.cast("int"))
    d = d.withColumns(
        {c: F.when(F.col("filled") == 1, F.col(f"{c}_near")).otherwise(F.col(c)) for c in cols}
    )
    return d.drop("_closed", "dist", *[f"{c}_near" for c in cols])


def unproject(
    pixels: DataFrame, views: dict[str, list[list[float]]], size: tuple[int, int] = (IMG_H, IMG_W)
) -> DataFrame:
    """Pixels with depth back to world points px, py, pz."""
    s, (h, w) = _scale(size), size
    d = pixels.filter(F.col("depth_mm") > 0).withColumn("_r", _rotation(F.col("view"), views))
    cam = [
        (F.col("x") - w / 2.0) / s,
        (F.col("y") - h / 2.0) / s,
        (F.col("depth_mm") - NEAR_MM) / RANGE_MM * (2 * FRUSTUM) - FRUSTUM,
    ]
    world = {
        a: sum((c * F.col("_r")[3 * i + j] for i, c in enumerate(cam)), F.lit(0.0))
        for j, a in enumerate(AXES)
    }
    return d.withColumns(world).drop("_r")


def backproject_pinhole(
    pixels: DataFrame, fx: float, fy: float, cx: float, cy: float,
    unit_m: float = 0.001, z_min: float = 0.1, z_max: float = 3.0,
) -> DataFrame:
    """Valid-depth pixels to camera-frame metres."""
    z = F.col("depth_mm") * unit_m
    d = pixels.filter((F.col("depth_mm") > 0) & z.between(z_min, z_max))
    return d.withColumns(
        {
            "px": (F.col("x") - cx) / fx * z,
            "py": (F.col("y") - cy) / fy * z,
            "pz": z.cast("double"),
        }
    )


def normalise_cloud(points: DataFrame, by: Sequence[str] = ("sample_id",), fill: float = 0.9):
    """Centre on the mean and scale the largest half extent to ``fill`` of the frustum."""
    mean = points.groupBy(*by).agg(*[F.avg(a).alias(f"_m{a}") for a in AXES])
    d = points.join(mean.hint("merge"), list(by))
    d = d.withColumns({a: F.col(a) - F.col(f"_m{a}") for a in AXES}).drop(*[f"_m{a}" for a in AXES])
    half = d.groupBy(*by).agg(F.max(F.greatest(*[F.abs(a) for a in AXES])).alias("_h"))
    k = fill * FRUSTUM / F.greatest(F.col("_h"), F.lit(1e-9))
    return d.join(half.hint("merge"), list(by)).withColumns({a: F.col(a) * k for a in AXES}).drop("_h")


def local_frame(points: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Centre X and Z on their box, put the lowest Y at 0, scale the longest extent to 1."""
    aggs = []
    for a in AXES:
        aggs += [F.min(a).alias(f"_lo{a}"), F.max(a).alias(f"_hi{a}")]
    d = points.join(points.groupBy(*by).agg(*aggs).hint("merge"), list(by))
    extent = F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in AXES], F.lit(1e-9))
    zero = {
        a: F.col(f"_lo{a}") if a == "py" else (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2 for a in AXES
    }
    d = d.withColumn("_e", extent)
    d = d.withColumns({a: (F.col(a) - zero[a]) / F.col("_e") for a in AXES})
    return d.drop("_e", *[f"_{s}{a}" for s in ("lo", "hi") for a in AXES])


def crop_axis(points: DataFrame, axis: str, lo: float, hi: float) -> DataFrame:
    return points.filter(F.col(axis).between(lo, hi))


# The six canonical views, look direction and up vector.
CANONICAL_VIEWS = {
    "front": ((0, 0, -1), (0, 1, 0)),
    "back": ((0, 0, 1), (0, 1, 0)),
    "right": ((1, 0, 0), (0, 1, 0)),
    "left": ((-1, 0, 0), (0, 1, 0)),
    "top": ((0, -1, 0), (0, 0, -1)),
    "bottom": ((0, 1, 0), (0, 0, 1)),
}


def canonical_views() -> dict[str, list[list[float]]]:
    return {name: view_matrix(look, up) for name, (look, up) in CANONICAL_VIEWS.items()}


# ---- neighbours


def _cells(df: DataFrame, size: float, spread: int, axes: Sequence[str] = AXES) -> DataFrame:
    """Add integer cell columns _k0.._k2; with ``spread`` also the neighbouring cells."""
    for i, a in enumerate(axes):
        c = F.floor(F.col(a) / size)
        if spread:
            c = F.explode(F.array(*[c + s for s in range(-spread, spread + 1)]))
        df = df.withColumn(f"_k{i}", c)
    return df


_KEYS = ["_k0", "_k1", "_k2"]


def _dist2(a: str = "", b: str = "_b_") -> Column:
    return sum(
        ((F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")) for x in AXES),
        F.lit(0.0),
    )


def _right(b: DataFrame, by, id_b, carry):
    return b.select(
        *by, F.col(id_b).alias("_bid"), *[F.col(x).alias(f"_b_{x}") for x in AXES],
        *[F.col(c).alias(f"near_{c}") for c in carry],
    )


def _right_cells(right: DataFrame, size: float, spread: int = 0) -> DataFrame:
    return _cells(right, size, spread, [f"_b_{x}" for x in AXES])


def nearest_point(
    a: DataFrame,
    b: DataFrame,
    k: int = 1,
    by: Sequence[str] = ("sample_id",),
    id_a: Sequence[str] = ("point_id",),
    id_b: str = "point_id",
    carry: Sequence[str] = (),
    exclude_self: bool = False,
) -> DataFrame:
    """The k nearest points of ``b`` for each row of ``a``: (by.., id_a.., rank, near_id,
    distance, near_<carry>..). Ties go to the lower id.

    Points meet through a tree of boxes (``celltree``), so neither a crowd in one place nor
    an outlier matters. A row of ``a`` without finite coordinates comes back once, with NULL;
    points of ``b`` without are no neighbours. A row whose cloud has no point in ``b`` has no
    row; one with fewer than k has as many as there are. ``id_a`` tells rows of a cloud apart.
    """
    by, id_a = list(by), list(id_a)
    if celltree.fits_task(a, b, by):
        found = celltree.each_with_each(a, b, k, by, id_a, id_b, carry, exclude_self)
        return _named(found, by, id_a, carry)
    ok = celltree.finite(AXES)
    found = celltree.nearest(a.filter(ok), b, k, by, id_a, id_b, carry, exclude_self)
    out = _named(found, by, id_a, carry)
    lost = a.filter(~ok).select(*by, *id_a, F.lit(1).alias("rank"))
    return out.unionByName(lost, allowMissingColumns=True)


def _named(found: DataFrame, by: list[str], id_a: list[str], carry: Sequence[str]) -> DataFrame:
    return found.select(
        *by, *id_a, "rank", F.col("e.id").alias("near_id"), F.sqrt("d2").alias("distance"),
        *[F.col(f"e.{c}").alias(f"near_{c}") for c in carry],
    )


def within_radius(
    a: DataFrame,
    b: DataFrame,
    r: float,
    k: int | None = None,
    by: Sequence[str] = ("sample_id",),
    id_a: Sequence[str] = ("point_id",),
    id_b: str = "point_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Points of ``b`` within r of each row of ``a``; with k the first k by id.

    Clouds that fit a task are worked on whole, so no list of pairs is exchanged.
    """
    by, id_a = list(by), list(id_a)
    if celltree.fits_task(a, b, by):
        return _within_whole(a, b, r, k, by, id_a, id_b, carry)
    left = _cells(a.select(*by, *id_a, *AXES), r, 1)
    pairs = left.join(_right_cells(_right(b, by, id_b, carry), r).hint("merge"), [*by, *_KEYS])
    pairs = pairs.withColumn("_d2", _dist2()).filter(F.col("_d2") <= r * r)
    out = pairs.select(
        *by, *id_a, F.col("_bid").alias("near_id"), F.sqrt("_d2").alias("distance"),
        *[f"near_{c}" for c in carry],
    )
    if k is None:
        return out
    w = Window.partitionBy(*by, *id_a).orderBy("near_id")
    return out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _within_whole(a: DataFrame, b: DataFrame, r: float, k: int | None, by, id_a, id_b: str, carry) -> DataFrame:
    """``within_radius`` of clouds that fit a task, in one visit of Python."""
    import pyarrow as pa

    ok = celltree.finite(AXES)
    real = [F.col(x).cast("double").alias(x) for x in AXES]
    right = _right(b.filter(ok), by, id_b, carry).withColumnRenamed("_bid", "near_id")
    right = right.withColumnsRenamed({f"_b_{x}": x for x in AXES}).withColumns({x: F.col(x).cast("double") for x in AXES})
    left = a.filter(ok).select(*by, *id_a, *real, F.lit(True).alias("_asks"))
    both = left.unionByName(right.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    kept, found = [*by, *id_a], ["near_id", *[f"near_{c}" for c in carry]]
    schema = T.StructType(
        [*[both.schema[c] for c in kept], right.schema["near_id"], T.StructField("distance", T.DoubleType()), *[right.schema[c] for c in found[1:]]]
    )

    def run(rows):
        asks = rows.column("_asks").to_numpy()
        xyz = [rows.column(c).to_numpy() for c in AXES]
        cloud = celltree.clouds_of(rows)[1]
        for i, j, d2 in celltree.pairs_within(cloud, xyz, np.flatnonzero(asks), np.flatnonzero(~asks), r):
            # rows lie in the order of their ids
            order = np.lexsort((j, i))
            i, j, d2 = i[order], j[order], d2[order]
            if k is not None:
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
                rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
                i, j, d2 = i[rank < k], j[rank < k], d2[rank < k]
            out = {c: rows.column(c).take(pa.array(i)) for c in kept} | {c: rows.column(c).take(pa.array(j)) for c in found}
            yield pa.table(out | {"distance": pa.array(np.sqrt(d2))}).select(schema.fieldNames())

    return celltree.whole_clouds(both, by, ["_asks", "near_id"], run, schema)


def bind_to_edge(
    points: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    by: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Nearest skeleton segment per point: (by.., point_id, a, b, t, weight_a, weight_b,
    ox, oy, oz, distance). Ties go to the lower (a, b).

    Segments lie in a tree of boxes by their middle: the best one of the leaf where a point
    would lie tells how far to look. A point without finite coordinates comes back with NULL,
    and a segment with such an end is none. Points whose cloud has no segment have no row.
    """
    by = list(by)
    if celltree.fits_task(points, edges, by):
        return _bind_whole(points, nodes, edges, by)
    e = edges.select(*by, "a", "b")
    for end in ("a", "b"):
        n = nodes.select(
            *by, F.col("node_id").alias(end), *[F.col(c).cast("double").alias(f"_{end}{c[1]}") for c in ("nx", "ny", "nz")]
        )
        e = e.join(n, [*by, end])
    xyz = ("x", "y", "z")
    e = e.filter(celltree.finite([f"_{end}{c}" for end in "ab" for c in xyz]))
    for c in xyz:
        lo, hi = F.least(f"_a{c}", f"_b{c}"), F.greatest(f"_a{c}", f"_b{c}")
        e = e.withColumns({f"p{c}": lo / 2 + hi / 2, f"lo_p{c}": lo, f"hi_p{c}": hi})
    tree = celltree.Tree(e, by)
    segments = tree.items.select(*by, "leaf", "a", "b", *[f"_{end}{c}" for end in "ab" for c in xyz])

    def nearer(j: DataFrame) -> DataFrame:
        ev = {c: F.col(f"_b{c}") - F.col(f"_a{c}") for c in xyz}
        pv = {c: F.col(f"p{c}") - F.col(f"_a{c}") for c in xyz}
        len2 = F.greatest(sum((ev[c] * ev[c] for c in xyz), F.lit(0.0)), F.lit(1e-12))
        t = F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), sum((pv[c] * ev[c] for c in xyz), F.lit(0.0)) / len2)
        )
        j = j.withColumn("t", t)
        off = {f"o{c}": pv[c] - F.col("t") * ev[c] for c in xyz}
        j = j.withColumns(off).withColumn(
            "_d2", sum((F.col(f"o{c}") * F.col(f"o{c}") for c in xyz), F.lit(0.0))
        )
        best = F.min(F.struct("_d2", "a", "b", "t", "ox", "oy", "oz"))
        return j.groupBy(*by, "point_id").agg(best.alias("_t")).select(*by, "point_id", "_t.*")

    ok = celltree.finite(AXES)
    left = points.filter(ok).select(*by, "point_id", *[F.col(a).cast("double").alias(a) for a in AXES])
    left = cut_lineage(tree.home(left))
    reach = nearer(left.join(segments.hint("merge"), [*by, "leaf"])).select(*by, "point_id", "_d2")
    # rounding must not shut out the segment that the reach comes from
    size = F.abs("px") + F.abs("py") + F.abs("pz") + 1
    left = left.drop("leaf").join(reach, [*by, "point_id"])
    left = cut_lineage(left.withColumn("_reach", F.pow(F.sqrt("_d2") * (1 + 1e-9) + size * 1e-12, F.lit(2.0))).drop("_d2"))
    found = tree.leaves(left, ["point_id", *AXES, "_reach"], "_reach")
    done = nearer(found.join(segments.hint("merge"), [*by, "leaf"]))
    done = done.select(
        *by, "point_id", "a", "b", "t", (1.0 - F.col("t")).alias("weight_a"),
        F.col("t").alias("weight_b"), "ox", "oy", "oz", F.sqrt("_d2").alias("distance"),
    )
    return done.unionByName(points.filter(~ok).select(*by, "point_id"), allowMissingColumns=True)


def _bind_whole(points: DataFrame, nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """``bind_to_edge`` of clouds and skeletons that fit a task: they meet in one visit of Python."""
    import pyarrow as pa

    ok, xyz = celltree.finite(AXES), ("x", "y", "z")
    kinds = {c: edges.schema[c].dataType for c in "ab"}
    left = points.select(*by, "point_id", *[F.col(a).cast("double").alias(a) for a in AXES], F.lit(2).alias("_kind"))
    node = nodes.select(*by, F.col("node_id").cast("bigint").alias("_a"), *[F.col(f"n{c}").cast("double").alias(f"p{c}") for c in xyz], F.lit(0).alias("_kind"))
    edge = edges.select(*by, *[F.col(c).cast("bigint").alias(f"_{c}") for c in "ab"], F.lit(1).alias("_kind"))
    both = left.filter(ok).unionByName(node.filter("_a is not null"), allowMissingColumns=True)
    both = both.unionByName(edge.filter("_a is not null and _b is not null"), allowMissingColumns=True)
    out = [T.StructField(c, T.DoubleType()) for c in ("t", "weight_a", "weight_b", "ox", "oy", "oz", "distance")]
    schema = T.StructType([*[both.schema[c] for c in (*by, "point_id")], *[T.StructField(c, T.LongType()) for c in "ab"], *out])

    def run(rows):
        kind = rows.column("_kind").to_numpy()
        cloud = celltree.clouds_of(rows)[1]
        node, edge, asks = (np.flatnonzero(kind == i) for i in range(3))
        # a node is told by its cloud and id
        ids = [rows.column(f"_{c}").fill_null(0).to_numpy() for c in "ab"]
        names = np.unique(ids[0][node])
        if not len(names):
            return
        own = cloud[node] * len(names) + np.searchsorted(names, ids[0][node])
        order = np.argsort(own, kind="stable")
        ends, there = [], np.ones(len(edge), dtype=bool)
        for v in ids:
            rank = np.minimum(np.searchsorted(names, v[edge]), len(names) - 1)
            key = cloud[edge] * len(names) + rank
            at = np.minimum(np.searchsorted(own[order], key), len(own) - 1)
            there &= (names[rank] == v[edge]) & (own[order][at] == key)
            ends.append(node[order][at])
        p = [rows.column(c).to_numpy(zero_copy_only=False) for c in AXES]
        a, b = ([v[e] for v in p] for e in ends)
        there &= np.isfinite([*a, *b]).all(axis=0)
        # segments lie by (a, b), so equal distances go to the lower one
        seg = edge[there]
        a, b = ([v[there] for v in end] for end in (a, b))
        size = np.bincount(cloud[seg], minlength=int(cloud[-1]) + 1)
        first, wide = np.cumsum(size) - size, int(size.max(initial=0))
        asks = asks[size[cloud[asks]] > 0]
        step = max(1, (1 << 20) // max(wide, 1))
        for some in (asks[i : i + step] for i in range(0, len(asks), step)):
            n = size[cloud[some]][:, None]
            inside = np.arange(wide)[None, :] < n
            at = first[cloud[some]][:, None] + np.where(inside, np.arange(wide)[None, :], 0)

            def offsets(at, q):
                ev, pv = [e[at] - s[at] for s, e in zip(a, b)], [v - s[at] for v, s in zip(q, a)]
                len2 = np.maximum(ev[0] * ev[0] + ev[1] * ev[1] + ev[2] * ev[2], 1e-12)
                t = np.clip((pv[0] * ev[0] + pv[1] * ev[1] + pv[2] * ev[2]) / len2, 0.0, 1.0)
                o = [x - t * y for x, y in zip(pv, ev)]
                return t, o, o[0] * o[0] + o[1] * o[1] + o[2] * o[2]

            d2 = offsets(at, [v[some][:, None] for v in p])[2]
            d2[~inside] = np.inf
            best = at[np.arange(len(some)), d2.argmin(axis=1)]
            t, o, d2 = offsets(best, [v[some] for v in p])
            cols = [rows.column(c).take(pa.array(some)) for c in (*by, "point_id")]
            cols += [pa.array(v[seg[best]]) for v in ids] + [pa.array(v) for v in (t, 1.0 - t, t, *o, np.sqrt(d2))]
            yield pa.table(cols, names=schema.fieldNames())

    done = celltree.whole_clouds(both, by, ["_kind", "_a", "_b"], run, schema)
    done = done.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    return done.unionByName(points.filter(~ok).select(*by, "point_id"), allowMissingColumns=True)


# ---- checks built on neighbours


def roundtrip_error(
    points: DataFrame, pixels: DataFrame, views, size=(IMG_H, IMG_W), sample: str = "sample_id",
) -> DataFrame:
    """Unproject every pixel, find its nearest original point: mean, p95, max per view.

    A view is one image, so in clouds that fit a task its distances are summed up where they
    are found.
    """
    world = unproject(pixels, views, size)
    if celltree.fits_task(world, points, [sample], len(views) * size[0] * size[1]):
        return _roundtrip_whole(world, points, sample)
    near = nearest_point(world, points, 1, [sample], ["view", "y", "x"])
    pct = exact_percentiles(near, [sample, "view"], "distance", {"p95": 0.95})
    base = near.groupBy(sample, "view").agg(
        F.avg("distance").alias("mean"), F.max("distance").alias("max")
    )
    return base.join(pct, [sample, "view"])


def _roundtrip_whole(world: DataFrame, points: DataFrame, sample: str) -> DataFrame:
    import pyarrow as pa

    real = [T.StructField(c, T.DoubleType()) for c in ("mean", "max", "p95")]
    kinds = [world.schema[c] for c in (sample, "view")]
    schema = T.StructType([*kinds, *real[:2], T.StructField("n", T.LongType()), real[2]])

    def summed(rows):
        d2 = rows.column("d2").to_numpy(zero_copy_only=False)
        rows, d = rows.filter(pa.array(~np.isnan(d2))), np.sqrt(d2[~np.isnan(d2)])
        group, first = groups_of(rows, [sample, "view"])
        n = np.bincount(group, minlength=len(first))
        most = np.zeros(len(first))
        np.maximum.at(most, group, d)
        out = [rows.column(c).take(pa.array(first)) for c in (sample, "view")]
        mean = np.bincount(group, weights=d, minlength=len(first)) / n
        p95, _ = group_percentiles(d, np.ones(len(d), dtype=bool), group, len(first), 0.95)
        return pa.table([*out, *(pa.array(v) for v in (mean, most, n, p95))], names=schema.fieldNames())

    out = celltree.each_with_each(world, points, 1, [sample], ["view", "y", "x"], "point_id", (), False, summed, schema)
    # as of a join by sample and view
    return out.filter(F.col(sample).isNotNull() & F.col("view").isNotNull())


def view_coverage(points: DataFrame, views, size=(IMG_H, IMG_W), sample: str = "sample_id"):
    """Share of points inside the image and the depth range in at least one view."""
    h, w = size
    p = to_pixel(project(points, views), size)
    s = _scale(size)
    u, v = F.col("cx") * s + w / 2.0, F.col("cy") * s + h / 2.0
    inside = F.col("in_frustum") & (u >= 0) & (u < w) & (v >= 0) & (v < h)
    per = p.groupBy(sample, "point_id").agg(F.max(inside.cast("int")).alias("_in"))
    return per.groupBy(sample).agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("_in").cast("bigint").alias("visible"),
        F.avg("_in").alias("coverage"),
    )


def label_consistency(
    points: DataFrame, pixels: DataFrame, views, size=(IMG_H, IMG_W), sample: str = "sample_id",
) -> DataFrame:
    """(label6, n, agree, share): does a pixel carry the label of its nearest point."""
    world = unproject(pixels, views, size)
    key = [sample, "view", "y", "x"]
    if celltree.fits_task(world, points, [sample], len(views) * size[0] * size[1]):
        j = _labels_whole(world, points, key)
    else:
        near = nearest_point(world, points, 1, [sample], key[1:], carry=["label"])
        j = near.join(pixels.select(*key, "label6").hint("merge"), key)
    own = F.col("near_label") + 1 == F.col("label6")
    return j.groupBy("label6").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(own).alias("agree"),
        (F.count_if(own) / F.count(F.lit(1))).alias("share"),
    )


def _labels_whole(world: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """(label6, near_label) of every pixel, those with the same key each with each."""
    import pyarrow as pa

    schema = T.StructType([world.schema["label6"], T.StructField("near_label", points.schema["label"].dataType)])

    def paired(rows):
        for c in key:
            rows = rows.filter(rows.column(c).is_valid())
        group, first = groups_of(rows, key)
        mine = their = np.arange(rows.num_rows)
        if len(first) < rows.num_rows:
            their = np.argsort(group, kind="stable")
            n = np.bincount(group)
            mine = np.repeat(mine, n[group])
            start = np.repeat((np.cumsum(n) - n)[group], n[group])
            nth = np.arange(len(mine)) - np.repeat(np.cumsum(n[group]) - n[group], n[group])
            their = their[start + nth]
        near = rows.column("_e_label").take(pa.array(mine))
        return pa.table([rows.column("label6").take(pa.array(their)), near], names=schema.fieldNames())

    id_a = [*key[1:], "label6"]
    return celltree.each_with_each(world, points, 1, key[:1], id_a, "point_id", ["label"], False, paired, schema)


def cross_view_error(
    pixels: DataFrame, views, pairs: Sequence[tuple[str, str]], size=(IMG_H, IMG_W),
    limit: float = 0.008, sample: str = "sample_id",
) -> DataFrame:
    """Opposing views: mean distance of pixels that meet within ``limit``, per pair.

    A view is one image, so both views of a pair are worked on whole, in one visit of Python.
    """
    import pyarrow as pa

    world = unproject(pixels, views, size)
    tags = [
        F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(asks).alias("_asks"), F.lit(view).alias("_of"))
        for a, b in pairs
        for view, asks in ((a, True), (b, False))
    ]
    mine = F.filter(F.array(*tags), lambda t: t["_of"] == F.col("view"))
    both = world.select(sample, *AXES, F.inline(mine)).drop("_of")
    both = both.filter(celltree.finite(AXES))
    best = T.StructType([both.schema[sample], both.schema["pair"], T.StructField("d", T.DoubleType())])

    def run(rows):
        asks = rows.column("_asks").to_numpy()
        xyz = [rows.column(c).to_numpy() for c in AXES]
        cloud = celltree.clouds_of(rows)[1]
        for i, _, d2 in celltree.pairs_within(cloud, xyz, np.flatnonzero(asks), np.flatnonzero(~asks), limit):
            near = np.full(rows.num_rows, np.inf)
            np.minimum.at(near, i, d2)
            at = np.unique(i)
            yield pa.table({c: rows.column(c).take(pa.array(at)) for c in (sample, "pair")} | {"d": pa.array(np.sqrt(near[at]))})

    best = celltree.whole_clouds(both, [sample, "pair"], ["_asks"], run, best)
    best = best.filter(F.col("d") < limit)
    return best.groupBy(sample, "pair").agg(
        F.count(F.lit(1)).alias("matches"), F.avg("d").alias("mean_error")
    )


def depth_envelope(
    points: DataFrame, pixels: DataFrame, views, size=(IMG_H, IMG_W), slack: float = 2.0,
    sample: str = "sample_id",
) -> DataFrame:
    """Rendered depth range inside the projected range (plus slack) and the valid range."""
    mm = (F.col("cz") + FRUSTUM) / (2 * FRUSTUM) * RANGE_MM + NEAR_MM
    want = project(points, views).groupBy(sample, "view").agg(
        F.min(mm).alias("expected_min"), F.max(mm).alias("expected_max")
    )
    got = pixels.filter(F.col("depth_mm") > 0).groupBy(sample, "view").agg(
        F.min("depth_mm").alias("actual_min"),
        F.max("depth_mm").alias("actual_max"),
        F.avg("depth_mm").alias("actual_mean"),
    )
    lo, hi = F.col("expected_min") - slack, F.col("expected_max") + slack
    ok = (
        (F.col("actual_min") >= F.greatest(lo, F.lit(NEAR_MM)))
        & (F.col("actual_max") <= F.least(hi, F.lit(NEAR_MM + RANGE_MM)))
        & F.col("actual_mean").between(lo, hi)
    )
    return want.join(got, [sample, "view"]).withColumn("passed", ok)


def cloud_coverage(
    a: DataFrame, b: DataFrame, thr: float, by: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Per class of ``a``: share with a point of ``b`` nearer than thr; distance spread."""
    near = nearest_point(a, b, 1, by, ["point_id"])
    j = near.join(a.select(*by, "point_id", "label").hint("merge"), [*by, "point_id"])
    base = j.groupBy("label").agg(
        F.avg((F.col("distance") < thr).cast("double")).alias("coverage"),
        F.avg("distance").alias("mean"),
        F.max("distance").alias("max"),
    )
    return base.join(exact_percentiles(j, ["label"], "distance", {"median": 0.5}), "label")


def _box_gap2(far: bool) -> Column:
    """Squared distance between two boxes, at the nearest or at the farthest places."""
    total = F.lit(0.0)
    for x in AXES:
        up, down = F.col(f"_b_hi_{x}") - F.col(f"lo_{x}"), F.col(f"hi_{x}") - F.col(f"_b_lo_{x}")
        d = F.greatest(F.abs(up), F.abs(down)) if far else F.greatest(-up, -down, F.lit(0.0))
        total = total + d * d
    return total


def dbscan(
    points: DataFrame,
    eps: float | dict[int, float],
    min_samples: int = 3,
    by: Sequence[str] = ("sample_id", "label"),
) -> DataFrame:
    """(by.., point_id, cluster): the lowest core id of the cluster, -1 for noise.

    ``eps`` may depend on ``label``. A border point joins the lowest-numbered cluster
    with a core point in reach. Neighbours include the point itself. Points without finite
    coordinates, and labels without an eps, are noise.

    Points share cells whose diagonal is eps, so a cell's core points are one cluster and a
    cell with ``min_samples`` points has nothing but core points. The graph has cells for
    vertices; two cells are linked if their nearest core points are within eps. No list of
    neighbours is made, however many points lie within one eps. Clouds that fit a task are
    worked on whole instead.
    """
    by = list(by)
    if celltree.fits_task(points, points, by):
        return _dbscan_whole(points, eps, min_samples, by)
    if isinstance(eps, dict):
        pairs = [F.lit(v) for label, r in eps.items() for v in (label, float(r))]
        radius = F.create_map(*pairs)[F.col("label")]
    else:
        radius = F.lit(float(eps))
    cell = [f"_c{i}" for i in range(3)]
    side = F.col("_r") / math.sqrt(3.0) * (1 - 1e-9)
    p = points.withColumn("_r", radius).filter(celltree.finite(AXES) & F.col("_r").isNotNull())
    p = p.select(*by, "point_id", "_r", *[F.col(x).cast("double").alias(x) for x in AXES])
    p = cut_lineage(p.withColumns({c: F.floor(F.col(x) / side) for c, x in zip(cell, AXES)}))

    # core points: all of a full cell, and others whose min_samples-th neighbour is in reach
    full = p.groupBy(*by, *cell).agg(F.count(F.lit(1)).alias("_n"))
    p = cut_lineage(p.join(full.withColumn("_full", F.col("_n") >= min_samples), [*by, *cell]).drop("_n"))
    farthest = max(eps.values()) if isinstance(eps, dict) else float(eps)
    near = celltree.nearest(p.filter("not _full"), p, min_samples, by, ["point_id"], "point_id", farthest=farthest)
    near = near.filter(F.col("rank") == min_samples).select(*by, "point_id", F.col("d2").alias("_k2"))
    p = p.join(near, [*by, "point_id"], "left")
    p = cut_lineage(p.withColumn("core", F.col("_full") | F.coalesce(F.col("_k2") <= F.col("_r") * F.col("_r"), F.lit(False))))

    core = p.filter("core")
    edges = [f(F.col(x)).alias(f"{n}_{x}") for n, f in (("lo", F.min), ("hi", F.max)) for x in AXES]
    cells = core.groupBy(*by, *cell).agg(F.min("point_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("_r").alias("_r"), *edges)
    cells = cut_lineage(cells)
    around = [F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)).alias(c) for c in cell]

    def neighbours(df: DataFrame) -> DataFrame:
        for c, e in zip(cell, around):
            df = df.withColumn(c, e)
        return df

    other = cells.select(*by, *cell, F.col("node").alias("other"), F.col("n").alias("m"), *[F.col(f"{n}_{x}").alias(f"_b_{n}_{x}") for n in ("lo", "hi") for x in AXES])
    # the cell with fewer points asks
    asks = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("other")))
    meet = neighbours(cells).join(other.hint("merge"), [*by, *cell]).filter(asks)
    r2 = F.col("_r") * F.col("_r")
    meet = cut_lineage(meet.filter(_box_gap2(False) <= r2).select(*by, "node", "other", (_box_gap2(True) <= r2).alias("sure")))
    targets = cut_lineage(core.join(cells.select(*by, *cell, "node"), [*by, *cell]).select(*by, "node", "point_id", "_r", *AXES))
    queries = targets.join(meet.filter("not sure").select(*by, "node", "other"), [*by, "node"])

    def in_reach(asking: DataFrame) -> DataFrame:
        """(by.., other, point_id, _r) of points that have a core point of cell ``other`` within eps."""
        near = celltree.nearest(
            asking, targets.withColumnRenamed("node", "other"), 1, [*by, "other"], ["point_id", "_r", "node"], "point_id", farthest=farthest
        )
        return near.filter(F.col("d2") <= F.col("_r") * F.col("_r"))

    links = in_reach(queries).select(*by, F.col("node").alias("a"), F.col("other").alias("b"))
    links = links.unionByName(meet.filter("sure").select(*by, F.col("node").alias("a"), F.col("other").alias("b"))).distinct()
    comp = cut_lineage(components(cells.select(*by, "node"), links, by, "node"))

    own = targets.select(*by, "point_id", "node").join(comp, [*by, "node"]).select(*by, "point_id", F.col("component").alias("_own"))
    border = neighbours(p.filter("not core").select(*by, *cell, "point_id", "_r", *AXES))
    border = border.join(other.select(*by, *cell, "other").hint("merge"), [*by, *cell]).withColumn("node", F.lit(0))
    reached = in_reach(border).select(*by, "point_id", F.col("other").alias("node")).join(comp, [*by, "node"])
    reached = reached.groupBy(*by, "point_id").agg(F.min("component").alias("_border"))
    out = points.select(*by, "point_id").join(own, [*by, "point_id"], "left").join(reached, [*by, "point_id"], "left")
    return out.select(
        *by, "point_id", F.coalesce("_own", "_border", F.lit(-1)).cast("bigint").alias("cluster")
    )


def _dbscan_whole(points: DataFrame, eps: float | dict[int, float], min_samples: int, by: list[str]) -> DataFrame:
    """``dbscan`` of clouds that fit a task, in one visit of Python."""
    import pyarrow as pa

    if isinstance(eps, dict):
        radius = F.create_map(*[F.lit(v) for label, r in eps.items() for v in (label, float(r))])[F.col("label")]
        farthest = float(max(eps.values()))
    else:
        radius, farthest = F.lit(float(eps)), float(eps)
    ok = celltree.finite(AXES) & F.col("_r").isNotNull()
    p = points.withColumn("_r", radius)
    p = p.select(*by, "point_id", "_r", *[F.col(x).cast("double").alias(x) for x in AXES], F.coalesce(ok, F.lit(False)).alias("_ok"))
    schema = T.StructType([*[p.schema[c] for c in (*by, "point_id")], T.StructField("cluster", T.LongType())])

    def run(rows):
        n, cloud = rows.num_rows, celltree.clouds_of(rows)[1]
        xyz = [rows.column(c).to_numpy(zero_copy_only=False) for c in AXES]
        r = rows.column("_r").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(rows.column("_ok").to_numpy(zero_copy_only=False))

        def near():
            for i, j, d2 in celltree.pairs_within(cloud, xyz, own, own, farthest):
                within = d2 <= r[i] * r[i]
                yield i[within], j[within]

        count = np.zeros(n, dtype=np.int64)
        for i, _ in near():
            count += np.bincount(i, minlength=n)
        core, root = count >= min_samples, np.arange(n)
        # rows lie by id, so the first row of a component has its lowest id
        for i, j in near():
            both = core[i] & core[j] & (i < j)
            root = united(n, root[i[both]], root[j[both]])[root]
        cluster = np.where(core, root, n)
        for i, j in near():
            edge = ~core[i] & core[j]
            np.minimum.at(cluster, i[edge], root[j[edge]])
        ids = rows.column("point_id").to_numpy().astype(np.int64)
        out = np.where(cluster < n, ids[np.minimum(cluster, n - 1)], -1)
        yield pa.table([*[rows.column(c) for c in (*by, "point_id")], pa.array(out)], names=schema.fieldNames())

    return celltree.whole_clouds(p, by, ["point_id"], run, schema)


def statistical_outliers(
    points: DataFrame, k: int, ratio: float, by: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Points with their mean distance to k neighbours (itself included) and ``keep``:
    below the cloud's mean + ratio * sample std."""
    near = nearest_point(points, points, k, by, ["point_id"])
    mean = near.groupBy(*by, "point_id").agg(F.avg("distance").alias("mean_distance"))
    stats = mean.groupBy(*by).agg(
        F.avg("mean_distance").alias("_m"), F.stddev_samp("mean_distance").alias("_s")
    )
    limit = F.col("_m") + ratio * F.coalesce(F.col("_s"), F.lit(0.0))
    return mean.join(stats.hint("merge"), list(by)).withColumn("keep", F.col("mean_distance") <= limit).drop(
        "_m", "_s"
    )


def densify(
    points: DataFrame, target: int, frac: float, seed: int, by: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Replicate points with spacing-scaled jitter until a cloud has ``target`` points."""
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("_n")]
    extent = sum(((F.max(a) - F.min(a)) for a in AXES[1:]), F.max(AXES[0]) - F.min(AXES[0])) / 3.0
    size = points.groupBy(*by).agg(*aggs, extent.alias("_e"))
    n = F.col("_n")
    d = row_index(points, by, ["point_id"], "_i").join(size, by)
    reps = F.greatest(F.ceil(F.lit(target) / n), F.lit(1)).cast("int")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), reps - 1)))
    d = d.filter((F.col("copy") == 0) | (F.col("copy") * n + F.col("_i") < target))
    std = frac * F.col("_e") / F.greatest(F.pow(n.cast("double"), F.lit(1.0 / 3.0)), F.lit(1.0))
    moved = {
        a: F.col(a)
        + F.when(F.col("copy") > 0, std * normal(f"{seed}/{a}", *by, "point_id", "copy")).otherwise(0.0)
        for a in AXES
    }
    return d.withColumns(moved).drop("_i", "_n", "_e")


def augment_cloud(points: DataFrame, seed: int, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per cloud a turn about Z and a scale in 0.8..1.2, per point a jitter of 0.01."""
    theta = uniform(f"{seed}/turn", *by) * (2.0 * math.pi)
    scale = 0.8 + 0.4 * uniform(f"{seed}/scale", *by)
    x, y, z = (F.col(a) for a in AXES)
    turned = {
        "px": (F.cos(theta) * x - F.sin(theta) * y) * scale,
        "py": (F.sin(theta) * x + F.cos(theta) * y) * scale,
        "pz": z * scale,
    }
    return points.withColumns(
        {a: v + 0.01 * normal(f"{seed}/{a}", *by, "point_id") for a, v in turned.items()}
    )


def distance_preservation(
    points: DataFrame, pairs: int, seed: int, clip: str = "clip", frame: str = "frame"
) -> DataFrame:
    """Relative change of sampled pair distances against the first frame of each clip.

    Pairs are drawn with replacement by hash; point ids have to be 0..n-1.
    """
    sizes = points.groupBy(clip).agg(
        (F.max("point_id") + 1).alias("_n"), F.min(frame).alias("_f0")
    )
    draw = sizes.select(clip, "_n", "_f0", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("pair"))
    draw = draw.select(
        clip,
        "_f0",
        "pair",
        F.floor(uniform(f"{seed}/i", clip, "pair") * F.col("_n")).cast("int").alias("i"),
        F.floor(uniform(f"{seed}/j", clip, "pair") * F.col("_n")).cast("int").alias("j"),
    )
    p = points.select(clip, frame, "point_id", *AXES)
    a = p.withColumnRenamed("point_id", "i")
    b = p.select(clip, frame, F.col("point_id").alias("j"), *[F.col(x).alias(f"_b_{x}") for x in AXES])
    d = draw.join(a.hint("merge"), [clip, "i"]).join(b.hint("merge"), [clip, frame, "j"]).withColumn("_d", F.sqrt(_dist2()))
    first = d.filter(F.col(frame) == F.col("_f0")).select(clip, "pair", F.col("_d").alias("_d0"))
    rel = F.abs(F.col("_d") - F.col("_d0")) / (F.col("_d0") + 1e-8)
    per = d.join(first.hint("merge"), [clip, "pair"]).groupBy(clip, frame).agg(F.avg(rel).alias("_r"))
    return per.groupBy(clip).agg(
        F.avg("_r").alias("mean_relative_change"), F.max("_r").alias("max_relative_change")
    )
