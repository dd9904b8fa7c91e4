"""Queries of the blob and mask operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions import colour
from pixelmill.operators import blobs as bl
from pixelmill.operators import topk as tk
from pixelmill.operators.recode import depth_window_normalise
from pixelmill.plans.digest import digest, digest_sql
from pixelmill.plans.fixtures import PIX, WIDE, H, W, pixels, wide_pixels
from pixelmill.plans.recode import DEPTHNORM
from pixelmill.plans.registry import query, r6, r9
from pixelmill.plans.windows import EL2, SQ1, _morph_sql, dist_sql


def _round(df, f, *cols):
    return df.withColumns({c: f(F.col(c)) for c in cols})


def cc_sql(mask: str, reach: int = 1, p: str = "c", source: str = "pix") -> str:
    """CTEs {p}ru (runs with blob) and {p}px (pixels with blob); needs WITH RECURSIVE."""
    return f"""{p}r0 AS (SELECT frame_id, y, x, x - row_number() OVER (PARTITION BY frame_id, y ORDER BY x) AS k FROM {source} WHERE {mask}),
    {p}r1 AS MATERIALIZED (SELECT frame_id, y, min(x) AS s, max(x) AS e, CAST(y*65536 + min(x) AS BIGINT) AS node FROM {p}r0 GROUP BY frame_id, y, k),
    {p}e0 AS (SELECT a.frame_id, a.node AS a, b.node AS b FROM {p}r1 a JOIN {p}r1 b ON b.frame_id = a.frame_id AND b.y = a.y + 1
      AND b.s <= a.e + {reach} AND b.e >= a.s - {reach}),
    {p}ed AS MATERIALIZED (SELECT * FROM {p}e0 UNION ALL SELECT frame_id, b, a FROM {p}e0),
    {p}reach(frame_id, node, root) AS (SELECT frame_id, node, node FROM {p}r1 UNION
      SELECT e.frame_id, e.b, r.root FROM {p}reach r JOIN {p}ed e ON e.frame_id = r.frame_id AND e.a = r.node),
    {p}comp AS (SELECT frame_id, node, min(root) AS blob FROM {p}reach GROUP BY ALL),
    {p}ru AS (SELECT r.*, blob FROM {p}r1 r JOIN {p}comp USING (frame_id, node)),
    {p}px AS (SELECT frame_id, y, CAST(unnest(range(s, e + 1)) AS INTEGER) AS x, blob FROM {p}ru)"""


@query(
    "B1",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')} SELECT frame_id, blob, count(*) AS px, CAST(sum(y*37 + x) AS BIGINT) AS place FROM cpx GROUP BY ALL""",
)
def connected_components(spark, sf):
    d = bl.connected_components(pixels(spark, sf), F.col("gt") == 1)
    return d.groupBy("frame_id", "blob").agg(
        F.count(F.lit(1)).alias("px"),
        F.sum(F.col("y") * 37 + F.col("x")).cast("bigint").alias("place"),
    )


@query(
    "B1",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1', 0)} SELECT frame_id, count(DISTINCT blob) AS blobs, count(*) AS px FROM cpx GROUP BY frame_id""",
)
def connected_components_4(spark, sf):
    runs = bl.blob_runs(pixels(spark, sf), F.col("gt") == 1, 4)
    return runs.groupBy("frame_id").agg(
        F.count_distinct("blob").alias("blobs"),
        F.sum(F.col("stop") - F.col("start") + 1).alias("px"),
    )


FP = "pred_a = 2 AND gt <> 2"
STATS = """st AS (SELECT frame_id, blob, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cpx GROUP BY ALL),
    bs AS (SELECT *, y1-y0+1 AS h, x1-x0+1 AS w, area/((y1-y0+1)*(x1-x0+1)) AS fill, greatest(y1-y0+1, x1-x0+1)/least(y1-y0+1, x1-x0+1) AS elong FROM st)"""


def _some(spark, sf, *cols):
    """Pixels with only some columns: all that is there goes through Python."""
    return pixels(spark, sf).select("frame_id", "y", "x", *cols)


def _fp():
    return (F.col("pred_a") == 2) & (F.col("gt") != 2)


@query(
    "B2",
    f"""WITH RECURSIVE {PIX}, {cc_sql(FP)}, {STATS} SELECT frame_id, blob, area, y0, y1, x0, x1, h, w, round(fill, 9) AS fill, round(elong, 9) AS elong FROM bs""",
)
def blob_stats(spark, sf):
    return _round(bl.blob_stats(bl.blob_runs(pixels(spark, sf), _fp())), r9, "fill", "elong")


@query(
    "K3",
    f"""WITH RECURSIVE {PIX}, {cc_sql(FP)}, {STATS} SELECT frame_id, array_to_string(list_sort(list(area), 'DESC')[1:5], ',') AS top_areas,
      count(*) AS blobs, CAST(sum(area) AS BIGINT) AS px FROM bs GROUP BY frame_id""",
)
def top_blobs(spark, sf):
    out = tk_top(spark, sf)
    return out.withColumn("top_areas", F.array_join("top_areas", ","))


def tk_top(spark, sf):
    return bl.top_blobs(bl.blob_runs(pixels(spark, sf), _fp()), 5)


# Sorted first: the other engine fails now and then on joining unnested rows as they come.
RECALL = """rc AS (SELECT frame_id, blob, count(*) AS area, count(*) FILTER (pred_a = 2) AS hit, count(*) FILTER (pred_a = 0) AS lost_0,
      count(*) FILTER (pred_a = 1) AS lost_1 FROM (SELECT * FROM cpx ORDER BY frame_id, y, x) JOIN pix USING (frame_id, y, x) GROUP BY ALL), br AS (SELECT *, hit/area AS recall FROM rc)"""


def _recall(spark, sf):
    return bl.blob_recall(pixels(spark, sf), 2, pred="pred_a")


@query(
    "B3",
    f"WITH RECURSIVE {PIX}, {cc_sql('gt = 2')}, {RECALL} SELECT frame_id, blob, area, hit, lost_0, lost_1, round(recall, 9) AS recall FROM br",
)
def blob_recall(spark, sf):
    return _round(_recall(spark, sf), r9, "recall")


@query(
    "B3",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 2')}, {RECALL} SELECT count(*) AS blobs, count(*) FILTER (recall < 0.05) AS fully_missed,
      count(*) FILTER (recall < 0.5) AS mostly_missed, count(*) FILTER (recall >= 0.8) AS well_detected, round(avg(recall), 9) AS mean_recall,
      CAST(sum(lost_0) AS BIGINT) AS lost_0, CAST(sum(lost_1) AS BIGINT) AS lost_1,
      {', '.join(f"round(quantile_cont(area::DOUBLE, {q / 100}), 9) AS area_p{q:02d}" for q in (5, 25, 50, 75, 95))} FROM br""",
)
def blob_recall_summary(spark, sf):
    out = bl.blob_recall_summary(_recall(spark, sf))
    return _round(out, r9, "mean_recall", *[c for c in out.columns if c.startswith("area_p")])


def _by_area(names: list[str]) -> str:
    """Sums per number of a bucket, with its name."""
    return f"""SELECT {names!r}[b + 1] AS bucket, count(*) AS blobs, round(avg(area), 9) AS mean_area, round(avg(recall), 9) AS mean_recall,
      round(sum(hit)/sum(area), 9) AS pixel_recall, count(*) FILTER (recall > 0.5) AS found FROM k GROUP BY b"""


@query(
    "B4",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')}, {RECALL.replace('pred_a = 2', 'pred_a = 1')}, q AS (SELECT quantile_cont(area::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM br),
    k AS (SELECT br.*, (area > q[1])::INTEGER + (area > q[2])::INTEGER + (area > q[3])::INTEGER AS b FROM br, q) {_by_area(['q1_smallest', 'q2', 'q3', 'q4_largest'])}""",
)
def recall_by_area_quartile(spark, sf):
    out = bl.recall_by_area(bl.blob_recall(pixels(spark, sf), 1, pred="pred_a"), "quartile")
    return _round(out, r9, "mean_area", "mean_recall", "pixel_recall")


@query(
    "B4",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')}, {RECALL.replace('pred_a = 2', 'pred_a = 1')},
    k AS (SELECT *, {' + '.join(f'(area >= {e})::INTEGER' for e in bl.SIZE_EDGES[1:])} AS b FROM br) {_by_area(bl.SIZE_LABELS)}""",
)
def recall_by_size_bucket(spark, sf):
    out = bl.recall_by_area(bl.blob_recall(pixels(spark, sf), 1, pred="pred_a"), "fixed")
    return _round(out, r9, "mean_area", "mean_recall", "pixel_recall")


@query(
    "B5",
    f"""WITH RECURSIVE {PIX}, {cc_sql('pred_a = 2')}, {STATS}, k AS (SELECT frame_id, y, x FROM cpx JOIN bs USING (frame_id, blob) WHERE area >= 4),
    d AS (SELECT pix.frame_id, pix.y, pix.x, CAST(k.frame_id IS NOT NULL AS INTEGER) AS kept FROM pix LEFT JOIN k USING (frame_id, y, x)) """
    + digest_sql("d", "frame_id", ["kept"]),
)
def drop_small(spark, sf):
    return digest(bl.drop_small(_some(spark, sf, "pred_a"), F.col("pred_a") == 2, 4), ["frame_id"], ["kept"])


EL1 = "(SELECT e.dy, b.range AS dx FROM (VALUES (-1, 0), (0, 1), (1, 0)) e(dy, hw), range(-1, 2) b WHERE abs(b.range) <= e.hw) o"


@query(
    "B6",
    f"""WITH {PIX}, m0 AS (SELECT frame_id, y, x, CAST(gt = 2 AS INTEGER) AS m FROM pix),
    {_morph_sql('d1', 'm0', 'dilate', EL1)}, {_morph_sql('e1', 'm0', 'erode', EL1)}, {_morph_sql('d2', 'm0', 'dilate', EL2)}, {_morph_sql('e2', 'm0', 'erode', EL2)},
    b AS (SELECT CAST(1 AS INTEGER) AS k, d1.frame_id, d1.y, d1.x, d1.m = 1 AND e1.m = 0 AS inn FROM d1 JOIN e1 USING (frame_id, y, x)
      UNION ALL SELECT 2, d2.frame_id, d2.y, d2.x, d2.m = 1 AND e2.m = 0 FROM d2 JOIN e2 USING (frame_id, y, x)),
    s AS (SELECT set_id, k, count(*) FILTER (gt <> pred_a AND (gt = 2 OR pred_a = 2) AND inn) AS err_in, count(*) FILTER (gt <> pred_a AND (gt = 2 OR pred_a = 2) AND NOT inn) AS err_out,
      count(*) FILTER (gt = 2 AND inn) AS gt_in, count(*) FILTER (gt = 2 AND NOT inn) AS gt_out FROM b JOIN pix USING (frame_id, y, x) GROUP BY ALL)
    SELECT *, round(coalesce(err_in/nullif(err_in+err_out,0), 0.0), 9) AS err_share, round(coalesce(gt_in/nullif(gt_in+gt_out,0), 0.0), 9) AS gt_share FROM s""",
)
def boundary_band_errors(spark, sf):
    out = bl.band_errors(pixels(spark, sf), 2, [1, 2], pred="pred_a", by=["set_id"])
    return _round(out, r9, "err_share", "gt_share")


@query(
    "B7",
    f"""WITH {PIX}, m0 AS (SELECT frame_id, y, x, CAST(gt = 2 AS INTEGER) AS m FROM pix),
    {_morph_sql('d1', 'm0', 'dilate', SQ1)}, {_morph_sql('d2', 'd1', 'dilate', SQ1)}
    SELECT frame_id, count(r) AS ring_px, median(r)::DOUBLE AS ring_median FROM d2 JOIN d1 USING (frame_id, y, x) JOIN pix USING (frame_id, y, x)
    WHERE d2.m = 1 AND d1.m = 0 GROUP BY frame_id""",
)
def ring_median(spark, sf):
    return bl.ring_median(pixels(spark, sf), F.col("gt") == 2, "r", 2, 1)


RINGGATE = f"""m0 AS (SELECT frame_id, y, x, CAST(gt = 2 AND depth_mm > 0 AS INTEGER) AS m FROM pix),
    {_morph_sql('d1', 'm0', 'dilate', SQ1)}, {_morph_sql('d2', 'd1', 'dilate', SQ1)}, {_morph_sql('d3', 'd2', 'dilate', SQ1)},
    z AS (SELECT dn.frame_id, gt = 2 AND depth_mm > 0 AS t, gt = 1 AND depth_mm > 0 AS a, d3.m = 1 AND m0.m = 0 AS ri, depth_norm FROM dn JOIN d3 USING (frame_id, y, x) JOIN m0 USING (frame_id, y, x)),
    f AS (SELECT frame_id, count(*) FILTER (t) AS target_px, count(*) FILTER (a) AS around_px, count(*) FILTER (a AND ri) AS ring_px,
      median(depth_norm) FILTER (t) AS mt, median(depth_norm) FILTER (a) AS ma, median(depth_norm) FILTER (a AND ri) AS mr FROM z GROUP BY frame_id),
    fr AS (SELECT frame_id, target_px, around_px, ring_px, abs(mt - CASE WHEN ring_px >= 5 THEN mr ELSE ma END)::DOUBLE AS margin FROM f WHERE target_px >= 10 AND around_px >= 10)"""


def _ring_frames(spark, sf):
    px = depth_window_normalise(pixels(spark, sf), F.col("gt") > 0)
    return bl.ring_contrast_frames(
        px, F.col("gt") == 2, F.col("gt") == 1, "depth_norm", 3, 10, 5, valid=F.col("depth_mm") > 0
    )


@query("B8", f"WITH {PIX}, {DEPTHNORM}, {RINGGATE} SELECT * FROM fr")
def ring_contrast_frames(spark, sf):
    return _ring_frames(spark, sf)


@query(
    "B8",
    f"""WITH {PIX}, {DEPTHNORM}, {RINGGATE}, o AS (SELECT median(margin/255.0::DOUBLE) AS v FROM fr)
    SELECT 'ring_contrast' AS gate, 'all' AS "group", round(v, 9) AS observed, 0.05::DOUBLE AS threshold,
      CAST(CASE WHEN v >= 0.05 THEN 0 ELSE 1 END AS BIGINT) AS n_bad, v >= 0.05 AS passed FROM o""",
)
def ring_contrast_gate(spark, sf):
    return _round(bl.ring_contrast_gate(_ring_frames(spark, sf)), r9, "observed")


RIDGE = f"""{dist_sql('inn', 'gt <> 1', 'gt = 1')},
    ri AS (SELECT a.frame_id, a.y, a.x, sqrt(a.d2) AS d, max(sqrt(b.d2)) AS top FROM inn a JOIN inn b ON b.frame_id = a.frame_id AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY ALL),
    rg AS (SELECT frame_id, y, x, d FROM ri WHERE d >= top - 1e-6)"""


@query(
    "B9",
    f"""WITH {PIX}, {RIDGE} SELECT frame_id, count(*) AS ridge_px, round(median(2*d), 9) AS median_width, round(max(2*d), 9) AS max_width,
      count(*) FILTER (2*d < 4) AS thin_px FROM rg GROUP BY frame_id""",
)
def local_width(spark, sf):
    d = bl.local_width(_some(spark, sf, "gt"), F.col("gt") == 1)
    w = F.col("width")
    return d.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("ridge_px"),
        r9(F.median(w)).alias("median_width"),
        r9(F.max(w)).alias("max_width"),
        F.count_if(w < 4).alias("thin_px"),
    )


@query(
    "B10",
    f"""WITH {PIX}, {RIDGE}, q AS (SELECT a.frame_id, a.y, a.x, min((((a.y-s.y)*(a.y-s.y) + (a.x-s.x)*(a.x-s.x))::BIGINT << 40) + (s.y::BIGINT << 20) + s.x) AS q
      FROM inn a JOIN rg s ON s.frame_id = a.frame_id GROUP BY ALL)
    SELECT q.frame_id, count(*) AS px, round(sum(2*s.d*(q.y*37 + q.x + 1)), 6) AS weighted FROM q JOIN rg s ON s.frame_id = q.frame_id AND s.y = ((q >> 20) & 1048575) AND s.x = (q & 1048575) GROUP BY q.frame_id""",
)
def width_of_nearest_ridge(spark, sf):
    d = bl.width_of_nearest_ridge(_some(spark, sf, "gt"), F.col("gt") == 1)
    place = F.col("y") * 37 + F.col("x") + 1
    return d.filter(F.col("width").isNotNull()).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("px"), r6(F.sum(F.col("width") * place)).alias("weighted")
    )


# the nearest pixel outside comes from the nearest one of each column: exact, by another way
WIDE_RIDGE = f"""{WIDE}, wc AS (SELECT *, max(CASE WHEN v = 0 THEN y END) OVER (PARTITION BY frame_id, x ORDER BY y) AS up,
      min(CASE WHEN v = 0 THEN y END) OVER (PARTITION BY frame_id, x ORDER BY y DESC) AS dn FROM wide),
    wg AS (SELECT frame_id, y, x, v, least(y - up, dn - y) AS gap FROM wc),
    wi AS (SELECT t.frame_id, t.y, t.x, sqrt(min(s.gap*s.gap + (t.x-s.x)*(t.x-s.x))) AS d FROM wg t JOIN wg s ON s.frame_id = t.frame_id AND s.y = t.y AND s.gap IS NOT NULL
      WHERE t.v = 1 GROUP BY ALL),
    wt AS (SELECT a.frame_id, a.y, a.x, a.d, max(b.d) AS top FROM wi a JOIN wi b ON b.frame_id = a.frame_id AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY ALL)"""


@query(
    "B9",
    f"""WITH {WIDE_RIDGE} SELECT frame_id, count(*) AS ridge_px, round(median(2*d), 9) AS median_width, round(max(2*d), 9) AS max_width FROM wt WHERE d >= top - 1e-6 GROUP BY frame_id""",
)
def local_width_of_wide_objects(spark, sf):
    d = bl.local_width(wide_pixels(spark, sf), F.col("v") == 1)
    w = F.col("width")
    return d.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("ridge_px"), r9(F.median(w)).alias("median_width"), r9(F.max(w)).alias("max_width")
    )


SHAPE = f"""m0 AS (SELECT frame_id, y, x, CAST(gt = 1 AS INTEGER) AS m FROM pix), {_morph_sql('er', 'm0', 'erode', EL1)},
    sh0 AS (SELECT frame_id, blob, count(*) AS area, var_samp(x::DOUBLE) AS xx, var_samp(y::DOUBLE) AS yy, covar_samp(x::DOUBLE, y::DOUBLE) AS xy, sum(er.m) AS surv FROM cpx JOIN er USING (frame_id, y, x) GROUP BY ALL),
    sh1 AS (SELECT *, (xx+yy)/2 AS h, sqrt(pow((xx-yy)/2, 2) + xy*xy) AS sp FROM sh0),
    sh AS (SELECT frame_id, blob, area, CASE WHEN area < 2 THEN 0.0 ELSE sqrt(h + sp) END AS major,
      CASE WHEN area < 2 THEN 0.5 ELSE greatest(sqrt(greatest(h - sp, 0.0)), 0.5) END AS minor, 1.0::DOUBLE - surv/area AS thin_share FROM sh1)"""


def _shape(spark, sf):
    p = bl.Pass(_some(spark, sf, "gt"), order="yx")
    on = p.mask(F.col("gt") == 1, "on")
    p.step(*bl.morph_step(on, "erode", 1, "ellipse", "core")).step(*bl.blob_step(on, 1))
    return bl.blob_shape(p.run(["gt"], only="blob"), "core")


@query(
    "B11",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')}, {SHAPE} SELECT frame_id, blob, area, round(major, 6) AS major, round(minor, 6) AS minor,
      round(CASE WHEN area < 2 THEN 1.0 ELSE major/minor END, 6) AS axis_ratio, round(4*major, 6) AS long_axis, round(thin_share, 9) AS thin_share FROM sh""",
)
def blob_shape(spark, sf):
    out = _round(_shape(spark, sf), r6, "major", "minor", "axis_ratio", "long_axis")
    return _round(out, r9, "thin_share")


# Every direction between two run ends of a blob; the least rectangle lies along one of them.
RECT = """pt AS MATERIALIZED (SELECT DISTINCT frame_id, blob, y, x FROM (SELECT frame_id, blob, y, s AS x FROM cru UNION ALL SELECT frame_id, blob, y, e FROM cru)),
    dr AS MATERIALIZED (SELECT DISTINCT a.frame_id, a.blob, (b.x - a.x) // g AS dx, (b.y - a.y) // g AS dy FROM pt a JOIN pt b ON b.frame_id = a.frame_id AND b.blob = a.blob AND (b.y, b.x) > (a.y, a.x),
      LATERAL (SELECT gcd(b.x - a.x, b.y - a.y) AS g)),
    ex AS (SELECT dr.frame_id, dr.blob, dx*dx + dy*dy AS d2, max(x*dx + y*dy) - min(x*dx + y*dy) AS u, max(y*dx - x*dy) - min(y*dx - x*dy) AS v FROM dr JOIN pt USING (frame_id, blob) GROUP BY dr.frame_id, dr.blob, dx, dy),
    bx AS (SELECT frame_id, blob, greatest(u, v)/sqrt(d2) AS l, least(u, v)/sqrt(d2) AS s FROM ex
      QUALIFY row_number() OVER (PARTITION BY frame_id, blob ORDER BY (u*v)/d2, (greatest(u, v)*greatest(u, v))/d2 DESC) = 1),
    ba AS (SELECT frame_id, blob, count(*) AS area FROM cpx GROUP BY frame_id, blob),
    rect AS (SELECT ba.frame_id, ba.blob, area, coalesce(l, 0.0) AS l, coalesce(s, 0.0) AS s FROM ba LEFT JOIN bx ON bx.frame_id = ba.frame_id AND bx.blob = ba.blob)"""


@query(
    "B15",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')}, {RECT} SELECT frame_id, blob, area, round(l, 9) AS rect_long, round(s, 9) AS rect_short FROM rect""",
)
def least_rectangles(spark, sf):
    out = bl.outlines(pixels(spark, sf), F.col("gt") == 1).drop("contour")
    return _round(out, r9, "rect_long", "rect_short")


@query(
    "B15",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')}, {RECT}, k AS (SELECT frame_id, area, CASE WHEN l/greatest(s, 1) >= 3 AND area/greatest(l, 1) <= 10 THEN 1 ELSE 0 END AS wire FROM rect),
    g AS (SELECT frame_id + 0 AS frame_id, wire + 0 AS wire, count(*) AS blobs, CAST(sum(area) AS BIGINT) AS px FROM k GROUP BY ALL)
    SELECT frame_id, CASE wire WHEN 1 THEN 'wirelike' ELSE 'blob' END AS kind, blobs, px FROM g""",
)
def wirelike_blobs(spark, sf):
    out = bl.wirelike_blobs(bl.outlines(pixels(spark, sf), F.col("gt") == 1))
    return out.groupBy("frame_id", "kind").agg(
        F.count(F.lit(1)).alias("blobs"), F.sum("area").alias("px")
    )


FPD = f"""{dist_sql('fd', 'gt = 2', FP)}, fe AS (SELECT pix.*, sqrt(d2) AS dist FROM pix LEFT JOIN fd USING (frame_id, y, x) WHERE {FP})"""


@query(
    "B12",
    f"""WITH {PIX}, {FPD} SELECT set_id, count(*) FILTER (dist < 3) AS near, count(*) FILTER (dist >= 3 AND dist <= 10) AS mid,
      count(*) FILTER (dist > 10) AS far, count(*) FILTER (dist IS NULL) AS no_truth, round(avg(dist), 9) AS mean_dist FROM fe GROUP BY set_id""",
)
def error_distance_buckets(spark, sf):
    out = bl.error_distance_buckets(_some(spark, sf, "gt", "pred_a", "set_id"), _fp(), F.col("gt") == 2, 3, 10, ["set_id"])
    return _round(out, r9, "mean_dist")


@query(
    "B12",
    f"""WITH {PIX}, {FPD}, e AS (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS bin, lo, hi FROM (VALUES (0.0::DOUBLE, 1.0::DOUBLE), (1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (5.0, 8.0), (8.0, 12.0), (12.0, 20.0), (20.0, 40.0), (40.0, 1e9)) v(lo, hi))
    SELECT bin, lo, hi, (SELECT count(*) FROM fe WHERE dist >= lo AND dist < hi) AS n FROM e""",
)
def error_distance_histogram(spark, sf):
    from pixelmill.operators.stats import histogram

    d = bl.error_distance(_some(spark, sf, "gt", "pred_a"), _fp(), F.col("gt") == 2)
    return histogram(d, "dist", [0, 1, 2, 3, 5, 8, 12, 20, 40, 1e9])


@query(
    "B13",
    f"""WITH {PIX}, {FPD} SELECT camera, count(*) AS fp, count(*) FILTER (dist <= 5) AS halo, count(*) - count(*) FILTER (dist <= 5) AS standalone,
      round(count(*) FILTER (dist <= 5)/count(*), 9) AS halo_share FROM fe GROUP BY camera""",
)
def halo_split(spark, sf):
    out = bl.halo_split(_some(spark, sf, "gt", "pred_a", "camera"), _fp(), F.col("gt") == 2, 5, ["camera"])
    return _round(out, r9, "halo_share")


@query(
    "B14",
    f"""WITH RECURSIVE {PIX}, {FPD}, {cc_sql(FP)}, {STATS}, j AS (SELECT c.frame_id, c.blob, dist, 0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b AS luma,
      CASE WHEN greatest(b,g,r) = 0 THEN 0.0 ELSE 255.0::DOUBLE*(greatest(b,g,r) - least(b,g,r))/greatest(b,g,r) END AS sat FROM cpx c JOIN fe USING (frame_id, y, x)),
    k AS (SELECT frame_id, blob, count(*) FILTER (dist <= 5)/count(*) AS hs, median(coalesce(dist, 1e9)) AS md, median(luma) AS ml, median(sat) AS ms FROM j GROUP BY ALL),
    t AS (SELECT area, CASE WHEN hs >= 0.5 OR md <= 5 THEN 'near_wire_halo' WHEN elong > 4 AND fill < 0.35 THEN 'structured_edge'
      WHEN ml > 150 AND ms < 60 THEN 'bright_pale_bg' ELSE 'busy_texture' END AS mode FROM k JOIN bs USING (frame_id, blob))
    SELECT mode, count(*) AS blobs, CAST(sum(area) AS BIGINT) AS mass FROM t GROUP BY mode""",
)
def classify_fp_modes(spark, sf):
    p = bl.Pass(_some(spark, sf, "b", "g", "r", "gt", "pred_a"), order="yx")
    p.nearest(p.mask(F.col("gt") == 2, "truth"), {}).step(*bl.blob_step(p.mask(_fp(), "fp"), 1))
    labelled = p.run(["gt", "pred_a", "_edt_y", "_edt_x"], only="blob")
    c = colour.hsv()
    labelled = labelled.withColumns(
        {"dist": F.sqrt(F.col("_edt_d2").cast("double")), "luma": colour.luma(), "sat": 255.0 * c["sat"]}
    )
    d = F.coalesce(F.col("dist"), F.lit(1e9))  # no truth in the frame
    blobs = labelled.groupBy("frame_id", "blob").agg(
        F.count(F.lit(1)).alias("area"),
        (F.count_if(F.col("dist") <= 5) / F.count(F.lit(1))).alias("halo_share"),
        F.median(d).alias("median_dist"),
        F.median("luma").alias("median_luma"),
        F.median("sat").alias("median_sat"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        (F.max("x") - F.min("x") + 1).alias("w"),
    )
    h, w = F.col("h"), F.col("w")
    blobs = blobs.withColumns(
        {"fill": F.col("area") / (h * w), "elong": F.greatest(h, w) / F.least(h, w)}
    )
    return bl.mode_mass(bl.classify_fp_modes(blobs))


# Steps of the border in each 2 x 2 square, and the background region they lie on.
OUTLINE = f"""gr AS MATERIALIZED (SELECT f.frame_id, CAST(gy.y AS INTEGER) AS y, CAST(gx.x AS INTEGER) AS x FROM (SELECT DISTINCT frame_id FROM pix) f, (SELECT unnest(range({H} + 2)) AS y) gy, (SELECT unnest(range({W} + 2)) AS x) gx),
    fg AS MATERIALIZED (SELECT frame_id, y + 1 AS y, x + 1 AS x, blob FROM cpx),
    bg AS MATERIALIZED (SELECT gr.* FROM gr ANTI JOIN fg USING (frame_id, y, x)), {cc_sql('TRUE', 0, 'v', 'bg')},
    ce AS MATERIALIZED (SELECT gr.frame_id, gr.y, gr.x, fg.blob AS b, vpx.blob AS r FROM gr LEFT JOIN fg ON fg.frame_id = gr.frame_id AND fg.y = gr.y AND fg.x = gr.x
      LEFT JOIN vpx ON vpx.frame_id = gr.frame_id AND vpx.y = gr.y AND vpx.x = gr.x),
    sq AS (SELECT p.frame_id, coalesce(p.b, q.b, s.b, t.b) AS blob, [p.r, q.r, s.r, t.r] AS rs,
        (p.b IS NOT NULL)::INTEGER + (q.b IS NOT NULL)::INTEGER + (s.b IS NOT NULL)::INTEGER + (t.b IS NOT NULL)::INTEGER AS n, (p.b IS NULL) = (t.b IS NULL) AS diag
      FROM ce p JOIN ce q ON q.frame_id = p.frame_id AND q.y = p.y AND q.x = p.x + 1 JOIN ce s ON s.frame_id = p.frame_id AND s.y = p.y + 1 AND s.x = p.x
      JOIN ce t ON t.frame_id = p.frame_id AND t.y = p.y + 1 AND t.x = p.x + 1),
    st AS (SELECT frame_id, blob, unnest(list_filter(rs, lambda r: r IS NOT NULL)) AS r, CASE WHEN n = 2 AND NOT diag THEN 0.5 ELSE sqrt(2) END AS step FROM sq WHERE n IN (2, 3)),
    pa AS (SELECT DISTINCT c.frame_id, c.blob, o.r FROM cpx c JOIN ce o ON o.frame_id = c.frame_id AND o.y = c.blob // 65536 + 1 AND o.x = c.blob % 65536),
    ln AS (SELECT st.frame_id, st.blob, sum(step) AS contour FROM st JOIN pa ON pa.frame_id = st.frame_id AND pa.blob = st.blob AND pa.r = st.r GROUP BY st.frame_id, st.blob),
    oa AS (SELECT frame_id, blob, count(*) AS area FROM cpx GROUP BY frame_id, blob),
    ol AS (SELECT oa.frame_id, oa.blob, area, coalesce(contour, 0.0) AS contour FROM oa LEFT JOIN ln ON ln.frame_id = oa.frame_id AND ln.blob = oa.blob)"""


@query(
    "B16",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')}, {OUTLINE} SELECT frame_id, blob, area, round(contour, 6) AS contour FROM ol""",
)
def outer_contours(spark, sf):
    out = bl.outlines(pixels(spark, sf), F.col("gt") == 1).drop("rect_long", "rect_short")
    return _round(out, r6, "contour")


@query(
    "B16",
    f"""WITH RECURSIVE {PIX}, {cc_sql('gt = 1')}, {OUTLINE}, ci AS (SELECT frame_id + 0 AS frame_id, least(1.0, 4*pi()*area/(contour*contour)) AS circ FROM ol WHERE area >= 12 AND contour > 1e-6)
    SELECT frame_id, round(median(circ), 6) AS median_circ, count(*) AS blobs FROM ci GROUP BY frame_id""",
)
def circularity(spark, sf):
    out = bl.circularity_by_frame(bl.circularity(pixels(spark, sf), F.col("gt") == 1))
    return _round(out, r6, "median_circ")
