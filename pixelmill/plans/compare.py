"""Queries of the comparison and audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions.colour import COLOUR_BINS
from pixelmill.operators import compare as cp
from pixelmill.operators import metrics as m
from pixelmill.operators import windows as wi
from pixelmill.operators.blobs import width_of_nearest_ridge
from pixelmill.plans.blobs import RIDGE, cc_sql
from pixelmill.plans.fixtures import PIX, H, W, pixels
from pixelmill.plans.recode import HSV
from pixelmill.plans.registry import query, r6, r9
from pixelmill.plans.stats import COLF
from pixelmill.plans.windows import SQ1, STEN, RANGE5, _morph_sql, box_sql, dist_sql

SIZE = (H, W)


def _round(df, f, *cols):
    return df.withColumns({c: f(F.col(c)) for c in cols})


def _records(spark, sf):
    is2 = [F.col(c) == 2 for c in ("gt", "pred_a", "pred_b")]
    return cp.matched_ab(pixels(spark, sf), *is2, near=3.0, mid=10.0, by=["camera"])


def _side_sql(s: str) -> str:
    return f"""{s}st AS (SELECT frame_id, blob, count(*) AS area FROM {s}px GROUP BY ALL),
    {s}tb AS (SELECT frame_id, array_to_string(list_sort(list(area), 'DESC')[1:5], ',') AS top, count(*) AS n FROM {s}st GROUP BY frame_id)"""


AB = f"""{dist_sql('gd', 'gt = 2')}, f AS (SELECT pix.*, sqrt(d2) AS dist, gt = 2 AS tg, pred_a = 2 AS pa, pred_b = 2 AS pb FROM pix LEFT JOIN gd USING (frame_id, y, x)),
    f2 AS (SELECT *, NOT tg AND pa AND NOT pb AS rem, NOT tg AND pb AND NOT pa AS ad FROM f),
    {cc_sql('gt <> 2 AND pred_a = 2', 1, 'a')}, {_side_sql('a')}, {cc_sql('gt <> 2 AND pred_b = 2', 1, 'b')}, {_side_sql('b')},
    rec0 AS (SELECT camera, frame_id, count(*) FILTER (tg) AS gt_px, count(*) FILTER (NOT tg AND pa) AS fp_a_px, count(*) FILTER (NOT tg AND pb) AS fp_b_px,
      count(*) FILTER (rem) AS removed_fp_px, count(*) FILTER (ad) AS added_fp_px, count(*) FILTER (ad) - count(*) FILTER (rem) AS net_fp_change,
      count(*) FILTER (tg AND pa AND NOT pb) AS lost_tp_px, count(*) FILTER (tg AND NOT pa AND pb) AS gained_tp_px,
      {', '.join(f"count(*) FILTER ({s} AND {c}) AS {n}_{z}" for s, n in (('rem', 'removed'), ('ad', 'added')) for c, z in (('(dist > 10 OR dist IS NULL)', 'far'), ('dist BETWEEN 3 AND 10', 'mid'), ('dist < 3', 'near')))}
      FROM f2 GROUP BY ALL),
    rec AS (SELECT rec0.*, coalesce(atb.n, 0) AS n_fp_blobs_a, coalesce(btb.n, 0) AS n_fp_blobs_b, coalesce(atb.top, '') AS top_blobs_a, coalesce(btb.top, '') AS top_blobs_b
      FROM rec0 LEFT JOIN atb USING (frame_id) LEFT JOIN btb USING (frame_id))"""


@query("C1", f"WITH RECURSIVE {PIX}, {AB} SELECT * FROM rec")
def matched_ab(spark, sf):
    out = _records(spark, sf)
    return out.withColumns(
        {f"top_blobs_{s}": F.array_join(f"top_blobs_{s}", ",") for s in ("a", "b")}
    )


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cp.AB_COUNTS)


@query(
    "C2",
    f"""WITH RECURSIVE {PIX}, {AB} SELECT 'pooled' AS scope, 'all' AS value, count(*) AS images, {_SUMS} FROM rec
    UNION ALL SELECT 'camera', camera, count(*), {_SUMS} FROM rec GROUP BY camera""",
)
def aggregate_ab(spark, sf):
    return cp.aggregate_ab(_records(spark, sf), ["camera"])


@query(
    "C3",
    f"""WITH {PIX}, c AS (SELECT set_id <> 34 AS tr, cls, count(*) FILTER (gt = cls AND pred_a = cls)/count(*) FILTER (gt = cls OR pred_a = cls) AS iou
      FROM pix, (VALUES (0), (1), (2)) k(cls) GROUP BY ALL)
    SELECT CAST(a.cls AS INTEGER) AS cls, round(a.iou - b.iou, 9) AS gap_iou FROM c a JOIN c b ON a.cls = b.cls AND a.tr AND NOT b.tr""",
)
def generalisation_gap(spark, sf):
    px = pixels(spark, sf).withColumn("part", F.when(F.col("set_id") != 34, "train").otherwise("val"))
    cls = m.class_metrics(m.confusion(px, ["part"], pred="pred_a"), ["part"])
    out = cp.generalisation_gap(
        cls.filter("part = 'train'"), cls.filter("part = 'val'"), ["cls"], ["iou"]
    )
    return _round(out, r9, "gap_iou")


def _near_sql(h: int, w: int) -> str:
    return f"""(SELECT frame_id, t.y, t.x, CAST(gt = 2 AS INTEGER) AS m FROM (SELECT a.range AS y, b.range AS x FROM range({h}) a, range({w}) b) t
      JOIN pix ON pix.y = (t.y*24)//{h} AND pix.x = (t.x*32)//{w})"""


def _up_sql(name: str, h: int, w: int, label: str) -> str:
    return f"""SELECT set_id, '{h}x{w}' AS size, '{label}' AS method, count(*) FILTER (gt = 2 AND m = 1) AS tp, count(*) FILTER (gt <> 2 AND m = 1) AS fp,
      count(*) FILTER (gt = 2 AND m = 0) AS fn FROM pix JOIN {name} s ON s.frame_id = pix.frame_id AND s.y = (pix.y*{h})//24 AND s.x = (pix.x*{w})//32 GROUP BY set_id"""


@query(
    "C4",
    f"""WITH {PIX}, n1 AS {_near_sql(12, 16)}, n2 AS {_near_sql(9, 12)}, {_morph_sql('e1', 'n1', 'erode', SQ1)}, {_morph_sql('d1', 'n1', 'dilate', SQ1)},
    ov AS (SELECT frame_id, t.y, t.x, CAST(sum((gt=2)::INT*(least((pix.y+1)*9, (t.y+1)*24) - greatest(pix.y*9, t.y*24))*(least((pix.x+1)*12, (t.x+1)*32) - greatest(pix.x*12, t.x*32)))
        / sum((least((pix.y+1)*9, (t.y+1)*24) - greatest(pix.y*9, t.y*24))*(least((pix.x+1)*12, (t.x+1)*32) - greatest(pix.x*12, t.x*32))) >= 0.5 AS INTEGER) AS m
      FROM pix JOIN (SELECT a.range AS y, b.range AS x FROM range(9) a, range(12) b) t ON (pix.y+1)*9 > t.y*24 AND pix.y*9 < (t.y+1)*24 AND (pix.x+1)*12 > t.x*32 AND pix.x*12 < (t.x+1)*32 GROUP BY ALL),
    u AS ({_up_sql('n1', 12, 16, 'nearest')} UNION ALL {_up_sql('n2', 9, 12, 'nearest')} UNION ALL {_up_sql('ov', 9, 12, 'area')}
      UNION ALL {_up_sql('e1', 12, 16, 'nearest_erode1')} UNION ALL {_up_sql('d1', 12, 16, 'nearest_dilate1')})
    SELECT *, round(tp/nullif(tp+fp+fn, 0), 9) AS iou FROM u""",
)
def resolution_ceiling(spark, sf):
    variants = [
        (12, 16, "nearest"),
        (9, 12, "nearest"),
        (9, 12, "area"),
        (12, 16, "nearest_erode1"),
        (12, 16, "nearest_dilate1"),
    ]
    out = cp.resolution_ceiling(pixels(spark, sf), F.col("gt") == 2, SIZE, variants, by=["set_id"])
    return _round(out, r9, "iou")


WIDTHS = f"""{RIDGE}, wq AS (SELECT a.frame_id, a.y, a.x, min((((a.y-s.y)*(a.y-s.y) + (a.x-s.x)*(a.x-s.x))::BIGINT << 40) + (s.y::BIGINT << 20) + s.x) AS q
      FROM inn a JOIN rg s ON s.frame_id = a.frame_id GROUP BY ALL),
    wn AS (SELECT wq.frame_id, wq.y, wq.x, 2*s.d AS width FROM wq JOIN rg s ON s.frame_id = wq.frame_id AND s.y = ((q >> 20) & 1048575) AND s.x = (q & 1048575))"""
CONTR = box_sql(
    {
        "fs": "CASE WHEN s.gt = 1 THEN 0.299::DOUBLE*s.r + 0.587::DOUBLE*s.g + 0.114::DOUBLE*s.b ELSE 0 END",
        "bs": "CASE WHEN s.gt = 1 THEN 0 ELSE 0.299::DOUBLE*s.r + 0.587::DOUBLE*s.g + 0.114::DOUBLE*s.b END",
        "fc": "CASE WHEN s.gt = 1 THEN 1 ELSE 0 END",
        "bc": "CASE WHEN s.gt = 1 THEN 0 ELSE 1 END",
    },
    3,
)


def _digitize(v: str, edges) -> str:
    return " + ".join(f"CAST({v} >= {e} AS INTEGER)" for e in edges[1:-1])


@query(
    "C5",
    f"""WITH {PIX}, {WIDTHS}, e AS (SELECT pix.set_id, pred_a = 1 AS hit, width, g FROM pix LEFT JOIN wn USING (frame_id, y, x) WHERE gt = 1),
    l AS (SELECT set_id, hit, 'width' AS property, {_digitize('width', [0, 2, 4, 8, 99])} AS bin FROM e WHERE width IS NOT NULL
      UNION ALL SELECT set_id, hit, 'green', {_digitize('g', [0, 64, 128, 999])} FROM e),
    c AS (SELECT set_id, property, bin, count(*) AS gt_px, count(*) FILTER (hit) AS tp FROM l GROUP BY ALL),
    b AS (SELECT s.set_id, v.p AS property, CAST(v.b AS INTEGER) AS bin FROM (SELECT DISTINCT set_id FROM pix) s, (VALUES ('width',0),('width',1),('width',2),('width',3),('green',0),('green',1),('green',2)) v(p, b))
    SELECT b.set_id, b.property, b.bin, coalesce(gt_px, 0) AS gt_px, coalesce(tp, 0) AS tp, round(tp/gt_px, 9) AS recall
    FROM b LEFT JOIN c ON c.set_id = b.set_id AND c.property = b.property AND c.bin = b.bin""",
)
def recall_by_property(spark, sf):
    px = pixels(spark, sf).select("frame_id", "y", "x", "gt", "pred_a", "g", "set_id")
    px = width_of_nearest_ridge(px, F.col("gt") == 1)
    out = cp.recall_by_property(
        px,
        F.col("gt") == 1,
        F.col("pred_a") == 1,
        {"width": (F.col("width"), [0, 2, 4, 8, 99]), "green": (F.col("g"), [0, 64, 128, 999])},
        ["set_id"],
    )
    return _round(out, r9, "recall")


_NAMES = "[" + ", ".join(f"'{n}'" for n in COLOUR_BINS) + "]"


@query(
    "C6",
    f"""WITH {PIX}, {HSV}, c AS (SELECT colour_bin, count(*) FILTER (gt > 0) AS g, count(*) FILTER (gt > 0 AND pred_a > 0) AS tp, count(*) FILTER (gt = 0 AND pred_a > 0) AS fp FROM cb GROUP BY ALL),
    t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(g - tp) AS fn, sum(g) AS g FROM c),
    d AS (SELECT c.*, t.tp + greatest(0.0, 0.95::DOUBLE*c.g - c.tp) AS tp2, t.fn - greatest(0.0, 0.95::DOUBLE*c.g - c.tp) AS fn2, t.fp AS tfp, t.tp/(t.tp+t.fp) AS p0, t.g AS tg FROM c, t WHERE c.g > 0)
    SELECT ({_NAMES})[colour_bin + 1] AS colour, g AS gt_px, tp, round(g/tg, 9) AS gt_share, round(tp/g, 9) AS recall,
      round(tp2/(tp2 + tfp + fn2), 9) AS iou_fp_fixed, round(tp2/(tp2/p0 + fn2), 9) AS iou_precision_fixed FROM d""",
)
def recall_by_colour(spark, sf):
    out = cp.recall_by_colour(pixels(spark, sf), F.col("gt") > 0, F.col("pred_a") > 0)
    return _round(out, r9, "gt_share", "recall", "iou_fp_fixed", "iou_precision_fixed")


FAIL = f"""{HSV}, {WIDTHS}, {CONTR}, {dist_sql('gd', 'gt = 1', 'gt <> 1 AND pred_a = 1')},
    fx AS (SELECT cb.*, gt = 1 AS tg, pred_a = 1 AS tp_, CASE WHEN bc >= 8 AND fc >= 1 THEN abs(fs/fc - bs/bc) END AS contrast, width, sqrt(d2) AS dist
      FROM cb JOIN box USING (frame_id, y, x) LEFT JOIN wn USING (frame_id, y, x) LEFT JOIN gd USING (frame_id, y, x)),
    fb AS (SELECT frame_id, colour_bin, count(*) FILTER (tg AND NOT tp_) AS fnb, count(*) FILTER (tg) AS gb FROM fx GROUP BY ALL),
    fd AS (SELECT frame_id, colour_bin AS dom_fn_bin, 1.0::DOUBLE - fnb/gb AS dom_fn_recall FROM fb WHERE fnb > 0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY fnb DESC, colour_bin) = 1),
    fp0 AS (SELECT frame_id, count(*) FILTER (tg AND tp_) AS tp, count(*) FILTER (NOT tg AND tp_) AS fp, count(*) FILTER (tg AND NOT tp_) AS fn,
      median(contrast) FILTER (tg AND NOT tp_) AS median_fn_contrast, median(width) FILTER (tg AND NOT tp_) AS median_fn_width, count(*) FILTER (NOT tg AND tp_ AND dist <= 5) AS halo FROM fx GROUP BY frame_id),
    ff AS (SELECT frame_id, tp, fp, fn, tp/nullif(tp+fp+fn, 0) AS iou, median_fn_contrast, median_fn_width, dom_fn_bin, dom_fn_recall, halo/nullif(fp, 0) AS halo_share FROM fp0 LEFT JOIN fd USING (frame_id)),
    bk AS (SELECT *, CASE WHEN iou >= 0.5 THEN 'good' WHEN fn >= fp AND median_fn_contrast < 12 THEN 'camouflage-low-contrast' WHEN fn >= fp AND dom_fn_bin < 8 AND dom_fn_recall < 0.35 THEN 'missed-colour'
      WHEN fn >= fp AND median_fn_width < 3 THEN 'too-thin' WHEN fn >= fp AND median_fn_contrast < 18 THEN 'camouflage-low-contrast' WHEN fn >= fp AND (dom_fn_recall < 0.35 OR dom_fn_bin < 8) THEN 'missed-colour'
      WHEN fn >= fp THEN 'camouflage-low-contrast' WHEN halo_share >= 0.5 THEN 'halo-only' ELSE 'busy-bg-FP' END AS bucket FROM ff)"""


def _failures(spark, sf):
    return cp.failure_frames(
        pixels(spark, sf), F.col("gt") == 1, F.col("pred_a") == 1, SIZE, win=7
    )


@query(
    "C7",
    f"""WITH {PIX}, {FAIL} SELECT frame_id, tp, fp, fn, round(iou, 9) AS iou, round(median_fn_contrast, 6) AS median_fn_contrast, round(median_fn_width, 6) AS median_fn_width,
      CAST(dom_fn_bin AS INTEGER) AS dom_fn_bin, round(dom_fn_recall, 9) AS dom_fn_recall, round(halo_share, 9) AS halo_share, bucket FROM bk""",
)
def failure_bucket(spark, sf):
    out = _round(cp.failure_bucket(_failures(spark, sf)), r9, "iou", "dom_fn_recall", "halo_share")
    return _round(out, r6, "median_fn_contrast", "median_fn_width")


@query(
    "C8",
    f"""WITH {PIX}, {FAIL}, p AS (SELECT bucket, count(*) AS frames, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(greatest(0.0, 0.9::DOUBLE*(tp+fn) - tp)) AS gain FROM bk GROUP BY bucket),
    t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM p)
    SELECT bucket, frames, CAST(p.tp + p.fn AS BIGINT) AS gt_px, round((p.tp+p.fn)/(t.tp+t.fn), 9) AS gt_share, round(p.fn/t.fn, 9) AS fn_share, round(p.fp/t.fp, 9) AS fp_share,
      round((t.tp+gain)/(t.tp+t.fp+t.fn), 9) AS iou_if_recall, round(t.tp/(t.tp + t.fp - p.fp + t.fn), 9) AS iou_if_fp0, round((t.tp+gain)/(t.tp+t.fp-p.fp+t.fn), 9) AS iou_if_both FROM p, t""",
)
def bucket_upside(spark, sf):
    out = cp.bucket_upside(cp.failure_bucket(_failures(spark, sf)))
    return _round(
        out, r9, "gt_share", "fn_share", "fp_share", "iou_if_recall", "iou_if_fp0", "iou_if_both"
    )


VG = """vg AS (SELECT camera, frame_id, avg(prob_pm/1000.0::DOUBLE) AS m, avg((prob_pm + r)/1255.0::DOUBLE) AS rf, count(*) FILTER (pred_b = 2) AS pos,
      count(*) FILTER (pred_b = 2 AND prob_pm/1000.0::DOUBLE > 0.3) AS kept FROM pix GROUP BY ALL),
    v AS (SELECT camera, count(*) AS frames, avg(m)/greatest(avg(rf), 1e-12) AS gate_a, sum(kept)/greatest(sum(pos), 1) AS gate_b FROM vg GROUP BY camera)"""


def _gate(spark, sf):
    return cp.variant_gate(
        pixels(spark, sf),
        F.col("prob_pm") / 1000.0,
        (F.col("prob_pm") + F.col("r")) / 1255.0,
        F.col("pred_b") == 2,
        low=0.3,
    )


@query(
    "C9",
    f"""WITH {PIX}, {VG} SELECT camera, frames, round(gate_a, 9) AS gate_a, round(gate_b, 9) AS gate_b,
      (SELECT bool_and(gate_a >= 0.5) FROM v) AS all_pass_a, (SELECT bool_and(gate_b >= 0.5) FROM v) AS all_pass_b FROM v""",
)
def variant_gate(spark, sf):
    return _round(_gate(spark, sf), r9, "gate_a", "gate_b")


_CAMS = ["c1", "c2", "c3", "c4"]


@query(
    "C10",
    f"""WITH {PIX}, {VG} SELECT 'one' AS variant, {', '.join(f"round(max(gate_{g}) FILTER (camera = '{c}'), 9) AS {g}_{c}" for g in 'ab' for c in _CAMS)} FROM v
    UNION ALL SELECT 'reference', {', '.join('1.0::DOUBLE' for _ in range(8))}""",
)
def gate_rollup(spark, sf):
    out = cp.gate_rollup([("one", _gate(spark, sf)), ("missing", None)], _CAMS)
    return _round(out, r9, *[f"{g}_{c}" for g in "ab" for c in _CAMS])


_GRID = ", ".join(f"({0.30 + 0.01 * i:.2f}::DOUBLE)" for i in range(61))


@query(
    "C11",
    f"""WITH {PIX}, f AS (SELECT frame_id, avg(CASE WHEN pred_a > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 4 AS s FROM pix GROUP BY frame_id),
    k AS (SELECT t, count(s) FILTER (s >= t) AS keep FROM f, (VALUES {_GRID}) v(t) GROUP BY t)
    SELECT t AS threshold, keep FROM k ORDER BY abs(keep - 60), t LIMIT 1""",
)
def pick_threshold(spark, sf):
    per = pixels(spark, sf).groupBy("frame_id").agg(
        (F.avg((F.col("pred_a") > 0).cast("double")) * 4).alias("s")
    )
    return cp.pick_threshold(per, F.col("s"), 60, floor_keep=0)


DOMAIN = f"""{RIDGE}, dw AS (SELECT frame_id, median(2*d) AS width FROM rg GROUP BY frame_id),
    df AS (SELECT set_id, frame_id, count(*) FILTER (gt = 1)/count(*) AS fg, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM pix GROUP BY ALL),
    ds AS (SELECT set_id, count(*) AS frames, avg(fg) AS fg_mean, avg(width) AS width_mean, avg(b) AS mean_b, avg(g) AS mean_g, avg(r) AS mean_r, avg(r) - avg(b) AS warmth,
      quantile_cont(fg, 0.5) AS fg_median, quantile_cont(fg, 0.05) AS fg_p05, quantile_cont(fg, 0.95) AS fg_p95, quantile_cont(width, 0.5) AS width_median,
      quantile_cont(width, 0.05) AS width_p05, quantile_cont(width, 0.95) AS width_p95 FROM df LEFT JOIN dw USING (frame_id) GROUP BY set_id)"""
_DOM = ["fg_mean", "width_mean", "mean_b", "mean_g", "mean_r", "warmth"] + [
    f"{c}_{p}" for c in ("fg", "width") for p in ("median", "p05", "p95")
]


@query(
    "C12",
    f"WITH {PIX}, {DOMAIN} SELECT set_id, frames, {', '.join(f'round({c}, 6) AS {c}' for c in _DOM)} FROM ds",
)
def domain_summary(spark, sf):
    out = cp.domain_summary(pixels(spark, sf), F.col("gt") == 1, "set_id")
    return _round(out, r6, *_DOM)


@query(
    "C12",
    f"""WITH {PIX}, {DOMAIN} SELECT round(a.fg_median/b.fg_median, 6) AS fg_median_ratio, round(a.width_median/b.width_median, 6) AS width_median_ratio
    FROM ds a JOIN ds b ON a.set_id = 34 AND b.set_id = 32""",
)
def domain_gap(spark, sf):
    s = cp.domain_summary(pixels(spark, sf), F.col("gt") == 1, "set_id")
    return _round(cp.domain_gap(s, "set_id", 34, 32), r6, "fg_median_ratio", "width_median_ratio")


_THICK = list(zip(cp.THICK_NAMES, cp.THICK_EDGES, [2, 4, 8, 16, 1e9]))


@query(
    "C13",
    f"""WITH RECURSIVE {PIX}, {HSV}, {RIDGE}, {cc_sql('gt = 1')}, big AS (SELECT frame_id, count(*) AS n FROM (SELECT frame_id, blob FROM cpx GROUP BY ALL HAVING count(*) >= 20) GROUP BY frame_id),
    w AS (SELECT frame_id, {', '.join(f"100.0*count(*) FILTER (2*d >= {lo} AND 2*d < {hi})/count(*) AS thick_{n}_pct" for n, lo, hi in _THICK)},
      median(2*d) AS thick_median_px, quantile_cont(2*d, 0.9) AS thick_p90_px FROM rg GROUP BY frame_id),
    l AS (SELECT *, 0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b AS lum FROM cb),
    f AS (SELECT frame_id, 100.0*count(*) FILTER (gt = 1)/count(*) AS coverage_pct, 100.0*count(*) FILTER (label6 BETWEEN 1 AND 4)/count(*) AS coverage_trained_pct, count(*) FILTER (label6 = 5) AS noise_px,
      {', '.join(f"100.0*count(*) FILTER (gt = 1 AND colour_bin = {i})/greatest(count(*) FILTER (gt = 1), 1) AS col_{n}_pct" for i, n in enumerate(COLOUR_BINS))},
      avg(lum) FILTER (gt <> 1) AS bg_luma_mean, stddev_pop(lum) FILTER (gt <> 1) AS bg_luma_std, {COLF.format(w=' FILTER (gt <> 1)')} AS bg_colourfulness FROM l GROUP BY frame_id)
    SELECT f.frame_id, round(coverage_pct, 6) AS coverage_pct, round(coverage_trained_pct, 6) AS coverage_trained_pct, noise_px,
      {', '.join(f"round(col_{n}_pct, 6) AS col_{n}_pct" for n in COLOUR_BINS)}, {', '.join(f"round(coalesce(thick_{n}_pct, 0.0), 6) AS thick_{n}_pct" for n in cp.THICK_NAMES)},
      round(coalesce(thick_median_px, 0.0), 6) AS thick_median_px, round(coalesce(thick_p90_px, 0.0), 6) AS thick_p90_px, round(bg_luma_mean, 6) AS bg_luma_mean, round(bg_luma_std, 6) AS bg_luma_std,
      round(bg_colourfulness, 6) AS bg_colourfulness, coalesce(big.n, 0) AS n_components FROM f LEFT JOIN w USING (frame_id) LEFT JOIN big USING (frame_id)""",
)
def audit_frames(spark, sf):
    out = cp.audit_frames(
        pixels(spark, sf), F.col("gt") == 1, F.col("label6").between(1, 4), F.col("label6") == 5
    )
    return _round(
        out, r6, *[c for c in out.columns if c not in ("frame_id", "noise_px", "n_components")]
    )


@query(
    "C14",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id, 100.0*count(*) FILTER (pred_a > 0)/count(*) AS a, 100.0*count(*) FILTER (gt = 1)/count(*) AS b FROM pix GROUP BY ALL),
    s AS (SELECT camera AS clip, avg(a) AS mean_pct, median(a) AS median_pct, avg(b) AS ref_pct FROM f GROUP BY camera), c AS (SELECT *, 100.0*(mean_pct - ref_pct)/ref_pct AS ch FROM s)
    SELECT clip, round(mean_pct, 9) AS mean_pct, round(median_pct, 9) AS median_pct, round(ref_pct, 9) AS ref_pct, round(ch, 9) AS change_pct,
      CASE WHEN abs(ch) <= 15 AND mean_pct >= 5 THEN 'OK' WHEN mean_pct < 5 THEN 'LOW' ELSE 'OFF' END AS flag FROM c""",
)
def coverage_flag(spark, sf):
    px = pixels(spark, sf)
    a = m.coverage(px, F.col("pred_a") > 0, "frame_id", ["camera"])
    ref = m.coverage(px, F.col("gt") == 1, "frame_id", ["camera"]).groupBy("camera").agg(
        F.avg("pct").alias("ref_pct")
    )
    out = cp.coverage_flag(
        a.withColumnRenamed("camera", "clip"), ref.withColumnRenamed("camera", "clip")
    )
    return _round(out, r9, "mean_pct", "median_pct", "ref_pct", "change_pct")


def _sharp_sql(col: str, p: str) -> str:
    sten = STEN.replace("nb0", f"{p}n0").replace("nb ", f"{p}nb ").replace("FROM nb ", f"FROM {p}nb ")
    sten = sten.replace("sten AS", f"{p}st AS").replace("s.r AS v", f"s.{col} AS v")
    rng = RANGE5.replace("lr AS", f"{p}lr AS").replace("s.r", f"s.{col}")
    return f"""{sten}, {rng}, {p} AS (SELECT frame_id, y, x, sqrt(gx*gx + gy*gy) AS gm, rg/(sqrt(gx*gx + gy*gy) + 0.001::DOUBLE) AS wd FROM {p}st JOIN {p}lr USING (frame_id, y, x))"""


# The synthetic channels have far more sharp steps than a render; thresholds are loosened.
SHARP = f"""{_sharp_sql('r', 'so')}, {_sharp_sql('b', 'sn')}, bgp AS (SELECT frame_id, y, x FROM pix WHERE gt = 0),
    th AS (SELECT frame_id, quantile_cont(gm, 0.9) AS t FROM sn JOIN bgp USING (frame_id, y, x) GROUP BY frame_id),
    pf AS (SELECT frame_id, count(*) AS region_px, count(*) FILTER (sn.gm >= t AND sn.wd < 1.5 AND sn.gm > 2.0*(so.gm + 0.001::DOUBLE)) AS new_sharp_px
      FROM sn JOIN so USING (frame_id, y, x) JOIN bgp USING (frame_id, y, x) JOIN th USING (frame_id) GROUP BY frame_id)"""


def _sharp(spark, sf):
    return cp.new_sharp_edges(
        pixels(spark, sf), F.col("r"), F.col("b"), F.col("gt") == 0, top=0.9
    )


@query("C15", f"WITH {PIX}, {SHARP} SELECT * FROM pf")
def new_sharp_edges(spark, sf):
    return _sharp(spark, sf)


def _strong(p: str) -> str:
    return f"""{p}m AS (SELECT {p}.* FROM {p} JOIN bgp USING (frame_id, y, x) WHERE gm > 0), {p}t AS (SELECT frame_id, quantile_cont(gm, 0.99) AS t FROM {p}m GROUP BY frame_id),
    {p}w AS (SELECT median(wd) AS med FROM {p}m JOIN {p}t USING (frame_id) WHERE gm >= t)"""


@query(
    "C15",
    f"""WITH {PIX}, {SHARP}, {_strong('so')}, {_strong('sn')}, o AS (SELECT CAST(sum(new_sharp_px) AS BIGINT) AS n FROM pf)
    SELECT 'new_sharp_edges' AS gate, n AS observed, CAST(500 AS BIGINT) AS threshold, round(sow.med, 6) AS median_old, round(snw.med, 6) AS median_new,
      n < 500 AND snw.med >= 0.9*sow.med AS passed FROM o, sow, snw""",
)
def sharp_edge_gate(spark, sf):
    px, bg = pixels(spark, sf), F.col("gt") == 0
    out = cp.sharp_edge_gate(
        _sharp(spark, sf),
        cp.strong_edge_widths(px, F.col("r"), bg),
        cp.strong_edge_widths(px, F.col("b"), bg),
    )
    return _round(out, r6, "median_old", "median_new")
