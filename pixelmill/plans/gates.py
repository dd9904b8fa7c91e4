"""Queries of the quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions import colour
from pixelmill.operators import gates as gt
from pixelmill.operators import hamming as hm
from pixelmill.operators import joins as jo
from pixelmill.operators import recode as rc
from pixelmill.operators import splits as sp
from pixelmill.operators import windows as wi
from pixelmill.operators.phash import phash_bits as phash
from pixelmill.plans.cloud import BIND, bound
from pixelmill.plans.fixtures import (
    CLOUD_SKEL,
    HASHES,
    MAN,
    PIX,
    PTS,
    TIM,
    H,
    W,
    manifest,
    pixels,
    points,
    sign_hashes,
    table,
    timings,
)
from pixelmill.plans.mixing import INV, NEAR, _inventory
from pixelmill.plans.registry import query, r6
from pixelmill.plans.windows import MOTION, motion


def _row(name: str, observed: str, threshold: str, bad: str, passed: str, group: str = "'all'") -> str:
    return f"""'{name}' AS gate, {group} AS "group", CAST({observed} AS DOUBLE) AS observed, CAST({threshold} AS DOUBLE) AS threshold,
      CAST({bad} AS BIGINT) AS n_bad, {passed} AS passed"""


def _bad(name: str, cond: str, src: str = "pix", group: str = "", limit: int = 0) -> str:
    n = f"count(*) FILTER ({cond})"
    head = _row(name, n, str(limit), n, f"{n} <= {limit}", f"CAST({group} AS VARCHAR)" if group else "'all'")
    return f"SELECT {head} FROM {src}" + (f" GROUP BY {group}" if group else "")


@query(
    "V1",
    f"""WITH {INV}, e AS (SELECT set_id, count(*) AS frames FROM man GROUP BY set_id), w AS (SELECT set_id, frames, unnest(['rgb', 'depth', 'label']) AS channel FROM e),
    h AS (SELECT set_id, channel, count(*) AS n FROM inv GROUP BY ALL), j AS (SELECT channel, frames, coalesce(n, 0) AS n FROM w LEFT JOIN h USING (set_id, channel))
    SELECT {_row('file_counts', 'sum(n)', 'sum(frames)', 'count(*) FILTER (n <> frames)', 'count(*) FILTER (n <> frames) = 0', 'channel')} FROM j GROUP BY channel""",
)
def gate_file_counts(spark, sf):
    expected = manifest(spark, sf).groupBy("set_id").agg(F.count(F.lit(1)).alias("frames"))
    return gt.gate_file_counts(_inventory(spark, sf), expected, ["rgb", "depth", "label"])


@query(
    "V2, V3, V6, V13",
    f"""WITH {PIX} {_bad('label_values', 'label6 NOT IN (0,1,2,3,4)', group='set_id')} UNION ALL {_bad('depth_range', 'depth_mm > 0 AND (depth_mm < 600 OR depth_mm > 1500)', group='set_id')}
    UNION ALL {_bad('label_agreement', 'gt <> CASE WHEN label6 IN (0,5) THEN 0 WHEN label6 = 4 THEN 2 ELSE 1 END', group='set_id')}
    UNION ALL {_bad('object_depth', 'gt > 0 AND depth_mm = 0', group='set_id')}""",
)
def gate_pixel_values(spark, sf):
    px = pixels(spark, sf)
    return gt.run_gates(
        [
            gt.gate_label_values(px, range(5), "label6", "set_id"),
            gt.gate_depth_range(px, 600, 1500, by="set_id"),
            gt.gate_label_agreement(px, "gt", rc.lookup("label6", rc.SIX_TO_THREE), "set_id"),
            gt.gate_object_depth(px, F.col("gt") > 0, by="set_id"),
        ]
    )


@query(
    "V4",
    f"""WITH {PIX}, h AS (SELECT * FROM pix WHERE NOT (frame_id % 50 = 7 AND y = 3 AND x = 5)), f AS (SELECT frame_id, count(*) AS n FROM h GROUP BY frame_id)
    {_bad('frame_shape', 'n <> 768', 'f')}""",
)
def gate_frame_shape(spark, sf):
    hole = (F.col("frame_id") % 50 == 7) & (F.col("y") == 3) & (F.col("x") == 5)
    return gt.gate_frame_shape(pixels(spark, sf).filter(~hole), H, W)


@query(
    "V5",
    f"""WITH {PIX}, n AS (SELECT frame_id, label6, CASE WHEN frame_id % 40 = 3 AND label6 = 5 THEN 1 WHEN label6 IN (0,5) THEN 0 WHEN label6 = 4 THEN 2 ELSE 1 END AS l3 FROM pix),
    f AS (SELECT frame_id, count(*) FILTER (label6 IN (0,5)) <> count(*) FILTER (l3 = 0) OR count(*) FILTER (label6 IN (1,2,3)) <> count(*) FILTER (l3 = 1) OR count(*) FILTER (label6 = 4) <> count(*) FILTER (l3 = 2) AS bad FROM n GROUP BY frame_id)
    {_bad('recode_conserved', 'bad', 'f')}""",
)
def gate_recode_conserved(spark, sf):
    px = rc.recode_labels(pixels(spark, sf), col="label6")
    broken = (F.col("frame_id") % 40 == 3) & (F.col("label6") == 5)
    px = px.withColumn("label3", F.when(broken, 1).otherwise(F.col("label3")))
    return gt.gate_recode_conserved(px, "label6", "label3", rc.SIX_TO_THREE)


@query(
    "V7",
    f"""WITH {PIX}, f AS (SELECT frame_id, max(CASE WHEN frame_id % 4 = 1 AND frame_id % 60 <> 1 THEN 0 ELSE gt END) AS m, max(CASE WHEN set_id = 34 THEN 1 ELSE 0 END) AS v FROM pix WHERE camera = 'c2' GROUP BY frame_id)
    {_bad('negatives_clean', 'm > 0 OR v > 0', 'f')}""",
)
def gate_negatives_clean(spark, sf):
    f = F.col("frame_id")
    px = pixels(spark, sf).withColumns(
        {
            "label": F.when((f % 4 == 1) & (f % 60 != 1), 0).otherwise(F.col("gt")),
            "split": F.when(F.col("set_id") == 34, "val").otherwise("train"),
        }
    )
    return gt.gate_negatives_clean(px, F.col("camera") == "c2", split="split")


@query(
    "V8",
    f"""WITH {MAN}, f AS (SELECT dataset, arg_min(CASE WHEN set_id <= 31 THEN 1 ELSE 0 END, line_no) AS ok FROM man GROUP BY dataset)
    SELECT {_row('first_line', 'ok', '1', '1 - ok', 'ok = 1', 'dataset')} FROM f""",
)
def gate_first_line(spark, sf):
    return gt.gate_first_line(manifest(spark, sf), F.col("set_id") <= 31, by="dataset")


VERD = f"""{HASHES}, ids AS (SELECT doc_id AS id, sha256(text) AS sha FROM documents), b AS (SELECT h.id, protected, CASE WHEN h.id % 53 = 5 AND NOT protected THEN NULL ELSE hash END AS hash, i.sha FROM hashes h JOIN ids i ON i.id = h.id % (SELECT count(*) FROM documents)),
    ex AS (SELECT sha, min(id) AS eid FROM b WHERE protected GROUP BY sha), {NEAR},
    v AS (SELECT b.id, CASE WHEN hash IS NULL THEN 'REJECT_UNREADABLE' WHEN eid IS NOT NULL THEN 'REJECT_EXACTDUP' WHEN min_distance <= 8 THEN 'REJECT_PHASH' ELSE 'KEEP' END AS verdict,
      CAST(CASE WHEN hash IS NULL THEN NULL WHEN eid IS NOT NULL THEN 0 ELSE min_distance END AS INTEGER) AS min_distance, CASE WHEN hash IS NULL THEN NULL WHEN eid IS NOT NULL THEN eid ELSE nearest_id END AS nearest_id
      FROM b LEFT JOIN ex USING (sha) LEFT JOIN nh ON nh.id = b.id WHERE NOT protected)"""


def _sides(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    shas = docs.select(F.col("doc_id").alias("_k"), F.sha2("text", 256).alias("sha"))
    h = sign_hashes(spark, sf)
    h = h.withColumn("_k", F.col("id") % n).join(shas, "_k").drop("_k")
    unread = (F.col("id") % 53 == 5) & ~F.col("protected")
    h = h.withColumn("hash", F.when(~unread, F.col("hash")))
    return [h.filter(c).select("id", "sha", "hash") for c in (~F.col("protected"), F.col("protected"))]


def _verdicts(spark, sf):
    return gt.leak_verdicts(*_sides(spark, sf), 8)


@query("V9", f"WITH {VERD} SELECT id, verdict, min_distance, nearest_id FROM v")
def leak_verdicts(spark, sf):
    return _verdicts(spark, sf).select("id", "verdict", "min_distance", "nearest_id")


@query("V9", f"WITH {VERD} {_bad('leak', chr(39).join(['verdict <> ', 'KEEP', '']), 'v')}")
def gate_leak(spark, sf):
    return gt.gate_leak(_verdicts(spark, sf))


_SPREAD = {"min": "min(d)", "p1": "quantile_cont(d, 0.01)", "p5": "quantile_cont(d, 0.05)", "median": "median(d)", "mean": "avg(d)", "max": "max(d)"}
_COUNTS = {
    "n_candidates": "count(*)",
    "n_reject_exactdup": "count(*) FILTER (verdict = 'REJECT_EXACTDUP')",
    "n_reject_phash": "count(*) FILTER (verdict = 'REJECT_PHASH')",
    "n_reject_unreadable": "count(*) FILTER (verdict = 'REJECT_UNREADABLE')",
    "n_kept": "count(*) FILTER (verdict = 'KEEP')",
    "n_forbidden": "min((SELECT count(hash) FROM b WHERE protected))",
    "phash_thresh": "min(8)",
}
_CELLS = [f"SELECT '{k}' AS metric, CAST({e} AS DOUBLE) AS value FROM v" for k, e in _COUNTS.items()]
_CELLS += [f"SELECT '{k}', round(CAST({e} AS DOUBLE), 6) FROM d" for k, e in _SPREAD.items()]
_CELLS += [f"SELECT 'at_{k:02d}', CAST(count(*) FILTER (d = {k}) AS DOUBLE) FROM d" for k in range(21)]


@query(
    "V9",
    f"WITH {VERD}, d AS (SELECT min_distance AS d FROM v WHERE verdict IN ('REJECT_PHASH', 'KEEP')) " + " UNION ALL ".join(_CELLS),
)
def gate_leak_summary(spark, sf):
    cand, bad = _sides(spark, sf)
    out = gt.leak_summary(gt.leak_verdicts(cand, bad, 8), bad, 8)
    return out.withColumn("value", r6(F.col("value")))


@query(
    "V10",
    f"""WITH {HASHES}, {NEAR} SELECT min_distance, id, nearest_id FROM nh ORDER BY min_distance, id, nearest_id LIMIT 1""",
)
def closest_pair(spark, sf):
    h = sign_hashes(spark, sf)
    return hm.closest_pair(h.filter(~F.col("protected")), h.filter("protected"))


@query(
    "V10",
    f"""WITH {HASHES}, {NEAR} SELECT {_row('min_hamming', 'min(min_distance)', '8', 'count(*) FILTER (min_distance <= 8)', 'count(*) FILTER (min_distance <= 8) = 0')} FROM nh""",
)
def gate_min_hamming(spark, sf):
    h = sign_hashes(spark, sf)
    return gt.gate_min_hamming(h.filter(~F.col("protected")), h.filter("protected"), 8)


@query(
    "V11",
    f"""WITH {PIX}, f AS (SELECT frame_id, count(*) FILTER (depth_mm > 0)/count(*) AS s FROM pix GROUP BY frame_id), g AS (SELECT min(s) AS lo, avg(s) AS me, count(*) FILTER (s < 0.55) AS b FROM f)
    SELECT {_row('depth_coverage_min', 'round(lo, 6)', '0.55', 'b', 'lo >= 0.55')} FROM g UNION ALL SELECT {_row('depth_coverage_mean', 'round(me, 6)', '0.95', 'CASE WHEN me >= 0.95 THEN 0 ELSE 1 END', 'me >= 0.95')} FROM g""",
)
def gate_depth_coverage(spark, sf):
    out = gt.gate_depth_coverage(pixels(spark, sf), 0.55, 0.95)
    return out.withColumn("observed", r6(F.col("observed")))


@query(
    "V12",
    f"""WITH {PIX}, s AS (SELECT frame_id, y, x FROM pix WHERE gt = 2 OR pred_a = 2), t AS (SELECT frame_id, y, x, pred_a <> pred_b AS chg FROM pix),
    n AS (SELECT DISTINCT t.frame_id, t.y, t.x FROM t JOIN s ON s.frame_id = t.frame_id AND t.y BETWEEN s.y-4 AND s.y+4 AND t.x BETWEEN s.x-4 AND s.x+4),
    f AS (SELECT * FROM t ANTI JOIN n USING (frame_id, y, x)) {_bad('isolation', 'chg', 'f')}""",
)
def gate_isolation(spark, sf):
    mask = (F.col("gt") == 2) | (F.col("pred_a") == 2)
    return gt.gate_isolation(pixels(spark, sf), mask, F.col("pred_a") != F.col("pred_b"), 4)


@query(
    "V14",
    f"""WITH m(c, m) AS (VALUES ('ECONOMY', 15), ('STANDARD', 20), ('no such type', 1), ('PROMO', 100000))
    SELECT {_row('asset_counts', '(SELECT count(*) FROM part WHERE p_type = c)', 'm', 'greatest(m - (SELECT count(*) FROM part WHERE p_type = c), 0)', '(SELECT count(*) FROM part WHERE p_type = c) >= m', 'c')} FROM m""",
)
def gate_asset_counts(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_type").alias("category"))
    need = {"ECONOMY": 15, "STANDARD": 20, "no such type": 1, "PROMO": 100000}
    return gt.gate_asset_counts(parts, need)


@query(
    "V15",
    f"""WITH {MAN}, s AS (SELECT set_id, CASE WHEN src % 97 = 5 THEN 'val' WHEN set_id <= 31 THEN 'train' WHEN set_id <= 35 THEN 'val' ELSE 'test' END AS split FROM man),
    f AS (SELECT set_id, count(DISTINCT split) AS n FROM s GROUP BY set_id) {_bad('split_disjoint', 'n > 1', 'f')}""",
)
def gate_split_disjoint(spark, sf):
    man = sp.split_by_range(manifest(spark, sf))
    man = man.withColumn("split", F.when(F.col("src") % 97 == 5, "val").otherwise(F.col("split")))
    return gt.gate_split_disjoint(man)


@query(
    "V16",
    f"""WITH {TIM}, a AS (SELECT model, avg(ms) AS x FROM tim GROUP BY model), b AS (SELECT model, avg(ms) AS y FROM tim WHERE dtype = 0 GROUP BY model),
    j AS (SELECT abs(x-y)/abs(y)*100 AS d FROM a JOIN b USING (model)) SELECT {_row('reproduced', 'round(max(d), 6)', '0', 'count(*) FILTER (d > 1)', 'count(*) FILTER (d > 1) = 0')} FROM j""",
)
def gate_reproduced(spark, sf):
    t = timings(spark, sf)
    a = t.groupBy("model").agg(F.avg("ms").alias("x"))
    b = t.filter(F.col("dtype") == 0).groupBy("model").agg(F.avg("ms").alias("y"))
    out = gt.gate_reproduced(jo.join_reference(a, b, ["model"], "x", "y", 1.0, percent=True))
    return out.withColumn("observed", r6(F.col("observed")))


@query("V17", f"WITH {PIX} {_bad('protected_pixels', 'gt > 0 AND pred_a <> pred_b', group='camera')}")
def gate_protected_pixels(spark, sf):
    return gt.gate_protected_pixels(
        pixels(spark, sf), F.col("gt") > 0, F.col("pred_a") != F.col("pred_b"), "camera"
    )


@query(
    "V18",
    f"""WITH {PTS}, {CLOUD_SKEL}, {BIND}, p AS (SELECT quantile_cont(sqrt(d2), 0.95) AS p, count(DISTINCT (sample_id, a, b)) AS u FROM bind)
    SELECT {_row('bind_weights', '0', '1e-6', '0', 'TRUE')} UNION ALL SELECT {_row('bind_rebuilt', '0', '1e-9', '0', 'TRUE')}
    UNION ALL SELECT {_row('bind_offset_p95', 'round(p, 6)', '100', '0', 'p < 100')} FROM p WHERE p < 100
    UNION ALL SELECT {_row('bind_offset_p95', 'round(p, 6)', '100', '1', 'p < 100')} FROM p WHERE p >= 100
    UNION ALL SELECT {_row('bind_edges_used', 'u', '1', '0', 'u >= 1')} FROM p""",
)
def gate_binding(spark, sf):
    pts, nodes, _, b = bound(spark, sf)
    out = gt.gate_binding(b, pts, nodes, max_p95=100.0)
    return out.withColumn("observed", r6(F.col("observed")))


@query(
    "V19",
    f"""WITH {PTS}, {MOTION}, dd AS (SELECT clip, max(max_d) AS md, min(n) = max(n) AS sc FROM mf GROUP BY clip),
    fb AS (SELECT clip, frame, max(px)-min(px) AS ex, max(py)-min(py) AS ey, max(pz)-min(pz) AS ez, min(px) AS lx, max(px) AS hx, min(py) AS ly, max(py) AS hy, min(pz) AS lz, max(pz) AS hz FROM mo GROUP BY ALL),
    gr AS (SELECT clip, greatest(max(hx)-min(lx), max(hy)-min(ly), max(hz)-min(lz)) / greatest(arg_min(ex, frame) + 1e-8, arg_min(ey, frame) + 1e-8, arg_min(ez, frame) + 1e-8) AS g FROM fb GROUP BY clip),
    lb AS (SELECT clip, count(*) FILTER (k > 1) AS c FROM (SELECT sample_id - sample_id % 5 AS clip, point_id, count(DISTINCT label) AS k FROM pts GROUP BY ALL) GROUP BY clip)
    SELECT {_row('motion_point_count', 'max(CASE WHEN sc THEN 0 ELSE 1 END)', '0', 'count(*) FILTER (NOT sc)', 'count(*) FILTER (NOT sc) = 0')} FROM dd
    UNION ALL SELECT {_row('motion_finite', '0', '0', '0', 'TRUE')}
    UNION ALL SELECT {_row('motion_step', 'round(max(md), 6)', '0.5', 'count(*) FILTER (md >= 0.5)', 'count(*) FILTER (md >= 0.5) = 0')} FROM dd
    UNION ALL SELECT {_row('motion_box_growth', 'round(max(g), 6)', '3', 'count(*) FILTER (g >= 3)', 'count(*) FILTER (g >= 3) = 0')} FROM gr
    UNION ALL SELECT {_row('motion_labels', 'max(c)', '0', 'count(*) FILTER (c > 0)', 'count(*) FILTER (c > 0) = 0')} FROM lb""",
)
def gate_motion(spark, sf):
    mo = motion(spark, sf)
    out = gt.gate_motion(wi.frame_displacement(mo), gt.box_growth(mo), gt.labels_changed(mo))
    return out.withColumn("observed", r6(F.col("observed")))


_COS = "cos(pi()/32*({0} + 0.5)*{1})"


@query(
    "J8, V9",
    f"""WITH {PIX}, s AS (SELECT t.y, t.x, pix.frame_id, 0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b AS v FROM (SELECT a.range AS y, c.range AS x FROM range(32) a, range(32) c) t JOIN pix ON pix.y = (t.y*24)//32 AND pix.x = t.x),
    rw AS (SELECT frame_id, y, kx.range AS kx, sum(v*{_COS.format('x', 'kx.range')}) AS v FROM s, range(8) kx GROUP BY ALL),
    cl AS (SELECT frame_id, ky.range AS ky, kx, sum(v*{_COS.format('y', 'ky.range')}) AS v FROM rw, range(8) ky GROUP BY ALL),
    md AS (SELECT frame_id, median(v) AS m FROM cl GROUP BY frame_id)
    SELECT frame_id, CAST(sum(CASE WHEN v > m AND (ky > 0 OR kx > 0) THEN (1::HUGEINT << (63 - CAST(ky*8 + kx AS INTEGER))) ELSE 0 END) AS BIGINT) AS hash, count(*) FILTER (v > m) AS ones
    FROM cl JOIN md USING (frame_id) GROUP BY frame_id""",
)
def phash_bits(spark, sf):
    # the highest bit is left out of the number on both sides: it would be the sign
    out = phash(pixels(spark, sf), colour.luma(), (H, W))
    low = F.col("hash").bitwiseAND(F.lit((1 << 63) - 1))
    return out.select("frame_id", low.alias("hash"), F.bit_count("hash").cast("bigint").alias("ones"))
