"""Queries of the distribution and drift statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import stats as st
from pixelmill.plans.fixtures import FEATS, PIX, PTS, TIM, features, pixels, points, timings
from pixelmill.plans.registry import query, r6, r9

def prob():
    return F.col("prob_pm") / 1000.0


def _round(df, f, *cols):
    return df.withColumns({c: f(F.col(c)) for c in cols})


@query(
    "A11",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id, count(*) FILTER (gt = 2)/count(*) AS s FROM pix GROUP BY ALL)
    SELECT camera, round(avg(s), 9) AS mean, round(min(s), 9) AS min, round(max(s), 9) AS max, count(*) FILTER (s = 0) AS all_zero,
      count(*) FILTER (s > 0.9) AS near_all_one, count(*) AS frames, round(quantile_cont(s, 0.05), 9) AS p05,
      round(quantile_cont(s, 0.5), 9) AS median, round(quantile_cont(s, 0.95), 9) AS p95 FROM f GROUP BY camera""",
)
def mask_fraction_stats(spark, sf):
    out = st.mask_fraction_stats(pixels(spark, sf), F.col("gt") == 2, by=["camera"])
    return _round(out, r9, "mean", "min", "max", "p05", "median", "p95")


@query(
    "A12",
    f"""WITH {TIM} SELECT model, count(ms) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.25), 6) AS q25,
      round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.75), 6) AS q75,
      round(quantile_cont(ms, 0.75) - quantile_cont(ms, 0.25), 6) AS iqr FROM tim GROUP BY model""",
)
def stat_block(spark, sf):
    out = st.stat_block(timings(spark, sf), ["model"], "ms")
    return _round(out, r6, "mean", "q25", "median", "q75", "iqr")


EDGES = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 1.0001]
BIN_CASE = "CASE " + " ".join(
    f"WHEN pr >= {a} AND pr < {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))
) + " END"
HIST = f"""pr AS (SELECT set_id, pred_a, prob_pm/1000.0::DOUBLE AS pr FROM pix),
    hb AS (SELECT set_id, {BIN_CASE} AS bin, count(*) AS c FROM pr GROUP BY ALL),
    hist AS (SELECT s.set_id, CAST(e.bin AS INTEGER) AS bin, e.lo, e.hi, coalesce(c, 0) AS n
      FROM (SELECT DISTINCT set_id FROM pr) s, (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))}) e(bin, lo, hi)
      LEFT JOIN hb ON hb.set_id = s.set_id AND hb.bin = e.bin)"""


@query("A13", f"WITH {PIX}, {HIST} SELECT * FROM hist")
def histogram(spark, sf):
    px = pixels(spark, sf)
    return st.histogram(px, prob(), EDGES, ["set_id"])


@query(
    "A14",
    f"""WITH {PIX}, h AS (SELECT set_id, b // 16 AS bin, sum(depth_mm) AS n FROM pix GROUP BY ALL)
    SELECT set_id, round(max(n)*16/sum(n), 9) AS peak FROM h GROUP BY set_id""",
)
def weighted_histogram_peak(spark, sf):
    edges = [16.0 * i for i in range(17)]
    h = st.weighted_histogram(pixels(spark, sf), "b", F.col("depth_mm").cast("double"), edges, ["set_id"])
    return _round(st.peak_over_uniform(h, ["set_id"]), r9, "peak")


@query(
    "A15",
    f"""WITH {PIX}, {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY set_id ORDER BY bin) AS cum,
      sum(n) OVER (PARTITION BY set_id) AS t, (lo+hi)/2 AS mid FROM hist)
    SELECT set_id, min(mid) FILTER (cum >= 0.5*t) AS median, min(mid) FILTER (cum >= 0.9*t) AS p90 FROM c GROUP BY set_id""",
)
def histogram_percentile(spark, sf):
    px = pixels(spark, sf)
    h = st.histogram(px, prob(), EDGES, ["set_id"])
    return st.histogram_percentile(h, {"median": 0.5, "p90": 0.9}, ["set_id"])


@query(
    "A16",
    f"""WITH {PIX}, c AS (SELECT camera, unnest(['b','g','r']) AS channel, unnest([b,g,r]) AS v FROM pix)
    SELECT camera, channel, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM c GROUP BY ALL""",
)
def channel_histogram(spark, sf):
    h = st.channel_histogram(pixels(spark, sf), ["camera"])
    return _round(st.histogram_moments(h, ["camera", "channel"]), r9, "mean", "std")


@query(
    "A17",
    f"""WITH {PIX}, h AS (SELECT camera, frame_id, (b//16)*65536 + (g//16)*256 + r//16 AS cell, count(*) AS n FROM pix GROUP BY ALL),
    nr AS (SELECT camera, frame_id, sqrt(sum(n*n)) AS norm FROM h GROUP BY ALL),
    ref AS (SELECT camera, min(frame_id) AS rf FROM nr GROUP BY camera),
    rh AS (SELECT h.camera, cell, n AS m FROM h JOIN ref ON ref.camera = h.camera AND h.frame_id = rf),
    d AS (SELECT h.camera, h.frame_id, sum(n*m) AS dot FROM h JOIN rh USING (camera, cell) GROUP BY ALL)
    SELECT nr.camera, nr.frame_id, round(coalesce(dot, 0)/(nr.norm * r2.norm), 9) AS cosine FROM nr
      LEFT JOIN d ON d.frame_id = nr.frame_id JOIN ref ON ref.camera = nr.camera JOIN nr r2 ON r2.frame_id = rf""",
)
def histogram_cosine(spark, sf):
    return _round(st.histogram_cosine(pixels(spark, sf), ["camera"]), r9, "cosine")


@query(
    "A18",
    f"WITH {PIX} SELECT frame_id, count(DISTINCT b + g*256 + r*65536) AS colours FROM pix GROUP BY frame_id",
)
def distinct_colours(spark, sf):
    return st.distinct_colours(pixels(spark, sf), ["frame_id"])


COLF = """sqrt(var_pop((r-g)::DOUBLE){w} + var_pop(0.5::DOUBLE*(r+g)-b){w}) + 0.3::DOUBLE*sqrt(pow(avg((r-g)::DOUBLE){w}, 2) + pow(avg(0.5::DOUBLE*(r+g)-b){w}, 2))"""


@query("A19", f"WITH {PIX} SELECT frame_id, round({COLF.format(w='')}, 9) AS colourfulness FROM pix GROUP BY frame_id")
def colourfulness(spark, sf):
    return _round(st.colourfulness(pixels(spark, sf), ["frame_id"]), r9, "colourfulness")


@query(
    "A20",
    f"""WITH {PIX}, s AS (SELECT set_id, prob_pm, count(*) FILTER (gt = 2) AS p, count(*) FILTER (gt <> 2) AS q FROM pix GROUP BY ALL),
    c AS (SELECT *, sum(q) OVER (PARTITION BY set_id ORDER BY prob_pm) - q AS below FROM s)
    SELECT set_id, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives,
      round(sum(p*(below + q/2.0::DOUBLE))/(sum(p)::DOUBLE*sum(q)), 9) AS auc FROM c GROUP BY set_id""",
)
def roc_auc(spark, sf):
    out = st.roc_auc(pixels(spark, sf), ["set_id"], "prob_pm", F.col("gt") == 2)
    return _round(out, r9, "auc")


CLIFF = """pv AS (SELECT set_id, gt = 2 AND pred_a <> 2 AS is_a, gt = 2 AND pred_a = 2 AS is_b,
      unnest(['depth','luma','prob']) AS property, unnest([depth_mm::DOUBLE, (299*r + 587*g + 114*b)::DOUBLE, prob_pm::DOUBLE]) AS v FROM pix),
    cc AS (SELECT set_id, property, v, count(*) FILTER (is_a) AS na, count(*) FILTER (is_b) AS nb FROM pv WHERE is_a OR is_b GROUP BY ALL),
    cw AS (SELECT *, sum(nb) OVER (PARTITION BY set_id, property ORDER BY v) - nb AS below, sum(nb) OVER (PARTITION BY set_id, property) AS tb FROM cc),
    cd AS (SELECT set_id, property, CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b,
      CASE WHEN sum(na) > 0 AND sum(nb) > 0 THEN sum(na*(below - (tb - below - nb)))::DOUBLE/(sum(na)::DOUBLE*sum(nb)) END AS delta FROM cw GROUP BY ALL)"""


def _deltas(spark, sf):
    gt, pred = F.col("gt"), F.col("pred_a")
    px = pixels(spark, sf).withColumns(
        {"is_a": (gt == 2) & (pred != 2), "is_b": (gt == 2) & (pred == 2)}
    )
    long = st.unpivot(
        px.filter("is_a or is_b"),
        ["set_id", "is_a", "is_b"],
        {
            "depth": F.col("depth_mm"),
            "luma": 299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b"),
            "prob": F.col("prob_pm"),
        },
    )
    return st.cliffs_delta(long, ["set_id", "property"], "value", F.col("is_a"), F.col("is_b"))


@query("A21", f"WITH {PIX}, {CLIFF} SELECT set_id, property, n_a, n_b, round(delta, 9) AS delta FROM cd")
def cliffs_delta(spark, sf):
    return _round(_deltas(spark, sf), r9, "delta")


@query(
    "A22",
    f"""WITH {PIX}, {CLIFF} SELECT set_id, property, round(delta, 9) AS delta,
      CAST(row_number() OVER (PARTITION BY set_id ORDER BY abs(delta) DESC, property) AS INTEGER) AS rank,
      CASE WHEN delta < 0 THEN 'lower' ELSE 'higher' END AS direction FROM cd WHERE delta IS NOT NULL""",
)
def rank_effects(spark, sf):
    return _round(st.rank_effects(_deltas(spark, sf), ["set_id"]), r9, "delta")


@query(
    "A23",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id, 100.0*count(*) FILTER (pred_a > 0)/count(*) AS a,
      100.0*count(*) FILTER (pred_b > 0)/count(*) AS b FROM pix GROUP BY ALL)
    SELECT camera, count(*) AS n, round(corr(a, b), 6) AS corr FROM f GROUP BY camera""",
)
def correlation(spark, sf):
    n = F.count(F.lit(1))
    per = pixels(spark, sf).groupBy("camera", "frame_id").agg(
        (100.0 * F.count_if(F.col("pred_a") > 0) / n).alias("ca"),
        (100.0 * F.count_if(F.col("pred_b") > 0) / n).alias("cb"),
    )
    return _round(st.correlation(per, ["camera"], "ca", "cb"), r6, "corr")


TAUS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75]


@query(
    "A24",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id, t.tau, 100.0*count(*) FILTER (prob_pm/1000.0::DOUBLE > t.tau)/count(*) AS c
      FROM pix, (VALUES {', '.join(f'({t}::DOUBLE)' for t in TAUS)}) t(tau) GROUP BY ALL)
    SELECT camera, tau, round(avg(c), 9) AS mean_pct FROM f GROUP BY ALL""",
)
def threshold_sweep(spark, sf):
    return _round(st.threshold_sweep(pixels(spark, sf), prob(), TAUS, by=["camera"]), r9, "mean_pct")


@query(
    "A25",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id, sum(prob_pm/1000.0::DOUBLE) AS m,
      sum(CASE WHEN pred_b > 0 THEN prob_pm/1000.0::DOUBLE ELSE 0 END) AS i, count(*) FILTER (pred_b > 0) AS area FROM pix GROUP BY ALL)
    SELECT camera, count(*) AS frames, round(avg(m), 6) AS mean_mass, round(avg(area), 6) AS mean_other_area,
      round(sum(m-i)/sum(m), 6) AS outside_pooled, round(sum(i)/sum(m), 6) AS inside_pooled, round(avg((m-i)/m), 6) AS outside_mean
    FROM f GROUP BY camera""",
)
def soft_mass(spark, sf):
    out = st.soft_mass(pixels(spark, sf), prob(), F.col("pred_b") > 0, by=["camera"])
    return _round(
        out, r6, "mean_mass", "mean_other_area", "outside_pooled", "inside_pooled", "outside_mean"
    )


@query(
    "A26",
    f"""WITH {PIX}, c AS (SELECT camera, CASE WHEN pred_a > 0 AND pred_b > 0 THEN 'both' WHEN pred_a > 0 THEN 'only_a'
      WHEN pred_b > 0 THEN 'only_b' ELSE 'neither' END AS cell, prob_pm/1000.0::DOUBLE AS s FROM pix)
    SELECT camera, cell, count(s) AS n, round(avg(s), 9) AS mean, round(quantile_cont(s, 0.25), 9) AS q25,
      round(quantile_cont(s, 0.5), 9) AS median, round(quantile_cont(s, 0.75), 9) AS q75,
      round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 9) AS iqr FROM c GROUP BY ALL""",
)
def partition_stats(spark, sf):
    out = st.partition_stats(
        pixels(spark, sf), F.col("pred_a") > 0, F.col("pred_b") > 0, prob(), ["camera"]
    )
    return _round(out, r9, "mean", "q25", "median", "q75", "iqr")


CHAN = "cm AS (SELECT img_set, channel, avg(v) AS mean, stddev_pop(v) AS std FROM feats GROUP BY ALL)"


@query(
    "A27",
    f"""WITH {FEATS}, {CHAN}, z AS (SELECT abs((n.mean - r.mean)/CASE WHEN r.std > 1e-12 THEN r.std ELSE 1 END) AS z
      FROM cm n JOIN cm r ON n.channel = r.channel AND n.img_set = 'new' AND r.img_set = 'ref')
    SELECT count(*) AS channels, round(max(z), 6) AS max_abs_z, round(quantile_cont(z, 0.95), 6) AS p95_abs_z,
      round(avg(z), 6) AS mean_abs_z, round(avg(CASE WHEN z > 3 THEN 1.0 ELSE 0.0 END), 6) AS share_gt_3 FROM z""",
)
def channel_drift(spark, sf):
    out = st.channel_drift(features(spark, sf), "img_set", "new", "ref")
    return _round(out, r6, "max_abs_z", "p95_abs_z", "mean_abs_z", "share_gt_3")


@query(
    "A28",
    f"""WITH {FEATS}, {CHAN}, z AS (SELECT img_id, abs((v - r.mean)/CASE WHEN r.std > 1e-12 THEN r.std ELSE 1 END) AS z
      FROM feats f JOIN cm r ON f.channel = r.channel AND r.img_set = 'ref' WHERE f.img_set = 'new')
    SELECT img_id, round(max(z), 6) AS max_abs_z, round(quantile_cont(z, 0.95), 6) AS p95_abs_z FROM z GROUP BY img_id""",
)
def image_drift(spark, sf):
    out = st.image_drift(features(spark, sf), "img_set", "new", "ref")
    return _round(out, r6, "max_abs_z", "p95_abs_z")


@query(
    "A28",
    f"""WITH {FEATS}, g AS (SELECT img_set, img_id, avg(v) AS gm FROM feats GROUP BY ALL),
    r AS (SELECT avg(gm) AS mu, stddev_pop(gm) AS sd FROM g WHERE img_set = 'ref')
    SELECT count(*) AS images, round(avg(CASE WHEN abs(gm - mu) > 3*sd THEN 1.0 ELSE 0.0 END), 9) AS share_outside
    FROM g, r WHERE img_set = 'new'""",
)
def outside_global_mean(spark, sf):
    out = st.outside_global_mean(features(spark, sf), "img_set", "new", "ref")
    return _round(out, r9, "share_outside")


@query(
    "A29",
    f"""WITH {FEATS}, {CHAN} SELECT round(sum(a.mean*b.mean)/(sqrt(sum(a.mean*a.mean))*sqrt(sum(b.mean*b.mean)) + 1e-12), 6) AS cosine
      FROM cm a JOIN cm b ON a.channel = b.channel AND a.img_set = 'new' AND b.img_set = 'ref'""",
)
def centroid_cosine(spark, sf):
    return _round(st.centroid_cosine(features(spark, sf), "img_set", "new", "ref"), r6, "cosine")


@query(
    "A30",
    f"""WITH {FEATS}, s AS (SELECT channel, stddev_pop(v) + 1e-6 AS sd FROM feats GROUP BY channel),
    c AS (SELECT centroid, channel, avg(v) AS m FROM feats GROUP BY ALL),
    d AS (SELECT img_id, c.centroid, sqrt(sum(pow((v - m)/sd, 2))) AS d FROM feats f JOIN c ON f.channel = c.channel JOIN s ON s.channel = f.channel GROUP BY ALL)
    SELECT img_id, arg_min(centroid, d) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY img_id""",
)
def nearest_centroid(spark, sf):
    return _round(st.nearest_centroid(features(spark, sf)), r6, "distance")


@query(
    "A32",
    f"""WITH {TIM}, s AS (SELECT model, dtype, batch_size, avg(ms) AS mean_ms, stddev_pop(ms) AS std_ms, min(ms) AS min_ms, max(ms) AS max_ms,
      count(*) AS n, quantile_cont(ms, 0.5) AS p50_ms, quantile_cont(ms, 0.9) AS p90_ms, quantile_cont(ms, 0.95) AS p95_ms FROM tim GROUP BY ALL)
    SELECT s.model, s.dtype, s.batch_size, round(s.mean_ms, 6) AS mean_ms, round(s.std_ms, 6) AS std_ms, round(s.min_ms, 6) AS min_ms,
      round(s.max_ms, 6) AS max_ms, s.n, round(s.p50_ms, 6) AS p50_ms, round(s.p90_ms, 6) AS p90_ms, round(s.p95_ms, 6) AS p95_ms,
      round(1000.0/s.mean_ms, 6) AS fps, round(b.mean_ms/s.mean_ms, 6) AS speedup
    FROM s LEFT JOIN s b ON b.model = 'view' AND b.dtype = s.dtype AND b.batch_size = s.batch_size""",
)
def latency_summary(spark, sf):
    out = st.latency_summary(
        timings(spark, sf), ["model", "dtype", "batch_size"], arm="model", baseline="view"
    )
    return _round(
        out, r6, *[f"{c}_ms" for c in ("mean", "std", "min", "max", "p50", "p90", "p95")], "fps", "speedup"
    )


@query(
    "A33",
    f"""WITH {FEATS}, s AS (SELECT * FROM feats WHERE img_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 128 OFFSET 16))
    SELECT channel, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n, round(quantile_cont(v, 0.001), 6) AS p_lo,
      round(quantile_cont(v, 0.999), 6) AS p_hi FROM s GROUP BY channel""",
)
def calibration_range(spark, sf):
    out = st.calibration_range(features(spark, sf), "img_id", 16, 128)
    return _round(out, r6, "min", "max", "p_lo", "p_hi")


@query(
    "A35",
    f"""WITH {PTS} SELECT sample_id, {', '.join(f"round(min({a}), 9) AS min_{a}, round(max({a}), 9) AS max_{a}, round(max({a})-min({a}), 9) AS extent_{a}, round(avg({a}), 9) AS centre_{a}" for a in ('px', 'py', 'pz'))}
    FROM pts GROUP BY sample_id""",
)
def bbox(spark, sf):
    out = st.bbox(points(spark, sf), ["sample_id"])
    return _round(out, r9, *[c for c in out.columns if c != "sample_id"])
