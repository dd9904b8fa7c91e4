"""Queries of the curve, neighbourhood and distance operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import distance as di
from pixelmill.operators import evals as ev
from pixelmill.operators import metrics as m
from pixelmill.operators import raster as ra
from pixelmill.operators import windows as wi
from pixelmill.plans.digest import digest, digest_sql
from pixelmill.plans.fixtures import (
    EVALS,
    PIX,
    PTS,
    H,
    W,
    eval_log,
    pixels,
    points,
)
from pixelmill.plans.registry import query, r6, r9
from pixelmill.session import scratch_dir
from pixelmill.sources.logs import eval_rows, loss_rows, read_run_logs

SIZE = (H, W)


def _evals(spark, sf):
    return eval_rows(eval_log(spark, sf), "step")


def _round(df, f, *cols):
    return df.withColumns({c: f(F.col(c)) for c in cols})


def _red(spark, sf):
    return pixels(spark, sf).select("frame_id", "y", "x", "r")


def _log_files(spark, sf):
    """The log lines as text files, one folder per run."""
    path = scratch_dir(spark, "logs")
    lines = eval_log(spark, sf).repartitionByRange("arm", "step").sortWithinPartitions("arm", "step")
    lines.select(F.col("line").alias("value"), "arm").write.partitionBy("arm").text(path)
    return read_run_logs(spark, f"{path}/arm=*/*")


@query("S7", f"WITH {EVALS} SELECT * FROM evals")
def parsed_eval_log(spark, sf):
    return eval_rows(_log_files(spark, sf))


@query("S7", f"WITH {EVALS} SELECT * FROM losses")
def parsed_loss_log(spark, sf):
    return loss_rows(_log_files(spark, sf))


@query(
    "W1",
    f"""WITH {EVALS}, t AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY idx DESC) AS rn FROM evals)
    SELECT arm, count(*) AS n, {', '.join(f'round(avg({c}), 9) AS {c}' for c in ('miou', 'wire', 'con', 'bg'))}
    FROM t WHERE rn <= 5 GROUP BY arm""",
)
def tail_mean(spark, sf):
    cols = ("miou", "wire", "con", "bg")
    return _round(ev.tail_mean(_evals(spark, sf), cols), r9, *cols)


@query(
    "W2",
    f"""WITH {EVALS}, a AS (SELECT arm, count(*) AS evals, max(con) AS peak, arg_max(con, idx) AS final FROM evals GROUP BY arm)
    SELECT a.arm, evals, peak, (SELECT min(idx) FROM evals e WHERE e.arm = a.arm AND e.con = peak) + 1 AS peak_at, final,
      round(peak - final, 9) AS gap FROM a WHERE evals >= 4""",
)
def peak_and_final(spark, sf):
    return _round(ev.peak_and_final(_evals(spark, sf), "con"), r9, "gap")


@query(
    "W3",
    f"""WITH {EVALS}, l2 AS (SELECT arm, epoch // 3 AS epoch, loss FROM losses),
    e AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY epoch) - 1 AS j, count(*) OVER (PARTITION BY arm) AS ne FROM
      (SELECT arm, epoch, avg(loss) AS train_loss FROM l2 GROUP BY ALL)),
    v AS (SELECT *, count(*) OVER (PARTITION BY arm) AS n FROM evals)
    SELECT v.arm, v.idx, v.con, round(e.train_loss, 9) AS train_loss FROM v
      LEFT JOIN e ON e.arm = v.arm AND e.j = least(((v.idx+1)*e.ne)//v.n - 1, e.ne - 1)""",
)
def align_loss_to_eval(spark, sf):
    log = eval_log(spark, sf)
    # an epoch is three steps here, so there are fewer epochs than evaluations
    losses = loss_rows(log).withColumn("epoch", F.floor(F.col("epoch") / 3))
    out = ev.align_loss_to_eval(_evals(spark, sf), losses)
    return _round(out.select("arm", "idx", "con", "train_loss"), r9, "train_loss")


ARMS = """arms AS (SELECT 'a' AS arm, set_id, gt, pred_a AS pred, count(*) AS n FROM pix GROUP BY ALL
      UNION ALL SELECT 'b', set_id, gt, pred_b, count(*) FROM pix GROUP BY ALL),
    iou AS (SELECT arm, set_id, sum(CASE WHEN gt = 2 AND pred = 2 THEN n ELSE 0 END)/sum(CASE WHEN gt = 2 OR pred = 2 THEN n ELSE 0 END) AS iou
      FROM arms GROUP BY ALL),
    delta AS (SELECT b.arm, b.set_id, b.iou - a.iou AS delta_iou FROM iou b JOIN iou a ON a.set_id = b.set_id AND a.arm = 'a' AND b.arm = 'b')"""


def _deltas(spark, sf):
    px = pixels(spark, sf)
    arms = F.array(
        *[
            F.struct(F.lit(a).alias("arm"), F.col(f"pred_{a}").alias("pred"))
            for a in ("a", "b")
        ]
    )
    cm = m.confusion(px.select("set_id", "gt", F.inline(arms)), ["arm", "set_id"])
    iou = m.class_metrics(cm, ["arm", "set_id"]).filter(F.col("cls") == 2)
    return ev.delta_vs_baseline(iou, ["iou"], ["set_id"], "a")


@query("W4", f"WITH {PIX}, {ARMS} SELECT arm, set_id, round(delta_iou, 9) AS delta_iou FROM delta")
def delta_vs_baseline(spark, sf):
    return _round(_deltas(spark, sf), r9, "delta_iou")


@query(
    "W5",
    f"""WITH {PIX}, {ARMS} SELECT arm, count(*) AS sets, bool_and(delta_iou > 0) AS all_up, bool_and(delta_iou < 0) AS all_down
    FROM delta GROUP BY arm""",
)
def all_sets_agree(spark, sf):
    return ev.all_sets_agree(_deltas(spark, sf), "delta_iou")


@query(
    "W16",
    f"""WITH {EVALS}, p AS (SELECT arm, idx, con, max(con) OVER (PARTITION BY arm ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM evals)
    SELECT arm, idx, con, prev IS NULL OR con > prev AS is_best, greatest(prev, con) AS best FROM p""",
)
def running_best(spark, sf):
    return ev.running_best(_evals(spark, sf).select("arm", "idx", "con"), "con")


RUNS = """fg AS (SELECT frame_id, y, x FROM pix WHERE gt = 1),
    rr AS (SELECT frame_id, 'x' AS axis, y AS line, x - row_number() OVER (PARTITION BY frame_id, y ORDER BY x) AS k, x AS p FROM fg
      UNION ALL SELECT frame_id, 'y', x, y - row_number() OVER (PARTITION BY frame_id, x ORDER BY y), y FROM fg),
    rl AS (SELECT frame_id, axis, line, min(p) AS start, count(*) AS length FROM rr GROUP BY frame_id, axis, line, k)"""


@query(
    "W6",
    f"""WITH {PIX}, {RUNS} SELECT frame_id, axis, count(*) AS runs, CAST(sum(length) AS BIGINT) AS px,
      CAST(max(length) AS INTEGER) AS longest, CAST(sum(start * length) AS BIGINT) AS moment FROM rl GROUP BY ALL""",
)
def run_lengths(spark, sf):
    r = wi.run_lengths(pixels(spark, sf), F.col("gt") == 1)
    return r.groupBy("frame_id", "axis").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("length").alias("px"),
        F.max("length").alias("longest"),
        F.sum(F.col("start") * F.col("length")).alias("moment"),
    )


@query(
    "W6",
    f"""WITH {PIX}, {RUNS} SELECT frame_id, CAST(sum(length) FILTER (axis = 'x') AS BIGINT) AS px,
      CASE WHEN sum(length) FILTER (axis = 'x') >= 30 THEN median(length)::DOUBLE END AS median_run FROM rl GROUP BY frame_id""",
)
def median_run_length(spark, sf):
    return wi.median_run_length(pixels(spark, sf), F.col("gt") == 1)


def box_sql(values: dict[str, str], half: int, source: str = "pix") -> str:
    """Box sums with reflected borders by joining each offset: CTE ``box``."""
    sums = ", ".join(f"sum({e}) AS {n}" for n, e in values.items())
    again = ", ".join(f"sum({n}) AS {n}" for n in values)
    return f"""bx AS (SELECT t.frame_id, t.y, t.x, {sums} FROM {source} t, range(-{half}, {half + 1}) o JOIN {source} s
        ON s.frame_id = t.frame_id AND s.y = t.y AND s.x = CASE WHEN t.x + o.range < 0 THEN -1 - t.x - o.range
          WHEN t.x + o.range >= 32 THEN 63 - t.x - o.range ELSE t.x + o.range END GROUP BY ALL),
    box AS (SELECT t.frame_id, t.y, t.x, {again} FROM {source} t, range(-{half}, {half + 1}) o JOIN bx s
        ON s.frame_id = t.frame_id AND s.x = t.x AND s.y = CASE WHEN t.y + o.range < 0 THEN -1 - t.y - o.range
          WHEN t.y + o.range >= 24 THEN 47 - t.y - o.range ELSE t.y + o.range END GROUP BY ALL)"""


@query(
    "W7",
    f"""WITH {PIX}, {box_sql({'s': 's.r', 'q': 's.r*s.r', 'n': '1'}, 3)}
    SELECT frame_id, round(sum(s/n), 6) AS mean_sum, round(sum(sqrt(greatest(q/n - (s/n)*(s/n), 0.0))), 6) AS std_sum,
      CAST(sum(n) AS BIGINT) AS cells FROM box GROUP BY frame_id""",
)
def box_stats(spark, sf):
    d = wi.box_stats(_red(spark, sf), F.col("r"), 7, SIZE)
    return d.groupBy("frame_id").agg(
        r6(F.sum("box_mean")).alias("mean_sum"),
        r6(F.sum("box_std")).alias("std_sum"),
        F.sum("box_n").alias("cells"),
    )


@query(
    "W7",
    f"""WITH {PIX} SELECT t.frame_id, CAST(sum(s.r) AS BIGINT) AS total, count(*) AS cells FROM pix t JOIN pix s
      ON s.frame_id = t.frame_id AND s.y BETWEEN t.y - 2 AND t.y + 2 AND s.x BETWEEN t.x - 2 AND t.x + 2 GROUP BY t.frame_id""",
)
def box_stats_clipped(spark, sf):
    d = wi.box_sums(
        pixels(spark, sf),
        {"_s": F.col("r").cast("bigint"), "_n": F.lit(1).cast("bigint")},
        5,
        SIZE,
        "clip",
    )
    return d.groupBy("frame_id").agg(F.sum("_s").alias("total"), F.sum("_n").alias("cells"))


@query(
    "W8",
    f"""WITH {PIX}, {box_sql({'fs': 'CASE WHEN s.gt = 1 THEN s.g ELSE 0 END', 'bs': 'CASE WHEN s.gt = 1 THEN 0 ELSE s.g END', 'fn': 'CASE WHEN s.gt = 1 THEN 1 ELSE 0 END', 'bn': 'CASE WHEN s.gt = 1 THEN 0 ELSE 1 END'}, 3)}
    SELECT frame_id, count(*) FILTER (bn >= 30 AND fn >= 1) AS valid,
      round(sum(abs(fs/fn - bs/bn)) FILTER (bn >= 30 AND fn >= 1), 6) AS contrast_sum FROM box GROUP BY frame_id""",
)
def masked_contrast(spark, sf):
    d = wi.masked_contrast(pixels(spark, sf).select("frame_id", "y", "x", "g", "gt"), F.col("g"), F.col("gt") == 1, 7, SIZE, 30)
    return d.groupBy("frame_id").agg(
        F.count("contrast").alias("valid"), r6(F.sum("contrast")).alias("contrast_sum")
    )


STEN = """nb0 AS MATERIALIZED (SELECT frame_id, y, x, gt, dy, dx,
      CASE WHEN y + dy < 0 THEN 1 WHEN y + dy > 23 THEN 22 ELSE y + dy END AS sy,
      CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 31 THEN 30 ELSE x + dx END AS sx
      FROM pix, (SELECT a.range AS dy, b.range AS dx FROM range(-1, 2) a, range(-1, 2) b)),
    nb AS (SELECT t.*, s.r AS v FROM nb0 t JOIN pix s ON s.frame_id = t.frame_id AND s.y = t.sy AND s.x = t.sx),
    sten AS (SELECT frame_id, y, x, any_value(gt) AS gt, sum(v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END)::DOUBLE AS gx,
      sum(v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END)::DOUBLE AS gy,
      sum(v * CASE WHEN dx = 0 AND dy = 0 THEN -8 WHEN dx <> 0 AND dy <> 0 THEN 2 ELSE 0 END)::DOUBLE AS lap FROM nb GROUP BY ALL)"""


@query(
    "W9",
    f"""WITH {PIX}, {STEN} SELECT frame_id, round(sum(gx * (x+1)), 6) AS gx, round(sum(gy * (y+1)), 6) AS gy, round(sum(lap * (x+y+1)), 6) AS lap,
      round(sum(sqrt(gx*gx + gy*gy)), 6) AS grad FROM sten GROUP BY frame_id""",
)
def stencil(spark, sf):
    d = wi.stencil(_red(spark, sf), F.col("r"))
    x, y = F.col("x") + 1, F.col("y") + 1
    return d.groupBy("frame_id").agg(
        r6(F.sum(F.col("gx") * x)).alias("gx"),
        r6(F.sum(F.col("gy") * y)).alias("gy"),
        r6(F.sum(F.col("lap") * (x + y - 1))).alias("lap"),
        r6(F.sum("grad")).alias("grad"),
    )


@query(
    "W10",
    f"""WITH {PIX}, {STEN}, {box_sql({'s': 's.lap', 'q': 's.lap*s.lap', 'n': '1'}, 2, 'sten')}
    SELECT frame_id, round(avg(greatest(q/n - (s/n)*(s/n), 0.0)), 4) AS busy FROM box GROUP BY frame_id""",
)
def laplacian_variance(spark, sf):
    d = wi.laplacian_variance(_red(spark, sf), F.col("r"), 5, SIZE)
    return d.groupBy("frame_id").agg(F.round(F.avg("busy"), 4).alias("busy"))


RANGE5 = """lr AS (SELECT t.frame_id, t.y, t.x, max(s.r) - min(s.r) AS rg FROM pix t JOIN pix s ON s.frame_id = t.frame_id
      AND s.y BETWEEN t.y - 2 AND t.y + 2 AND s.x BETWEEN t.x - 2 AND t.x + 2 GROUP BY ALL)"""


@query(
    "W11",
    f"""WITH {PIX}, {STEN}, {RANGE5} SELECT frame_id, CAST(sum(rg) AS BIGINT) AS range_sum,
      round(sum(rg/(sqrt(gx*gx+gy*gy) + 0.001::DOUBLE)), 4) AS width_sum FROM lr JOIN sten USING (frame_id, y, x) GROUP BY frame_id""",
)
def local_range(spark, sf):
    d = wi.edge_width(_red(spark, sf), F.col("r"), 5, range_out="range")
    return d.groupBy("frame_id").agg(
        F.sum("range").cast("bigint").alias("range_sum"),
        F.round(F.sum("edge_width"), 4).alias("width_sum"),
    )


def _morph_sql(name: str, source: str, op: str, offsets: str) -> str:
    agg = "max" if op == "dilate" else "min"
    return f"""{name}0 AS MATERIALIZED (SELECT t.frame_id, t.y, t.x, t.y + o.dy AS sy, t.x + o.dx AS sx FROM {source} t, {offsets}),
    {name} AS (SELECT t.frame_id, t.y, t.x, {agg}(s.m) AS m FROM {name}0 t JOIN {source} s
      ON s.frame_id = t.frame_id AND s.y = t.sy AND s.x = t.sx GROUP BY ALL)"""


SQ1 = "(SELECT a.range AS dy, b.range AS dx FROM range(-1, 2) a, range(-1, 2) b) o"
EL2 = """(SELECT e.dy, b.range AS dx FROM (VALUES (-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) e(dy, hw), range(-2, 3) b WHERE abs(b.range) <= e.hw) o"""


@query(
    "W12",
    f"""WITH {PIX}, m0 AS (SELECT frame_id, y, x, CAST(pred_a = 2 AS INTEGER) AS m FROM pix),
    {_morph_sql('er', 'm0', 'erode', SQ1)}, {_morph_sql('op', 'er', 'dilate', SQ1)}, {_morph_sql('dl', 'm0', 'dilate', SQ1)},
    {_morph_sql('cl', 'dl', 'erode', SQ1)}, {_morph_sql('el', 'm0', 'dilate', EL2)}, {_morph_sql('ee', 'm0', 'erode', EL2)},
    a AS (SELECT 'erode' AS op, * FROM er UNION ALL SELECT 'open', * FROM op UNION ALL SELECT 'dilate', * FROM dl
      UNION ALL SELECT 'close', * FROM cl UNION ALL SELECT 'dilate_ellipse', * FROM el UNION ALL SELECT 'erode_ellipse', * FROM ee) """
    + digest_sql("a", "frame_id, op", ["m"]),
)
def morph(spark, sf):
    mask = F.col("pred_a") == 2
    jobs = [ra.Morph(mask, op, out=op) for op in ("erode", "open", "dilate", "close")]
    jobs += [ra.Morph(mask, op, 2, "ellipse", f"{op}_ellipse") for op in ("dilate", "erode")]
    px = ra.morphs(pixels(spark, sf).select("frame_id", "y", "x", "pred_a"), jobs)
    ops = ["erode", "open", "dilate", "close", "dilate_ellipse", "erode_ellipse"]
    rows = F.array(*[F.struct(F.lit(o).alias("op"), F.col(o).alias("m")) for o in ops])
    return digest(px.select("frame_id", "y", "x", F.inline(rows)), ["frame_id", "op"], ["m"])


MOTION = """mo AS (SELECT sample_id - sample_id % 5 AS clip, sample_id % 5 AS frame, point_id, px, py, pz FROM pts),
    md AS (SELECT *, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2) + pow(pz - lag(pz) OVER w, 2)) AS d FROM mo
      WINDOW w AS (PARTITION BY clip, point_id ORDER BY frame)),
    mf AS (SELECT clip, frame, count(*) AS n, avg(d) AS mean_d, max(d) AS max_d FROM md GROUP BY ALL)"""


def motion(spark, sf):
    s = F.col("sample_id")
    return points(spark, sf).withColumns({"clip": s - s % 5, "frame": s % 5})


@query(
    "W14",
    f"""WITH {PTS}, {MOTION} SELECT clip, count(*) AS frames, round(avg(mean_d), 9) AS mean_displacement, round(max(max_d), 9) AS max_displacement,
      min(n) = max(n) AS same_count, CAST(0 AS BIGINT) AS non_finite FROM mf GROUP BY clip""",
)
def frame_displacement(spark, sf):
    out = wi.frame_displacement(motion(spark, sf))
    return _round(out, r9, "mean_displacement", "max_displacement")


def dist_sql(name: str, seed: str, want: str = "TRUE") -> str:
    """Brute-force distance to the nearest seed pixel: CTE ``name``."""
    return f"""{name} AS (SELECT t.frame_id, t.y, t.x, min((t.y-s.y)*(t.y-s.y) + (t.x-s.x)*(t.x-s.x)) AS d2
      FROM (SELECT * FROM pix WHERE {want}) t JOIN (SELECT * FROM pix WHERE {seed}) s ON s.frame_id = t.frame_id GROUP BY ALL)"""


@query(
    "J12",
    f"""WITH {PIX}, s AS (SELECT frame_id, y, x, r FROM pix WHERE gt = 2),
    d AS (SELECT t.frame_id, t.y, t.x, min((((t.y-s.y)*(t.y-s.y) + (t.x-s.x)*(t.x-s.x))::BIGINT << 40) + (s.y::BIGINT << 20) + s.x) AS q
      FROM pix t JOIN s ON s.frame_id = t.frame_id GROUP BY ALL),
    v AS (SELECT d.frame_id, sqrt(q >> 40) AS dist, s.r AS r_near, d.y, d.x FROM d JOIN s ON s.frame_id = d.frame_id AND s.y = ((q >> 20) & 1048575) AND s.x = (q & 1048575))
    SELECT frame_id, count(*) AS n, round(sum(dist), 6) AS dist_sum, CAST(sum(r_near*(y*37+x+1)) AS BIGINT) AS near_sum FROM v GROUP BY frame_id""",
)
def mask_nearest(spark, sf):
    out = di.value_of_nearest(pixels(spark, sf).select("frame_id", "y", "x", "gt", "r"), F.col("gt") == 2, ["r"])
    known = out.filter(F.col("dist").isNotNull())
    place = F.col("y") * 37 + F.col("x") + 1
    return known.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.sum("dist")).alias("dist_sum"),
        F.sum(F.col("r_near") * place).alias("near_sum"),
    )


@query(
    "W15",
    f"""WITH {PIX}, {dist_sql('din', 'gt = 2')}, {dist_sql('dout', 'gt <> 2')},
    sd AS (SELECT pix.set_id, sqrt(din.d2) - sqrt(dout.d2) AS sd, prob_pm FROM pix JOIN din USING (frame_id, y, x) JOIN dout USING (frame_id, y, x)
      WHERE sqrt(din.d2) <= 5 AND sqrt(dout.d2) <= 5),
    b AS (SELECT set_id, CAST(floor((sd + 4)/0.25) AS INTEGER) AS bin, count(*) AS n, avg(prob_pm/500.0::DOUBLE) AS mean FROM sd WHERE abs(sd) <= 4 AND sd < 4 GROUP BY ALL HAVING count(*) >= 4)
    SELECT set_id, bin, n, round(mean, 9) AS mean, ((bin + 0.5)*0.25 - 4)::DOUBLE AS centre FROM b""",
)
def edge_profile(spark, sf):
    px = pixels(spark, sf)
    out = di.edge_profile(px, F.col("prob_pm") / 500.0, F.col("gt") == 2, by=["set_id"])
    return _round(out, r9, "mean")
