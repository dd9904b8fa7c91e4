"""Queries of the loss metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import losses as ls
from pixelmill.operators.geometry import hflip
from pixelmill.plans.fixtures import SCORES, W, scores
from pixelmill.plans.registry import query, r6, r9


def _with_prob(spark, sf):
    return scores(spark, sf).withColumn("prob", ls.softmax("logits"))


ARG = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END"


@query(
    "L1",
    f"""WITH {SCORES} SELECT set_id, CAST({ARG.format('logits[1]', 'logits[2]', 'logits[3]')} AS INTEGER) AS pred,
      count(*) AS n, round(avg(greatest(p0, p1, p2)), 9) AS mean_top FROM sm GROUP BY ALL""",
)
def softmax_argmax(spark, sf):
    out = ls.softmax_argmax(scores(spark, sf).drop("prob_pm"))
    return out.groupBy("set_id", "pred").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg(F.array_max("prob"))).alias("mean_top")
    )


@query(
    "L2",
    f"""WITH {SCORES}, t AS (SELECT a.frame_id, a.y, a.x, a.logits[1] + b.teacher[1] AS l0, a.logits[2] + b.teacher[2] AS l1,
      a.logits[3] + b.teacher[3] AS l2 FROM scores a JOIN scores b ON a.frame_id = b.frame_id AND a.y = b.y AND a.x = 31 - b.x)
    SELECT frame_id, CAST({ARG.format('l0', 'l1', 'l2')} AS INTEGER) AS pred, count(*) AS n,
      round(sum(l0 + 2*l1 + 3*l2), 6) AS total FROM t GROUP BY ALL""",
)
def tta_merge(spark, sf):
    s = scores(spark, sf)
    plain = s.select("frame_id", "y", "x", "logits")
    mirrored = hflip(s.select("frame_id", "y", "x", F.col("teacher").alias("logits")), W)
    out = ls.tta_merge([plain, mirrored])
    a = F.col("logits")
    return out.groupBy("frame_id", "pred").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(a[0] + 2 * a[1] + 3 * a[2])).alias("total")
    )


@query(
    "L3",
    f"""WITH {SCORES}, w AS (SELECT frame_id, y, x, w.x0, [logits[1] + w.x0, logits[2], logits[3]] AS l
      FROM scores, (VALUES (0), (8), (16)) w(x0) WHERE x BETWEEN w.x0 AND w.x0 + 15),
    m AS (SELECT frame_id, y, x, count(*) AS c, avg(l[1]) AS a, avg(l[2]) AS b, avg(l[3]) AS d FROM w GROUP BY ALL)
    SELECT frame_id, c AS overlaps, count(*) AS n, round(sum(a + 2*b + 3*d), 6) AS total FROM m GROUP BY ALL""",
)
def overlap_merge(spark, sf):
    s = scores(spark, sf).select("frame_id", "y", "x", "logits")
    starts = F.filter(
        F.array(F.lit(0), F.lit(8), F.lit(16)),
        lambda x0: (F.col("x") >= x0) & (F.col("x") <= x0 + 15),
    )
    a = F.col("logits")
    win = s.select("*", F.explode(starts).alias("x0")).select(
        "frame_id",
        F.lit(0).alias("y0"),
        "x0",
        "y",
        (F.col("x") - F.col("x0")).alias("x"),
        F.array(a[0] + F.col("x0"), a[1], a[2]).alias("logits"),
    )
    out = ls.overlap_merge(win, 3)
    return out.groupBy("frame_id", "overlaps").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(a[0] + 2 * a[1] + 3 * a[2])).alias("total")
    )


@query(
    "L4",
    f"""WITH {SCORES} SELECT set_id, count(*) AS valid,
      round(avg(-(logits[gt+1] - ln(z)) * ([0.5, 1.0, 3.0])[gt+1]), 9) AS log_loss FROM prob WHERE gt <> 255 GROUP BY set_id""",
)
def weighted_log_loss(spark, sf):
    out = ls.weighted_log_loss(scores(spark, sf), [0.5, 1.0, 3.0], by=["set_id"])
    return out.withColumn("log_loss", r9(F.col("log_loss")))


LOVASZ = """e AS (SELECT set_id, frame_id, c.cls, CAST(gt = c.cls AS INTEGER) AS fg,
      abs(CAST(gt = c.cls AS DOUBLE) - CASE c.cls WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS err FROM sm, (VALUES (0),(1),(2)) c(cls)),
    d AS (SELECT {by}, cls, err, sum(fg) AS fg, count(*) AS n FROM e GROUP BY ALL),
    k AS (SELECT *, sum(fg) OVER (PARTITION BY {by}, cls ORDER BY err DESC) AS cf, sum(n) OVER (PARTITION BY {by}, cls ORDER BY err DESC) AS cn,
      sum(fg) OVER (PARTITION BY {by}, cls) AS gts FROM d),
    j AS (SELECT *, 1.0::DOUBLE - (gts - cf)/(gts + cn - cf) AS j1,
      CASE WHEN cn > n THEN 1.0::DOUBLE - (gts - (cf-fg))/(gts + (cn-n) - (cf-fg)) ELSE 0.0 END AS j0 FROM k WHERE gts > 0),
    l AS (SELECT {by}, cls, sum(err * (j1 - j0)) AS loss FROM j GROUP BY ALL)
    SELECT {by}, round(sum(loss * ([1.0, 1.0, 2.0])[cls+1]) / sum(([1.0, 1.0, 2.0])[cls+1]), 9) AS lovasz,
      count(*) AS classes_present FROM l GROUP BY {by}"""


@query("L5", f"WITH {SCORES}, " + LOVASZ.format(by="set_id"))
def lovasz_pooled(spark, sf):
    out = ls.lovasz_score(_with_prob(spark, sf), ["set_id"], 3, [1.0, 1.0, 2.0])
    return out.withColumn("lovasz", r9(F.col("lovasz")))


@query("L5", f"WITH {SCORES}, " + LOVASZ.format(by="frame_id"))
def lovasz_per_frame(spark, sf):
    out = ls.lovasz_score(
        _with_prob(spark, sf), ["frame_id"], 3, [1.0, 1.0, 2.0], bounded_groups=True
    )
    return out.withColumn("lovasz", r9(F.col("lovasz")))


@query(
    "L5",
    f"""WITH {SCORES}, e0 AS (SELECT frame_id, CASE WHEN gt = 2 THEN 1 ELSE 0 END AS t, logits[3] - logits[1] AS z FROM prob WHERE gt <> 0 OR frame_id % 3 > 0),
    e AS (SELECT frame_id, t, 1.0::DOUBLE - z * (2.0::DOUBLE * t - 1.0::DOUBLE) AS err FROM e0),
    m AS (SELECT frame_id, err, CAST(sum(t) AS BIGINT) AS fg, count(*) AS n FROM e GROUP BY ALL),
    k AS (SELECT *, sum(fg) OVER w AS cf, sum(n) OVER w AS cn, sum(fg) OVER (PARTITION BY frame_id) AS gts FROM m WINDOW w AS (PARTITION BY frame_id ORDER BY err DESC)),
    j AS (SELECT *, 1.0::DOUBLE - (gts - cf)/(gts + cn - cf) AS j1, CASE WHEN cn > n THEN 1.0::DOUBLE - (gts - (cf-fg))/(gts + (cn-n) - (cf-fg)) ELSE 0.0 END AS j0 FROM k),
    l AS (SELECT frame_id, sum(greatest(err, 0) * (j1 - j0)) AS loss FROM j GROUP BY frame_id)
    SELECT f.frame_id, round(coalesce(loss, 0), 9) AS hinge FROM (SELECT DISTINCT frame_id FROM prob) f LEFT JOIN l ON l.frame_id = f.frame_id""",
)
def lovasz_hinge(spark, sf):
    # background of every third frame is ignored
    skip = (F.col("gt") == 0) & (F.col("frame_id") % 3 == 0)
    label = F.when(skip, 255).when(F.col("gt") == 2, 1).otherwise(0)
    d = scores(spark, sf).withColumns({"gt": label, "logit": F.col("logits")[2] - F.col("logits")[0]})
    return ls.lovasz_hinge(d, ["frame_id"]).withColumn("hinge", r9(F.col("hinge")))


@query(
    "L6",
    f"""WITH {SCORES}, a AS (SELECT set_id, gt, logits, z, teacher AS t,
      exp(logits[1]/4)+exp(logits[2]/4)+exp(logits[3]/4) AS zs, exp(teacher[1]/4)+exp(teacher[2]/4)+exp(teacher[3]/4) AS zt FROM prob),
    b AS (SELECT set_id, -(logits[gt+1] - ln(z)) AS ce,
      exp(t[1]/4)/zt*((t[1]/4-ln(zt))-(logits[1]/4-ln(zs))) + exp(t[2]/4)/zt*((t[2]/4-ln(zt))-(logits[2]/4-ln(zs)))
      + exp(t[3]/4)/zt*((t[3]/4-ln(zt))-(logits[3]/4-ln(zs))) AS kl FROM a)
    SELECT set_id, round(avg(ce), 9) AS ce, round(avg(kl)*16, 9) AS kl,
      round(0.3::DOUBLE*avg(ce) + 0.7::DOUBLE*avg(kl)*16, 9) AS total FROM b GROUP BY set_id""",
)
def kl_distill(spark, sf):
    out = ls.kl_distill(scores(spark, sf), 0.3, 4.0, ["set_id"])
    return out.withColumns({c: r9(F.col(c)) for c in ("ce", "kl", "total")})


@query(
    "L7",
    f"""WITH {SCORES}, f AS (SELECT set_id, logits[c.cls+1] AS z, CAST(gt = c.cls AS DOUBLE) AS t FROM scores, (VALUES (0),(1),(2)) c(cls)),
    g AS (SELECT set_id, z, t, 1/(1+exp(-z)) AS p FROM f)
    SELECT set_id, round(avg((greatest(z, 0) - z*t + ln(1 + exp(-abs(z)))) * (0.25*t + 0.75*(1-t)) * pow((1-p)*t + p*(1-t), 2.0)), 9) AS focal
    FROM g GROUP BY set_id""",
)
def focal_score(spark, sf):
    out = ls.focal_score(scores(spark, sf), 3, alpha=0.25, by=["set_id"])
    return out.withColumn("focal", r9(F.col("focal")))


FRAMESUM = """q AS (SELECT set_id, frame_id, c.cls, CASE c.cls WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p,
      CAST(gt = c.cls AS DOUBLE) AS t FROM sm, (VALUES (0),(1),(2)) c(cls))"""


@query(
    "L7",
    f"""WITH {SCORES}, {FRAMESUM}, s AS (SELECT set_id, frame_id, cls, sum(p*t) AS tp, sum(p*(1-t)) AS fp, sum((1-p)*t) AS fn FROM q GROUP BY ALL)
    SELECT set_id, round(avg(1 - (tp + 1)/(tp + 0.3::DOUBLE*fp + 0.7::DOUBLE*fn + 1)), 9) AS tversky FROM s GROUP BY set_id""",
)
def tversky_score(spark, sf):
    out = ls.tversky_score(_with_prob(spark, sf), 3, by=["set_id"])
    return out.withColumn("tversky", r9(F.col("tversky")))


@query(
    "L7",
    f"""WITH {SCORES}, {FRAMESUM}, s AS (SELECT set_id, frame_id, cls, sum(p*t) AS num, sum(p*p + t*t) AS den FROM q GROUP BY ALL)
    SELECT set_id, round(avg(1 - (2*num + 1)/(den + 1)), 9) AS dice_loss FROM s GROUP BY set_id""",
)
def soft_dice(spark, sf):
    out = ls.soft_dice(_with_prob(spark, sf), 3, by=["set_id"])
    return out.withColumn("dice_loss", r9(F.col("dice_loss")))
