"""Queries of the confusion family."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import metrics as m
from pixelmill.plans.fixtures import PIX, SCORES, label_pairs, pixels, scores
from pixelmill.plans.registry import query, r9

CM = "cm AS (SELECT set_id, gt, pred_a AS pred, count(*) AS n FROM pix GROUP BY ALL)"
CLS = """cls AS (SELECT set_id, c.cls AS cls,
  CAST(sum(CASE WHEN gt = c.cls AND pred = c.cls THEN n ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN gt <> c.cls AND pred = c.cls THEN n ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN gt = c.cls AND pred <> c.cls THEN n ELSE 0 END) AS BIGINT) AS fn
  FROM cm, (VALUES (0), (1), (2)) c(cls) GROUP BY ALL)"""
RATES = """round(coalesce(tp / nullif(tp + fp + fn, 0), 0.0), 9) AS iou,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS recall"""


def _cm(spark, sf):
    return m.confusion(pixels(spark, sf), ["set_id"], pred="pred_a")


def _rates(df, *cols):
    return df.withColumns({c: r9(F.col(c)) for c in cols})


@query("A1", f"WITH {PIX}, {CM} SELECT * FROM cm")
def confusion_by_set(spark, sf):
    return _cm(spark, sf)


@query(
    "A1",
    """SELECT source, quality AS gt, toxic AS pred, count(*) AS n
       FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
)
def confusion_on_document_labels(spark, sf):
    return m.confusion(label_pairs(spark, sf), ["source"], k=2)


@query("A2", f"WITH {PIX}, {CM}, {CLS} SELECT *, {RATES} FROM cls")
def class_metrics(spark, sf):
    return _rates(m.class_metrics(_cm(spark, sf), ["set_id"]), "iou", "precision", "recall")


@query(
    "A2, A6",
    f"""WITH {PIX}, {CM}, {CLS}, i AS (SELECT *, coalesce(tp/nullif(tp+fp+fn,0),0.0) AS iou,
      coalesce(tp/nullif(tp+fn,0),0.0) AS rec FROM cls)
    SELECT set_id, round(avg(iou), 9) AS miou, round(avg(iou) FILTER (cls > 0), 9) AS miou_no_bg,
      round(avg(rec), 9) AS mean_acc, round(sum(tp)/sum(tp+fn), 9) AS pixel_acc,
      round(sum((tp+fn)*iou)/sum(tp+fn), 9) AS freq_iou FROM i GROUP BY set_id""",
)
def mean_metrics(spark, sf):
    out = m.mean_metrics(_cm(spark, sf), ["set_id"])
    return _rates(out, "miou", "miou_no_bg", "mean_acc", "pixel_acc", "freq_iou")


@query(
    "A6",
    f"""WITH {PIX}, {CM}, {CLS}, i AS (SELECT *, coalesce(tp/nullif(tp+fp+fn,0),0.0) AS iou,
      coalesce(tp/nullif(tp+fn,0),0.0) AS rec FROM cls)
    SELECT set_id, round(sum((tp+fn)*iou)/sum(tp+fn), 9) AS freq_iou, round(avg(rec), 9) AS mean_acc,
      round(avg(iou) FILTER (cls > 0), 9) AS miou_no_bg FROM i GROUP BY set_id""",
)
def freq_weighted_iou(spark, sf):
    return _rates(
        m.freq_weighted_iou(_cm(spark, sf), ["set_id"]), "freq_iou", "mean_acc", "miou_no_bg"
    )


@query(
    "A3",
    f"""WITH {PIX}, c AS (SELECT camera, count(*) FILTER (gt>0 AND pred_a>0) AS tp,
      count(*) FILTER (gt=0 AND pred_a>0) AS fp, count(*) FILTER (gt>0 AND pred_a=0) AS fn,
      count(*) FILTER (gt=0 AND pred_a=0) AS tn FROM pix GROUP BY camera)
    SELECT *, {RATES}, round(2*tp/(2*tp+fp+fn), 9) AS f1, round((tp+tn)/(tp+fp+fn+tn), 9) AS accuracy
    FROM c""",
)
def binary_metrics(spark, sf):
    out = m.binary_metrics(pixels(spark, sf), F.col("gt") > 0, F.col("pred_a") > 0, ["camera"])
    return _rates(out, "iou", "precision", "recall", "f1", "accuracy")


@query(
    "A4",
    f"""WITH {PIX}, cmk AS (
      SELECT 'pooled' AS scope, 'all' AS value, gt, pred_a AS pred, count(*) AS n FROM pix GROUP BY ALL
      UNION ALL SELECT 'set_id', CAST(set_id AS VARCHAR), gt, pred_a, count(*) FROM pix GROUP BY ALL
      UNION ALL SELECT 'camera', camera, gt, pred_a, count(*) FROM pix GROUP BY ALL),
    cls AS (SELECT scope, value, c.cls AS cls,
      CAST(sum(CASE WHEN gt = c.cls AND pred = c.cls THEN n ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN gt <> c.cls AND pred = c.cls THEN n ELSE 0 END) AS BIGINT) AS fp,
      CAST(sum(CASE WHEN gt = c.cls AND pred <> c.cls THEN n ELSE 0 END) AS BIGINT) AS fn
      FROM cmk, (VALUES (0), (1), (2)) c(cls) GROUP BY ALL)
    SELECT *, {RATES} FROM cls""",
)
def pooled_and_grouped_metrics(spark, sf):
    out = m.pooled_and_grouped(pixels(spark, sf), ["set_id", "camera"], pred="pred_a")
    return _rates(out, "iou", "precision", "recall")


@query(
    "A5",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id, count(*) FILTER (gt=2 AND pred_a=2) AS tp,
      count(*) FILTER (gt<>2 AND pred_a=2) AS fp, count(*) FILTER (gt=2 AND pred_a<>2) AS fn
      FROM pix GROUP BY ALL),
    i AS (SELECT *, tp/nullif(tp+fp+fn,0) AS iou FROM f)
    SELECT camera, count(*) AS frames, round(sum(tp)/sum(tp+fp+fn), 9) AS pooled_iou,
      round(avg(iou), 9) AS mean_iou, round(min(iou), 9) AS min_iou, round(max(iou), 9) AS max_iou
    FROM i GROUP BY camera""",
)
def pooled_vs_mean_iou(spark, sf):
    out = m.pooled_vs_mean_iou(
        pixels(spark, sf), "frame_id", F.col("gt") == 2, F.col("pred_a") == 2, ["camera"]
    )
    return _rates(out, "pooled_iou", "mean_iou", "min_iou", "max_iou")


@query(
    "A7",
    f"""WITH {PIX}, {CM}, {CLS}, r AS (SELECT *, coalesce(tp/nullif(tp+fp,0),0.0) AS p,
      coalesce(tp/nullif(tp+fn,0),0.0) AS q FROM cls)
    SELECT set_id, cls, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0.0), 9) AS dice,
      round(coalesce(5.0*p*q/nullif(4.0*p+q,0),0.0), 9) AS fscore FROM r""",
)
def dice_and_fscore(spark, sf):
    return _rates(m.dice_fscore(_cm(spark, sf), ["set_id"], beta=2.0), "dice", "fscore")


@query(
    "A8",
    f"""WITH {PIX}, {CM} SELECT set_id, gt, pred, n,
      round(n / sum(n) OVER (PARTITION BY set_id, gt), 9) AS share FROM cm""",
)
def row_normalised_confusion(spark, sf):
    return _rates(m.row_normalised(_cm(spark, sf), ["set_id"]), "share")


@query(
    "A9",
    f"""WITH {PIX}, {CM}, f AS (SELECT set_id, CASE WHEN gt = 2 THEN 'fn' ELSE 'fp' END AS kind,
      CASE WHEN gt = 2 THEN pred ELSE gt END AS other, n FROM cm
      WHERE gt <> pred AND (gt = 2 OR pred = 2))
    SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY set_id, kind), 9) AS pct FROM f""",
)
def error_flow(spark, sf):
    return _rates(m.error_flow(_cm(spark, sf), 2, ["set_id"]), "pct")


@query(
    "A10",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id, count(*) FILTER (pred_a > 0) AS fg,
      100.0 * count(*) FILTER (pred_a > 0) / count(*) AS pct FROM pix GROUP BY ALL)
    SELECT camera, count(*) AS frames, CAST(sum(fg) AS BIGINT) AS fg_px, round(avg(pct), 9) AS mean_pct
    FROM f GROUP BY camera""",
)
def coverage(spark, sf):
    return _rates(
        m.mean_coverage(pixels(spark, sf), F.col("pred_a") > 0, "frame_id", ["camera"]), "mean_pct"
    )


@query(
    "A34",
    f"""WITH {PIX}, c AS (SELECT set_id, label6, count(*) AS n FROM pix GROUP BY ALL)
    SELECT set_id, label6, n, round(n / sum(n) OVER s, 9) AS share,
      round((1.0/n) / avg(1.0/n) OVER s, 9) AS weight FROM c WINDOW s AS (PARTITION BY set_id)""",
)
def class_frequency(spark, sf):
    return _rates(m.class_frequency(pixels(spark, sf), "label6", ["set_id"]), "share", "weight")


@query(
    "A31",
    f"""WITH {PIX}, f AS (SELECT camera, frame_id,
      count(*) FILTER (pred_a <> pred_b) / count(*) AS mm FROM pix GROUP BY ALL)
    SELECT camera, count(*) AS frames, round(avg(mm), 9) AS mean_mismatch, round(max(mm), 9) AS max_mismatch,
      round(avg(CASE WHEN mm > 0.001 THEN 1.0 ELSE 0.0 END), 9) AS share_gt_0p1pct,
      round(avg(CASE WHEN mm > 0.005 THEN 1.0 ELSE 0.0 END), 9) AS share_gt_0p5pct,
      round(avg(CASE WHEN mm = 0 THEN 1.0 ELSE 0.0 END), 9) AS share_zero,
      round(median(mm), 9) AS median_mismatch FROM f GROUP BY camera""",
)
def disagreement(spark, sf):
    from pixelmill.operators.ordered import exact_percentiles

    px = pixels(spark, sf)
    per = m.disagreement_per_frame(px, "pred_a", "pred_b", "frame_id", ["camera"])
    median = exact_percentiles(per, ["camera"], "mismatch", {"median_mismatch": 0.5}).drop("n")
    out = m.disagreement(px, "pred_a", "pred_b", "frame_id", ["camera"]).join(median, "camera")
    return _rates(
        out,
        "mean_mismatch",
        "max_mismatch",
        "share_gt_0p1pct",
        "share_gt_0p5pct",
        "share_zero",
        "median_mismatch",
    )


@query(
    "A36",
    f"""WITH {PIX}, c AS (SELECT frame_id, label6 AS v, count(*) AS n FROM pix WHERE gt = 2 GROUP BY ALL),
    k AS (SELECT frame_id, v, n, sum(n) OVER (PARTITION BY frame_id) AS t,
      row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, v) AS rn FROM c)
    SELECT f.p_partkey AS frame_id, coalesce(CAST(v AS VARCHAR), 'none') AS mode,
      round(coalesce(n / t, 0.0), 9) AS share
    FROM part f LEFT JOIN k ON k.frame_id = f.p_partkey AND rn = 1""",
)
def mode_share(spark, sf):
    out = m.mode_share(pixels(spark, sf), ["frame_id"], "label6", F.col("gt") == 2)
    return _rates(out, "share")


@query(
    "A37",
    f"""WITH {SCORES}, r AS (SELECT set_id, [p0, p1, p2] AS pr, gt FROM sm),
    o AS (SELECT set_id, pr[gt+1] AS own,
      len(list_filter(range(3), lambda i: pr[i+1] > pr[gt+1] OR (pr[i+1] = pr[gt+1] AND i < gt))) AS ahead FROM r)
    SELECT set_id, count(*) AS valid,
      round(avg(CASE WHEN ahead < 2 AND own > 0.2 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM o GROUP BY set_id""",
)
def topk_accuracy(spark, sf):
    from pixelmill.operators.losses import softmax

    s = scores(spark, sf).withColumn("prob", softmax("logits"))
    return _rates(m.topk_accuracy(s, 2, thresh=0.2, by=["set_id"]), "accuracy")
