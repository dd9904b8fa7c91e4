"""Queries of the recode, subset and geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import geometry as geo
from pixelmill.operators import recode as rc
from pixelmill.plans.digest import digest, digest_sql
from pixelmill.plans.fixtures import MAN, PIX, PTS, H, W, manifest, pixels, points, table
from pixelmill.plans.registry import query, r9


def _uniform_sql(seed: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(
    "P1",
    f"""WITH {PIX} SELECT set_id, label6, CAST(CASE WHEN label6 IN (0,5) THEN 0 WHEN label6 = 4 THEN 2
      ELSE 1 END AS INTEGER) AS label3, count(*) AS n FROM pix GROUP BY ALL""",
)
def recode_labels(spark, sf):
    out = rc.recode_labels(pixels(spark, sf), col="label6")
    return out.groupBy("set_id", "label6", "label3").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P2, P3, P4, P5",
    f"""WITH {PIX} SELECT label6, CAST(CASE WHEN label6 = 0 THEN 255 ELSE label6 - 1 END AS INTEGER) AS cache_label,
      CAST(label6 BETWEEN 1 AND 4 AS INTEGER) AS binary,
      CAST(label6 BETWEEN 1 AND 5 AS INTEGER) AS binary_noise,
      CAST(CASE WHEN label6 > 0 THEN 1 WHEN depth_mm > 0 THEN 2 ELSE 0 END AS INTEGER) AS label3,
      CAST(r >= 127 AS INTEGER) AS mask, count(*) AS n FROM pix GROUP BY ALL""",
)
def label_recodes(spark, sf):
    px = rc.legacy_cache_label(pixels(spark, sf), "label6")
    px = rc.binary_label(px, False, "label6", "binary")
    px = rc.binary_label(px, True, "label6", "binary_noise")
    px = rc.three_way_from_depth(px, "label6")
    px = rc.threshold_mask(px, "r", 127)
    keys = ["label6", "cache_label", "binary", "binary_noise", "label3", "mask"]
    return px.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P6",
    f"""WITH {PIX}, d AS (SELECT set_id, CAST(CASE WHEN depth_mm = 0 THEN 0 ELSE
      floor((greatest(least(depth_mm, 1500), 500) - 500) / 1000.0::DOUBLE * 254 + 1) END AS INTEGER) AS depth8 FROM pix)
    SELECT set_id, depth8, count(*) AS n FROM d GROUP BY ALL""",
)
def depth16_to_8(spark, sf):
    out = rc.depth16_to_8(pixels(spark, sf))
    return out.groupBy("set_id", "depth8").agg(F.count(F.lit(1)).alias("n"))


DEPTHNORM = """win AS (SELECT frame_id, count(*) FILTER (gt > 0 AND depth_mm > 0) AS no, count(*) FILTER (depth_mm > 0) AS na,
      list_sort(list(depth_mm::DOUBLE) FILTER (gt > 0 AND depth_mm > 0)) AS po,
      list_sort(list(depth_mm::DOUBLE) FILTER (depth_mm > 0)) AS pa FROM pix GROUP BY frame_id),
    w1 AS (SELECT frame_id, CASE WHEN no >= 50 THEN po WHEN na >= 50 THEN pa END AS l FROM win),
    w2 AS (SELECT frame_id, list_transform([0.02::DOUBLE, 0.98::DOUBLE], lambda f: CASE WHEN f*(len(l)-1) = floor(f*(len(l)-1)) THEN l[CAST(f*(len(l)-1) AS BIGINT)+1]
      ELSE (ceil(f*(len(l)-1)) - f*(len(l)-1)) * l[CAST(floor(f*(len(l)-1)) AS BIGINT)+1]
        + (f*(len(l)-1) - floor(f*(len(l)-1))) * l[CAST(ceil(f*(len(l)-1)) AS BIGINT)+1] END) AS q FROM w1),
    w3 AS (SELECT frame_id, q[1] - 0.1::DOUBLE*(q[2]-q[1]) AS lo, q[2] + 0.1::DOUBLE*(q[2]-q[1]) AS hi, q[2]-q[1] >= 0.001 AS ok FROM w2),
    dn AS (SELECT pix.*, CAST(CASE WHEN ok AND depth_mm > 0 THEN
      round_even(greatest(0.0, least(1.0, (depth_mm - lo)/(hi - lo))) * 255.0, 0) ELSE 0 END AS INTEGER) AS depth_norm
      FROM pix JOIN w3 USING (frame_id))"""


@query("P7", f"WITH {PIX}, {DEPTHNORM} " + digest_sql("dn", "frame_id", ["depth_norm"]))
def depth_window_normalise(spark, sf):
    out = rc.depth_window_normalise(pixels(spark, sf), F.col("gt") > 0)
    return digest(out, ["frame_id"], ["depth_norm"])


@query("P8", f"WITH {MAN} SELECT * FROM man WHERE set_id IN (0, 4, 32, 36)")
def filter_sets(spark, sf):
    return rc.filter_sets(manifest(spark, sf), [0, 4, 32, 36])


@query(
    "P8",
    f"""WITH {MAN}, s AS (SELECT set_id FROM man GROUP BY set_id ORDER BY min(line_no), set_id LIMIT 5)
    SELECT man.* FROM man WHERE set_id IN (SELECT set_id FROM s)""",
)
def first_n_sets(spark, sf):
    return rc.first_n_sets(manifest(spark, sf), 5)


@query(
    "P9",
    """SELECT p_partkey, p_type AS category FROM part
       WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_type NOT IN ('PROMO')""",
)
def filter_category(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"))
    return rc.filter_category(parts, ["ECONOMY", "STANDARD", "PROMO"], ["PROMO"])


@query(
    "P10",
    f"""WITH {MAN}, i AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY line_no) - 1 AS i FROM man)
    SELECT * EXCLUDE (i) FROM i WHERE i >= 2 AND (i - 2) % 5 = 0""",
)
def every_nth(spark, sf):
    return rc.every_nth(manifest(spark, sf), ["dataset"], ["line_no"], 5, 2)


@query(
    "P11",
    f"""WITH {MAN}, i AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY line_no) - 1 AS i,
      count(*) OVER (PARTITION BY dataset) AS n FROM man),
    k AS (SELECT DISTINCT dataset, (j.range * (n - 1)) // (least(7, n) - 1) AS at FROM i, range(7) j WHERE j.range < least(7, n))
    SELECT i.* EXCLUDE (i, n) FROM i JOIN k ON k.dataset = i.dataset AND k.at = i.i""",
)
def evenly_spaced(spark, sf):
    return rc.evenly_spaced(manifest(spark, sf), ["dataset"], ["line_no"], 7)


@query(
    "P12",
    f"WITH {MAN} SELECT * FROM man ORDER BY md5('3|' || base), base LIMIT 50",
)
def seeded_sample(spark, sf):
    return rc.seeded_sample(manifest(spark, sf), 50, 3, "base")


@query(
    "P13",
    f"""WITH {PIX}, c AS (SELECT frame_id, y, x - 4 AS x, gt, r FROM pix WHERE x - 4 BETWEEN 0 AND 23) """
    + digest_sql("c", "frame_id", ["gt", "r"]),
)
def crop_to_aspect(spark, sf):
    return digest(geo.crop_to_aspect(pixels(spark, sf), 1.0), ["frame_id"], ["gt", "r"])


@query(
    "P14",
    f"""WITH {PIX}, t AS (SELECT ty.range AS y, tx.range AS x FROM range(36) ty, range(20) tx),
    c AS (SELECT frame_id, t.y, t.x, gt, r FROM t JOIN pix ON pix.y = (t.y*24)//36 AND pix.x = (t.x*32)//20) """
    + digest_sql("c", "frame_id", ["gt", "r"]),
)
def resize_nearest(spark, sf):
    px = pixels(spark, sf).select("frame_id", "y", "x", "gt", "r")
    return digest(geo.resize_nearest(px, (H, W), (36, 20)), ["frame_id"], ["gt", "r"])


AREA = """t AS (SELECT ty.range AS ty, tx.range AS tx FROM range(10) ty, range(12) tx),
    ov AS (SELECT frame_id, ty AS y, tx AS x, (gt = 2)::INT AS v,
      (least((pix.y+1)*10, (ty+1)*24) - greatest(pix.y*10, ty*24)) * (least((pix.x+1)*12, (tx+1)*32) - greatest(pix.x*12, tx*32)) AS wt
      FROM pix JOIN t ON (pix.y+1)*10 > ty*24 AND pix.y*10 < (ty+1)*24 AND (pix.x+1)*12 > tx*32 AND pix.x*12 < (tx+1)*32),
    ar AS (SELECT frame_id, y, x, sum(v*wt)/sum(wt) AS mean FROM ov GROUP BY ALL)"""


@query(
    "P15",
    f"""WITH {PIX}, {AREA} SELECT frame_id, count(*) AS cells, round(sum(mean), 9) AS total,
      count(*) FILTER (mean >= 0.5) AS mask_px FROM ar GROUP BY frame_id""",
)
def resize_area(spark, sf):
    px = pixels(spark, sf).select("frame_id", "y", "x", (F.col("gt") == 2).cast("int").alias("v"))
    small = geo.resize_area(px, (H, W), (10, 12), "v")
    return small.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("cells"),
        r9(F.sum("v")).alias("total"),
        F.count_if(F.col("v") >= 0.5).alias("mask_px"),
    )


@query(
    "P16",
    f"""WITH {PIX}, t AS (SELECT ty.range AS y, tx.range AS x FROM range(20) ty, range(20) tx),
    b AS (SELECT frame_id, t.y + 2 AS y, t.x AS x, r FROM t JOIN pix ON t.y < 15 AND pix.y = (t.y*24)//15 AND pix.x = (t.x*32)//20),
    c AS (SELECT p_partkey AS frame_id, t.y, t.x, coalesce(b.r, 114) AS r FROM part CROSS JOIN t
      LEFT JOIN b ON b.frame_id = p_partkey AND b.y = t.y AND b.x = t.x) """
    + digest_sql("c", "frame_id", ["r"]),
)
def letterbox(spark, sf):
    return digest(geo.letterbox(pixels(spark, sf), (H, W), (20, 20), ["r"], 114), ["frame_id"], ["r"])


@query(
    "P17",
    f"WITH {PIX}, c AS (SELECT frame_id, y, 31 - x AS x, gt FROM pix) "
    + digest_sql("c", "frame_id", ["gt"]),
)
def hflip(spark, sf):
    return digest(geo.hflip(pixels(spark, sf), W), ["frame_id"], ["gt"])


@query(
    "P18",
    f"""WITH {PIX}, u AS (SELECT p_partkey AS frame_id, CASE WHEN {_uniform_sql('7/p', 'p_partkey')} < 0.5
        THEN 0.5 + 0.5 * {_uniform_sql('7/f', 'p_partkey')} ELSE 1.0::DOUBLE END AS f FROM part),
    s AS (SELECT frame_id, CAST(greatest(1, round_even(24*f, 0)) AS BIGINT) AS ch, CAST(greatest(1, round_even(32*f, 0)) AS BIGINT) AS cw FROM u),
    o AS (SELECT *, CAST(floor({_uniform_sql('7/y', 'frame_id')} * (24 - ch + 1)) AS BIGINT) AS y0,
      CAST(floor({_uniform_sql('7/x', 'frame_id')} * (32 - cw + 1)) AS BIGINT) AS x0 FROM s),
    t AS (SELECT ty.range AS y, tx.range AS x FROM range(24) ty, range(32) tx),
    g AS (SELECT frame_id, t.y, t.x, y0 + (t.y*ch)//24 AS sy, x0 + (t.x*cw)//32 AS sx FROM o, t),
    c AS (SELECT g.frame_id, g.y, g.x, pix.gt, pix.r FROM g JOIN pix ON pix.frame_id = g.frame_id AND pix.y = sy AND pix.x = sx) """
    + digest_sql("c", "frame_id", ["gt", "r"]),
)
def crop_zoom(spark, sf):
    px = pixels(spark, sf).select("frame_id", "y", "x", "gt", "r")
    return digest(geo.crop_zoom(px, (H, W), 0.5, 1.0, 0.5, 7), ["frame_id"], ["gt", "r"])


HSV = """h0 AS (SELECT *, greatest(b,g,r)::DOUBLE AS mx, least(b,g,r)::DOUBLE AS mn FROM pix),
h1 AS (SELECT *, CASE WHEN mx = mn THEN 0.0 WHEN mx = r THEN 60.0::DOUBLE*(g-b)/(mx-mn)
  WHEN mx = g THEN 120.0 + 60.0::DOUBLE*(b-r)/(mx-mn) ELSE 240.0 + 60.0::DOUBLE*(r-g)/(mx-mn) END AS hh FROM h0),
hsv AS (SELECT *, CASE WHEN hh < 0 THEN hh + 360.0 ELSE hh END AS hue,
  CASE WHEN mx = 0 THEN 0.0 ELSE (mx-mn)/mx END AS sat, mx/255.0::DOUBLE AS val FROM h1),
cb AS (SELECT *, CAST(CASE WHEN sat >= 0.25 THEN floor(((hue + 22.5) % 360.0) / 45.0)
  WHEN val < 0.25 THEN 8 WHEN val < 0.7 THEN 9 ELSE 10 END AS INTEGER) AS colour_bin FROM hsv)"""


@query(
    "P19, P21, P22",
    f"""WITH {PIX}, {HSV} SELECT set_id, round(avg(hue), 9) AS hue, round(avg(sat), 9) AS sat, round(avg(val), 9) AS val,
      round(avg(0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b), 9) AS luma,
      count(*) FILTER (hue BETWEEN 90 AND 200 AND sat BETWEEN 0.3 AND 1 AND val BETWEEN 0.2 AND 0.9) AS in_range
      FROM hsv GROUP BY set_id""",
)
def colour_spaces(spark, sf):
    px = rc.hsv_range_mask(rc.luma(pixels(spark, sf)), (90, 0.3, 0.2), (200, 1.0, 0.9))
    return rc.to_hsv(px).groupBy("set_id").agg(
        *[r9(F.avg(c)).alias(c) for c in ("hue", "sat", "val", "luma")],
        F.sum("mask").alias("in_range"),
    )


@query("P20", f"WITH {PIX}, {HSV} SELECT set_id, colour_bin, count(*) AS n FROM cb GROUP BY ALL")
def colour_bin(spark, sf):
    out = rc.colour_bin(pixels(spark, sf))
    return out.groupBy("set_id", "colour_bin").agg(F.count(F.lit(1)).alias("n"))


def _shift(tag: str) -> str:
    return f"({_uniform_sql('11/' + tag, 'frame_id')}*2.0::DOUBLE - 1.0::DOUBLE)"


def _channel_sql(n: int) -> str:
    k = f"(({n}.0::DOUBLE + h/60.0::DOUBLE) % 6.0::DOUBLE)"
    return f"CAST(round_even((v - v*s*greatest(0.0::DOUBLE, least({k}, 4.0::DOUBLE - {k}, 1.0::DOUBLE)))*255.0::DOUBLE, 0) AS INTEGER)"


@query(
    "P23",
    f"""WITH {PIX}, {HSV}, sh AS (SELECT frame_id, y, x, (hue + {_shift('hue')}*25.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE AS h,
      least(1.0::DOUBLE, sat*(1.0::DOUBLE + {_shift('sat')}*0.25::DOUBLE)) AS s, least(1.0::DOUBLE, val*(1.0::DOUBLE + {_shift('val')}*0.2::DOUBLE)) AS v FROM hsv),
    j AS (SELECT frame_id, y, x, {_channel_sql(1)} AS b, {_channel_sql(3)} AS g, {_channel_sql(5)} AS r FROM sh) """
    + digest_sql("j", "frame_id", ["b", "g", "r"]),
)
def hsv_jitter(spark, sf):
    out = rc.hsv_jitter(pixels(spark, sf), ["frame_id"], 11)
    return digest(out, ["frame_id"], ["b", "g", "r"])


@query(
    "P24",
    f"""WITH {PTS}, c AS (SELECT sample_id, (min(px)+max(px))/2 AS cx, (min(py)+max(py))/2 AS cy, (min(pz)+max(pz))/2 AS cz
      FROM pts GROUP BY sample_id),
    s AS (SELECT sample_id, 40 * label + 30 AS v, 0.65::DOUBLE + 0.45::DOUBLE * greatest(0.0, least(1.0, 0.5 + 0.5 *
      (-((px - cx)*0.0::DOUBLE + (py - cy)*0.6::DOUBLE + (pz - cz)*0.8::DOUBLE) / 1.6::DOUBLE))) AS k FROM pts JOIN c USING (sample_id))
    SELECT sample_id, CAST(sum(floor(greatest(0.0, least(255.0, v * k)))) AS BIGINT) AS lit FROM s GROUP BY sample_id""",
)
def directional_light(spark, sf):
    from pixelmill.operators.cloud import directional_light as light

    pts = points(spark, sf).withColumn("g", F.col("label") * 40 + 30)
    out = light(pts, (0.0, 0.6, 0.8), channels=["g"])
    return out.groupBy("sample_id").agg(F.sum("g").cast("bigint").alias("lit"))


_LICENCES = ["CC0 1.0", "cc by-nc 4.0", "CC BY 4.0", "public domain", "cc-by-nd", "", "all rights", "CC BY-SA", "pdm"]


@query(
    "P25",
    f"""WITH l AS (SELECT doc_id, ({_LICENCES!r})[1 + doc_id % {len(_LICENCES)}] AS licence FROM documents)
    SELECT doc_id, licence FROM l WHERE lower(licence) IN ('cc0 1.0', 'cc by 4.0', 'public domain', 'cc by-sa', 'pdm')""",
)
def licence_filter(spark, sf):
    names = F.array(*[F.lit(s) for s in _LICENCES])
    docs = table(spark, sf, "documents").select(
        "doc_id", names[(F.col("doc_id") % len(_LICENCES)).cast("int")].alias("licence")
    )
    return rc.licence_filter(docs)


@query(
    "P26",
    f"""WITH {MAN} SELECT dataset, CAST(set_id + 1000 AS INTEGER) AS set_id, src, anim, view, line_no,
      CAST(set_id + 1000 AS VARCHAR) || substr(base, 4) AS base FROM man""",
)
def offset_set_id(spark, sf):
    return rc.offset_set_id(manifest(spark, sf), 1000)
