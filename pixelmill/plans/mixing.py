"""Queries of mixing, splits, top-k and table joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import joins as jo
from pixelmill.operators import metrics as m
from pixelmill.operators import mix as mx
from pixelmill.operators import splits as sp
from pixelmill.operators import topk as tk
from pixelmill.plans.fixtures import (
    CONTENT,
    HASHES,
    MAN,
    PIX,
    SCORES,
    TIM,
    content,
    manifest,
    pixels,
    scores,
    sign_hashes,
    table,
    timings,
)
from pixelmill.plans.registry import query, r6, r9


def _round(df, f, *cols):
    return df.withColumns({c: f(F.col(c)) for c in cols})


def shifted_sql(k: str) -> str:
    return f"""CAST(set_id + {k} AS INTEGER) AS set_id, printf('%03d', set_id + {k}) || substr(base, strpos(base, '_')) AS base"""


MIX = f"""mixed AS (SELECT dataset, src, anim, view, line_no, {shifted_sql('0')}, 'real' AS source_name, CAST(0 AS INTEGER) AS source_order FROM man WHERE dataset = 'en'
      UNION ALL SELECT dataset, src, anim, view, line_no, {shifted_sql('1000')}, 'extra', 1 FROM man WHERE dataset = 'de'
      UNION ALL SELECT dataset, src, anim, view, line_no, {shifted_sql('2000')}, 'rest', 2 FROM man WHERE dataset NOT IN ('en', 'de'))"""


def _mixed(spark, sf):
    man = manifest(spark, sf)
    lang = F.col("dataset")
    return mx.mix(
        [
            ("real", man.filter(lang == "en"), 0),
            ("extra", man.filter(lang == "de"), 1000),
            ("rest", man.filter(~lang.isin("en", "de")), 2000),
        ]
    )


@query("M1", f"WITH {MAN}, {MIX} SELECT * FROM mixed")
def mix(spark, sf):
    return _mixed(spark, sf)


@query(
    "M2",
    f"""WITH {MAN}, s AS (SELECT *, CASE WHEN set_id <= 31 THEN 'train' ELSE 'val' END AS split FROM man),
    c AS (SELECT *, CAST(unnest(CASE WHEN split = 'train' THEN [0, 1, 2] ELSE [0] END) AS INTEGER) AS copy FROM s)
    SELECT dataset, src, anim, view, line_no, split, copy, {shifted_sql('copy*100')} FROM c""",
)
def oversample(spark, sf):
    man = manifest(spark, sf)
    man = man.withColumn("split", F.when(F.col("set_id") <= 31, "train").otherwise("val"))
    return mx.oversample(man, 3, 100)


def _fraction_sql(frac: float, base: str, neg: str) -> str:
    """Check SQL of target_fraction; both branches, chosen by the counts."""
    return f"""WITH {MAN}, b AS (SELECT * FROM man WHERE {base}), n AS (SELECT * FROM man WHERE {neg}),
    k AS (SELECT CAST(round_even({frac}::DOUBLE*(SELECT count(*) FROM b)/(1 - {frac}::DOUBLE), 0) AS BIGINT) AS w, (SELECT count(*) FROM n) AS h),
    r AS (SELECT n.*, row_number() OVER (ORDER BY md5('5|' || base), base) AS rn FROM n),
    c AS (SELECT r.*, unnest(CASE WHEN h >= w THEN [0] ELSE range(CAST(greatest(1, least(4, round_even(w/h, 0))) AS BIGINT)) END) AS copy FROM r, k WHERE h < w OR rn <= w)
    SELECT dataset, src, anim, view, line_no, CAST(copy AS INTEGER) AS copy, {shifted_sql('copy*1000')} FROM c"""


@query("M3", _fraction_sql(0.2, "dataset <> 'de'", "dataset = 'de'"))
def target_fraction_subsample(spark, sf):
    man = manifest(spark, sf)
    de = F.col("dataset") == "de"
    return mx.target_fraction(man.filter(~de), man.filter(de), 0.2, 4, 5)


@query("M3", _fraction_sql(0.5, "dataset <> 'de'", "dataset = 'de'"))
def target_fraction_repeat(spark, sf):
    man = manifest(spark, sf)
    de = F.col("dataset") == "de"
    return mx.target_fraction(man.filter(~de), man.filter(de), 0.5, 4, 5)


@query(
    "M4, J6",
    f"""WITH {MAN}, subs AS (SELECT base, 'sub_' || base AS rgb, CASE WHEN src % 2 = 0 THEN 'sub_' || base END AS depth FROM man WHERE src % 3 = 0 ORDER BY base LIMIT 40)
    SELECT m.base, coalesce(s.rgb, m.base) AS rgb, coalesce(s.depth, m.base) AS depth, s.base IS NOT NULL AS substituted FROM man m LEFT JOIN subs s ON s.base = m.base""",
)
def dose_and_substitute(spark, sf):
    man = manifest(spark, sf).select("base", "src")
    name = F.concat(F.lit("sub_"), F.col("base"))
    subs = man.filter(F.col("src") % 3 == 0).select(
        "base", name.alias("rgb"), F.when(F.col("src") % 2 == 0, name).alias("depth")
    )
    full = man.select("base", F.col("base").alias("rgb"), F.col("base").alias("depth"))
    return jo.substitute(full, mx.dose(subs, 40), ["rgb", "depth"])


@query(
    "M5",
    f"""WITH {MAN}, {MIX}, c AS (SELECT source_name, source_order, count(*) AS n FROM mixed GROUP BY ALL)
    SELECT source_name, n, round(n/(SELECT sum(n) FROM c), 9) AS share, round(n/(SELECT arg_min(n, source_order) FROM c), 9) AS ratio FROM c""",
)
def mix_report(spark, sf):
    return _round(mx.mix_report(_mixed(spark, sf)), r9, "share", "ratio")


@query(
    "M6",
    f"""WITH {MAN}, a AS (SELECT base FROM man WHERE src % 7 <> 0), b AS (SELECT base FROM man WHERE src % 5 <> 0)
    SELECT base, 'only_a' AS side, CAST(1 AS BIGINT) AS n FROM (SELECT base FROM a EXCEPT ALL SELECT base FROM b)
    UNION ALL SELECT base, 'only_b', 1 FROM (SELECT base FROM b EXCEPT ALL SELECT base FROM a)""",
)
def diff_manifests(spark, sf):
    man = manifest(spark, sf)
    src = F.col("src")
    return mx.diff_manifests(man.filter(src % 7 != 0), man.filter(src % 5 != 0), ["base"])


@query(
    "M6",
    f"""WITH {MAN}, a AS (SELECT line_no, base FROM man), b AS (SELECT line_no, CASE WHEN src % 50 = 3 THEN 'x' ELSE base END AS base FROM man WHERE src % 20 <> 7)
    SELECT count(a.base) AS lines_a, count(b.base) AS lines_b, count(*) FILTER (a.base IS DISTINCT FROM b.base) AS different,
      count(*) FILTER (a.base IS DISTINCT FROM b.base) = 0 AS identical FROM a FULL JOIN b USING (line_no)""",
)
def same_lines(spark, sf):
    man = manifest(spark, sf)
    other = man.filter(F.col("src") % 20 != 7).withColumn(
        "base", F.when(F.col("src") % 50 == 3, "x").otherwise(F.col("base"))
    )
    return mx.same_lines(man, other)


TITLED = """doc AS (SELECT doc_id AS id, lang AS query, sha256(text) AS sha, source || '/' || (doc_id % 97) AS title FROM documents),
    d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY {o}) AS rn FROM doc) WHERE rn = 1),
    d2 AS (SELECT id, query, sha, title FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY {o}) AS r2 FROM d1) WHERE r2 = 1)"""


def _titled(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("query"),
        F.sha2("text", 256).alias("sha"),
        F.concat("source", F.lit("/"), (F.col("doc_id") % 97).cast("string")).alias("title"),
    )


@query("M7", f"WITH {TITLED.format(o='id')} SELECT * FROM d2")
def dedup_content(spark, sf):
    return mx.dedup_content(_titled(spark, sf), ["id"], "sha", "title")


@query(
    "K5",
    f"""WITH {TITLED.format(o='query, id')}, c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY query, id) AS k FROM d2)
    SELECT id, query, sha, title FROM c WHERE k <= 20 ORDER BY query, id LIMIT 50""",
)
def cap_total(spark, sf):
    return tk.cap_total(_titled(spark, sf), "query", ["query", "id"], 20, 50)


# ---- splits


@query(
    "X1",
    f"""WITH {MAN} SELECT base, set_id, CASE WHEN set_id BETWEEN 0 AND 31 THEN 'train' WHEN set_id BETWEEN 32 AND 35 THEN 'val'
      WHEN set_id BETWEEN 36 AND 39 THEN 'test' END AS split FROM man""",
)
def split_by_range(spark, sf):
    return sp.split_by_range(manifest(spark, sf)).select("base", "set_id", "split")


def held_sql(groups: str, part: str, key: str, frac: float) -> str:
    return f"""hg AS (SELECT *, row_number() OVER ({part} ORDER BY md5('9|' || CAST({key} AS VARCHAR)), {key}) AS rn,
        count(*) OVER ({part}) AS n FROM ({groups})),
      held AS (SELECT *, rn <= greatest(1, round_even(n * {frac}::DOUBLE, 0)) AS val FROM hg)"""


@query(
    "X2",
    f"""WITH {MAN}, {held_sql('SELECT DISTINCT set_id FROM man', '', 'set_id', 0.15)}
    SELECT base, man.set_id, CASE WHEN val THEN 'val' ELSE 'train' END AS split FROM man JOIN held USING (set_id)""",
)
def split_by_group(spark, sf):
    out = sp.split_by_group(manifest(spark, sf), "set_id", 0.15, 9)
    return out.select("base", "set_id", "split")


@query(
    "X3",
    f"""WITH {MAN}, {held_sql('SELECT DISTINCT dataset, set_id FROM man', 'PARTITION BY dataset', 'set_id', 0.2)}
    SELECT base, dataset, set_id, CASE WHEN val THEN 'val' ELSE 'train' END AS split FROM man JOIN held USING (dataset, set_id)""",
)
def split_within_source(spark, sf):
    out = sp.split_within_source(manifest(spark, sf), "dataset", "set_id", 0.2, 9)
    return out.select("base", "dataset", "set_id", "split")


@query(
    "X4",
    f"""WITH {MAN}, {held_sql('SELECT DISTINCT base FROM man', '', 'base', 0.1)}
    SELECT man.base, CASE WHEN val THEN 'val' ELSE 'train' END AS split FROM man JOIN held USING (base)""",
)
def split_group_or_row(spark, sf):
    man = manifest(spark, sf).withColumn(
        "donor", F.when(F.col("set_id") == 4, None).otherwise(F.col("set_id").cast("string"))
    )
    return sp.split_group_or_row(man, "donor", "base", 0.1, 9).select("base", "split")


@query(
    "X5",
    f"WITH {MAN} SELECT base, CAST(row_number() OVER (ORDER BY base) + 99 AS BIGINT) AS new_set_id FROM man",
)
def assign_set_ids(spark, sf):
    return sp.assign_set_ids(manifest(spark, sf), ["base"], 100).select("base", "new_set_id")


INV = f"""{MAN}, inv AS (SELECT set_id, src, unnest(CASE WHEN src % 11 = 0 THEN ['rgb', 'depth'] WHEN src % 13 = 0 THEN ['rgb']
      ELSE ['rgb', 'depth', 'label'] END) AS channel FROM man WHERE set_id <> 6 UNION ALL SELECT set_id, src, 'rgb' FROM man WHERE set_id = 6)"""


def _inventory(spark, sf):
    man = manifest(spark, sf).select("set_id", "src")
    three = F.array(*[F.lit(c) for c in ("rgb", "depth", "label")])
    src = F.col("src")
    kept = (
        F.when(F.col("set_id") == 6, F.slice(three, 1, 1))
        .when(src % 11 == 0, F.slice(three, 1, 2))
        .when(src % 13 == 0, F.slice(three, 1, 1))
        .otherwise(three)
    )
    return man.select("set_id", "src", F.explode(kept).alias("channel"))


@query(
    "X7",
    f"""WITH {INV}, c AS (SELECT set_id, count(*) FILTER (channel = 'rgb') AS rgb, count(*) FILTER (channel = 'depth') AS depth,
      count(*) FILTER (channel = 'label') AS label FROM inv GROUP BY set_id)
    SELECT *, least(rgb, depth, label) AS frames FROM c WHERE least(rgb, depth, label) > 0""",
)
def usable_frames(spark, sf):
    return sp.usable_frames(_inventory(spark, sf), ["rgb", "depth", "label"])


@query(
    "X6",
    f"""WITH {INV}, s AS (SELECT set_id, max(src) + 1 AS frames FROM man GROUP BY set_id),
    w AS (SELECT CASE WHEN set_id <= 31 THEN 'train' ELSE 'val' END AS split, set_id, unnest(range(0, frames, 3)) AS src FROM s WHERE set_id <= 31),
    d AS (SELECT set_id, src FROM inv GROUP BY ALL HAVING count(DISTINCT channel) = 3)
    SELECT split, set_id, src FROM w ANTI JOIN d USING (set_id, src)""",
)
def pending_work(spark, sf):
    man = manifest(spark, sf)
    sets = man.groupBy("set_id").agg((F.max("src") + 1).alias("frames"))
    sets = sets.withColumn("split", F.when(F.col("set_id") <= 31, "train").otherwise("val"))
    work = sp.work_list(sets, 3, ["train"])
    return sp.pending(work, _inventory(spark, sf), ["set_id", "src"], ["rgb", "depth", "label"]).select(
        "split", "set_id", "src"
    )


@query(
    "X8",
    """WITH u AS (SELECT DISTINCT doc_id + 1 AS u FROM documents WHERE doc_id % 89 <> 60)
    SELECT min(u) + 0 AS next_index FROM (SELECT 1::BIGINT AS u UNION SELECT u + 1 FROM u) a ANTI JOIN u USING (u)""",
)
def next_free_index(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("doc_id") % 89 != 60)
    names = d.select(F.concat((F.col("doc_id") + 1).cast("string"), F.lit("_x.jpg")).alias("base"))
    return sp.next_free_index(names)


# ---- top-k

PERF = """pf AS (SELECT frame_id, set_id, count(*) FILTER (gt=2 AND pred_a=2) AS tp, count(*) FILTER (gt<>2 AND pred_a=2) AS fp,
      count(*) FILTER (gt=2 AND pred_a<>2) AS fn, count(*) FILTER (gt=2 AND pred_b=2)/count(*) FILTER (gt=2 OR pred_b=2)
        - count(*) FILTER (gt=2 AND pred_a=2)/count(*) FILTER (gt=2 OR pred_a=2) AS delta FROM pix GROUP BY ALL)"""


def _frames(spark, sf):
    gt, a = F.col("gt") == 2, F.col("pred_a") == 2
    return m.binary_metrics(pixels(spark, sf), gt, a, ["set_id", "frame_id"])


@query(
    "K1",
    f"""WITH {PIX}, {PERF} SELECT frame_id, tp, fp, fn, tp + fn AS gt_px, round(tp/(tp+fn), 9) AS recall FROM pf WHERE tp + fn >= 12
    ORDER BY tp/(tp+fn), tp + fn DESC, frame_id LIMIT 12""",
)
def worst_frames(spark, sf):
    out = tk.worst_frames(_frames(spark, sf), 12, 12)
    return _round(out.select("frame_id", "tp", "fp", "fn", "gt_px", "recall"), r9, "recall")


@query(
    "K2",
    f"""WITH {PIX}, {PERF}, d AS (SELECT set_id, frame_id, delta, row_number() OVER (PARTITION BY set_id ORDER BY delta DESC, frame_id) AS rn FROM pf)
    SELECT set_id, frame_id, round(delta, 9) AS delta FROM d WHERE rn = 1 ORDER BY delta DESC, frame_id LIMIT 2""",
)
def top_delta_distinct(spark, sf):
    gt = F.col("gt") == 2

    def iou(p):
        p = F.col(p) == 2
        return F.count_if(gt & p) / F.count_if(gt | p)

    per = pixels(spark, sf).groupBy("set_id", "frame_id").agg(
        (iou("pred_b") - iou("pred_a")).alias("delta")
    )
    return _round(tk.top_delta_distinct(per, 2, "set_id", "delta", "frame_id"), r9, "delta")


@query(
    "K4",
    f"""WITH {PIX}, c AS (SELECT 'to_' || pred_a AS mode, count(*) AS mass FROM pix WHERE gt = 2 AND pred_a <> 2 GROUP BY ALL
      UNION ALL SELECT 'from_' || gt, count(*) FROM pix WHERE gt <> 2 AND pred_a = 2 GROUP BY ALL)
    SELECT mode, mass, round(mass/sum(mass) OVER (), 9) AS share, CAST(row_number() OVER (ORDER BY mass DESC, mode) AS INTEGER) AS rank,
      row_number() OVER (ORDER BY mass DESC, mode) = 1 AS dominant FROM c""",
)
def rank_modes(spark, sf):
    flow = m.error_flow(m.confusion(pixels(spark, sf), pred="pred_a"), 2)
    name = F.concat(
        F.when(F.col("kind") == "fn", "to_").otherwise("from_"), F.col("other").cast("string")
    )
    modes = flow.select(name.alias("mode"), F.col("n").alias("mass"))
    return _round(tk.rank_modes(modes), r9, "share")


@query(
    "K6",
    f"""WITH {PIX}, r AS (SELECT frame_id, y, x, (x*1.0::DOUBLE + y*0.5::DOUBLE) AS reach FROM pix WHERE gt = 1),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY reach DESC, y, x) AS INTEGER) AS rank FROM r)
    SELECT * FROM k WHERE rank <= 3""",
)
def extremity(spark, sf):
    return tk.extremity(pixels(spark, sf), F.col("gt") == 1, (1.0, 0.5), 3)


@query(
    "K7",
    f"""WITH {PIX}, p AS (SELECT set_id, CASE WHEN gt = 2 THEN prob_pm ELSE 1000 - prob_pm END AS own FROM pix),
    k AS (SELECT greatest(60, (SELECT own FROM p ORDER BY own LIMIT 1 OFFSET 19999)) AS t)
    SELECT set_id, own, count(*) AS n FROM p, k WHERE own <= t GROUP BY ALL""",
)
def hard_rows(spark, sf):
    own = F.when(F.col("gt") == 2, F.col("prob_pm")).otherwise(1000 - F.col("prob_pm"))
    px = pixels(spark, sf).select("frame_id", "set_id", "y", "x", own.alias("own"))
    kept = tk.hard_rows(px, "own", 60, 20000, ["frame_id", "y", "x"])
    return kept.groupBy("set_id", "own").agg(F.count(F.lit(1)).alias("n"))


# ---- joins


def _channel(df, keep):
    return df.filter(keep).select("base", F.concat(F.lit("/d/"), F.col("base")).alias("path"))


@query(
    "J1",
    f"""WITH {MAN}, l AS (SELECT base FROM man JOIN labels ON doc_id = src), d AS (SELECT base FROM man WHERE src % 4 <> 0)
    SELECT m.base, '/d/' || m.base AS rgb_path, '/d/' || l.base AS label_path, '/d/' || d.base AS depth_path, d.base IS NOT NULL AS has_depth
    FROM man m JOIN l ON l.base = m.base LEFT JOIN d ON d.base = m.base""",
)
def align_channels(spark, sf):
    man = manifest(spark, sf)
    labelled = man.join(table(spark, sf, "labels").select(F.col("doc_id").alias("src")), "src")
    always = F.lit(True)
    return jo.align_channels(
        _channel(man, always), _channel(labelled, always), _channel(man, F.col("src") % 4 != 0)
    )


@query(
    "J2",
    f"""WITH {MAN}, f AS (SELECT base, TRUE AS has_rgb, src % 4 <> 0 AS has_depth, src IN (SELECT doc_id FROM labels) AS has_label FROM man)
    SELECT * FROM f WHERE NOT (has_rgb AND has_depth AND has_label)""",
)
def missing_channels(spark, sf):
    man = manifest(spark, sf)
    labelled = man.join(table(spark, sf, "labels").select(F.col("doc_id").alias("src")), "src")
    depth = man.filter(F.col("src") % 4 != 0)
    return jo.missing_channels({"rgb": man, "depth": depth, "label": labelled})


@query(
    "J3",
    f"""WITH {MAN} SELECT base AS stem, base || '.jpg' AS image, base || '_mask.png' AS mask, 'one' AS source_name, CAST(1 AS INTEGER) AS threshold FROM man WHERE dataset = 'en' AND src % 3 <> 0
    UNION ALL SELECT base, base || '.png', base || '-gt.jpg', 'two', 127 FROM man WHERE dataset <> 'en' AND src % 5 <> 0""",
)
def pair_image_mask(spark, sf):
    man = manifest(spark, sf)
    en = F.col("dataset") == "en"

    def names(cond, suffix):
        return man.filter(cond).select(F.concat("base", F.lit(suffix)).alias("name"))

    src = F.col("src")
    return jo.pair_image_mask(
        [
            ("one", names(en, ".jpg"), names(en & (src % 3 != 0), "_mask.png"), "_mask$", 1),
            ("two", names(~en, ".png"), names(~en & (src % 5 != 0), "-gt.jpg"), "-gt$", 127),
        ]
    )


@query(
    "J4",
    f"""WITH {MAN}, a AS (SELECT dataset, base, row_number() OVER (PARTITION BY dataset ORDER BY line_no) - 1 AS pair_no FROM man WHERE src % 2 = 0),
    b AS (SELECT dataset, base AS base_b, row_number() OVER (PARTITION BY dataset ORDER BY line_no) - 1 AS pair_no FROM man WHERE src % 3 = 0)
    SELECT dataset, pair_no, base, base_b FROM a JOIN b USING (dataset, pair_no)""",
)
def pair_streams_by_index(spark, sf):
    man = manifest(spark, sf).select("dataset", "src", "line_no", "base")
    a, b = man.filter(F.col("src") % 2 == 0), man.filter(F.col("src") % 3 == 0)
    out = jo.pair_streams_by_index(a, b, ["line_no"], ["line_no"], ["dataset"])
    return out.select("dataset", "pair_no", "base", "base_b")


@query(
    "J5",
    f"WITH {PIX} SELECT set_id, pred_a, pred_b, count(*) AS n FROM pix GROUP BY ALL",
)
def pair_predictions(spark, sf):
    px = pixels(spark, sf)
    a = px.select("frame_id", "set_id", "y", "x", F.col("pred_a").alias("pred"))
    b = px.select("frame_id", "y", "x", F.col("pred_b").alias("pred"))
    out = jo.pair_predictions(a, b)
    return out.groupBy("set_id", "pred_a", "pred_b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J7",
    f"""WITH {CONTENT} SELECT id, sha FROM content WHERE kind = 'candidate' AND sha NOT IN (SELECT sha FROM content WHERE kind = 'protected')""",
)
def exclude_exact(spark, sf):
    c = content(spark, sf)
    cand, bad = c.filter("kind = 'candidate'"), c.filter("kind = 'protected'")
    return jo.exclude_exact(cand, bad).select("id", "sha")


NEAR = """hd AS (SELECT a.id, bit_count(xor(a.hash, b.hash)) AS d, b.id AS bid FROM hashes a JOIN hashes b ON NOT a.protected AND b.protected),
    nh AS (SELECT id, CAST(min(d) AS INTEGER) AS min_distance, CAST(min(d*1000000000::BIGINT + bid) % 1000000000 AS BIGINT) AS nearest_id FROM hd GROUP BY id)"""


@query(
    "J8",
    f"""WITH {HASHES}, {NEAR} SELECT h.id, min_distance, nearest_id FROM hashes h LEFT JOIN nh USING (id) WHERE NOT protected""",
)
def nearest_hamming(spark, sf):
    h = sign_hashes(spark, sf)
    out = jo.nearest_hamming(h.filter(~F.col("protected")), h.filter("protected"))
    return out.select("id", "min_distance", "nearest_id")


@query(
    "J13",
    f"""WITH {TIM}, a AS (SELECT model, avg(ms) AS mean_ms FROM tim GROUP BY model), b AS (SELECT model, avg(ms) AS ref_ms FROM tim WHERE dtype = 0 GROUP BY model)
    SELECT model, round(mean_ms, 6) AS mean_ms, round(ref_ms, 6) AS ref_ms, round(abs(mean_ms - ref_ms)/abs(ref_ms)*100, 6) AS diff,
      abs(mean_ms - ref_ms)/abs(ref_ms)*100 <= 1.0 AS within FROM a JOIN b USING (model)""",
)
def join_reference(spark, sf):
    t = timings(spark, sf)
    a = t.groupBy("model").agg(F.avg("ms").alias("mean_ms"))
    b = t.filter(F.col("dtype") == 0).groupBy("model").agg(F.avg("ms").alias("ref_ms"))
    out = jo.join_reference(a, b, ["model"], "mean_ms", "ref_ms", 1.0, percent=True)
    return _round(out, r6, "mean_ms", "ref_ms", "diff")
