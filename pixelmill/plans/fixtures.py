"""Derived input tables, each as a Spark builder and as check SQL with equal rows.

Every table is a function of the driver's Parquet tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.ordered import row_index
from pixelmill.session import parallelism

H, W = 24, 32


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Frames or clouds that one task makes rows of, whatever the number of them.
PER_TASK = 500
#: Clouds of 64 points that one task makes where nothing multiplies them further.
CLOUDS = 4000


def _tasks(spark: SparkSession, rows: DataFrame, each: int = PER_TASK) -> int:
    """Partition count for ``rows``, each of which is about to become dozens or hundreds."""
    return max(parallelism(spark), -(-rows.count() // each))


def _frame_ids(spark: SparkSession, sf: str, name: str = "frame_id", each: int = PER_TASK) -> DataFrame:
    """Frame ids hash-partitioned by frame, so that per-frame windows need no shuffle."""
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias(name))
    return ids.repartition(_tasks(spark, ids, each), name)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (frame, y, x); a frame per row of ``part``."""
    return frame_pixels(_frame_ids(spark, sf))


def _cells(lo, hi):
    """Bit 2x for each x between lo and hi, as far as they lie in 0..31."""
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(W - 1))
    inside = F.lit(0x5555555555555555).bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), lo * 2))
    inside = inside.bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), 2 * (W - 1) - hi * 2))
    return F.when(lo <= hi, inside).otherwise(F.lit(0).cast("bigint"))


def _cell(codes, x):
    """The class at x of a row of classes, two bits each."""
    return F.call_function("shiftrightunsigned", codes, x * 2).bitwiseAND(F.lit(3).cast("bigint")).cast("int")


def frame_pixels(ids: DataFrame) -> DataFrame:
    """Pixel rows of the frames in ``ids``; also works on a stream of ids.

    The optimizer writes a pixel's expressions out in full wherever a filter or projection above
    names them, soon past what the JVM compiles. So a row's classes are laid in a long before x
    is there, and a pixel only takes its two bits.
    """
    p, y, x = F.col("frame_id"), F.col("y"), F.col("x")

    def short(column):
        return column.cast("int")

    rows = ids.select("frame_id", F.explode(F.lit(list(range(H)))).alias("y")).select(
        "frame_id",
        "y",
        short(32 + p % 3).alias("set_id"),
        F.concat(F.lit("c"), (p % 4 + 1).cast("string")).alias("camera"),
        short(p % 3).alias("_w"),
        short((p * 7 + y * (p % 2)) % W).alias("_axis"),
        short(F.when(y.between(p % 18, p % 18 + 4), p % 26).otherwise(2 * W)).alias("_con"),
        short(p % 41).alias("_l"),
        # the x with (31p + 17y + 13x) % 97 = 0 and the one with (29p + 13y + 19x) % 53 = 0
        short((97 - (p * 31 + y * 17) % 97) * 15 % 97).alias("_at_a"),
        short((53 - (p * 29 + y * 13) % 53) * 14 % 53).alias("_at_b"),
        short(p * 11 % 256).alias("_blue"),
        short((p * 3 + y * 9) % 256).alias("g"),
        short((p + y) % 11).alias("_hole"),
        short((p * 37 + y * 29) % 1001).alias("_d"),
        short((p * 7919 + y * 104729) % 500).alias("_pm"),
    )
    w, axis, start = F.col("_w"), F.col("_axis"), F.col("_con")

    def classes(shift):
        con = _cells(start - shift, start + 5 - shift)
        wire = _cells(axis - w - shift, axis + w - shift)
        return F.shiftleft(con, 1).bitwiseOR(wire.bitwiseAND(F.bitwise_not(con)))

    def turned(name, at):
        """The class at one x goes to the next one."""
        v = _cell(F.col(name), F.col(at))
        turn = F.call_function("shiftleft", v.bitwiseXOR((v + 1) % 3).cast("bigint"), F.col(at) * 2)
        return F.when(F.col(at) < W, F.col(name).bitwiseXOR(turn)).otherwise(F.col(name))

    rows = rows.withColumns({"_gt": classes(F.lit(0)), "_pred": classes(w - 1)})
    rows = rows.withColumns({"_pred_a": turned("_pred", "_at_a"), "_pred_b": turned("_gt", "_at_b")})
    rows = rows.drop("_w", "_axis", "_con", "_at_a", "_at_b", "_pred")
    first = rows.select("*", F.explode(F.lit(list(range(W)))).alias("x"))
    first = first.withColumns({n: _cell(F.col(f"_{n}"), x) for n in ("gt", "pred_a", "pred_b")})
    g = F.col("gt")
    return first.select(
        "frame_id",
        "set_id",
        "camera",
        "y",
        "x",
        "gt",
        F.when(g == 2, 4)
        .when(g == 1, 1 + y % 3)
        .when((F.col("_l") + x * y) % 41 == 0, 5)
        .otherwise(0)
        .alias("label6"),
        "pred_a",
        "pred_b",
        ((F.col("_blue") + x * 5) % 256).alias("b"),
        "g",
        ((x * 7 + y * 13) % 256).alias("r"),
        F.when((F.col("_hole") + x) % 11 == 0, 0)
        .otherwise(500 + (F.col("_d") + x * 23) % 1001)
        .alias("depth_mm"),
        (F.when(F.col("pred_a") == 2, 500).otherwise(0) + (F.col("_pm") + x * 1299709) % 500).alias("prob_pm"),
    )


def _class_sql(xx: str) -> str:
    return (
        f"CASE WHEN y BETWEEN p%18 AND p%18+4 AND {xx} BETWEEN p%26 AND p%26+5 THEN 2 "
        f"WHEN abs({xx} - ((p*7 + y*(p%2)) % 32)) <= p%3 THEN 1 ELSE 0 END"
    )


PIX = f"""pix0 AS (
  SELECT p_partkey AS p, ry.y AS y, rx.x AS x
  FROM part, (SELECT range AS y FROM range({H})) ry, (SELECT range AS x FROM range({W})) rx),
pix1 AS (SELECT p, y, x, CAST({_class_sql('x')} AS INTEGER) AS gt,
  {_class_sql('(x + p%3 - 1)')} AS pred0 FROM pix0),
pix2 AS (SELECT p AS frame_id, CAST(32 + p%3 AS INTEGER) AS set_id,
  'c' || CAST(p%4 + 1 AS VARCHAR) AS camera, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, gt,
  CAST(CASE WHEN gt = 2 THEN 4 WHEN gt = 1 THEN 1 + y%3 WHEN (p + x*y) % 41 = 0 THEN 5 ELSE 0 END
    AS INTEGER) AS label6,
  CAST(CASE WHEN (p*31 + y*17 + x*13) % 97 = 0 THEN (pred0 + 1) % 3 ELSE pred0 END AS INTEGER) AS pred_a,
  CAST(CASE WHEN (p*29 + y*13 + x*19) % 53 = 0 THEN (gt + 1) % 3 ELSE gt END AS INTEGER) AS pred_b,
  CAST((p*11 + x*5) % 256 AS INTEGER) AS b, CAST((p*3 + y*9) % 256 AS INTEGER) AS g,
  CAST((x*7 + y*13) % 256 AS INTEGER) AS r,
  CAST(CASE WHEN (p + x + y) % 11 = 0 THEN 0 ELSE 500 + (p*37 + y*29 + x*23) % 1001 END AS INTEGER)
    AS depth_mm FROM pix1),
pix AS (SELECT *, CAST((CASE WHEN pred_a = 2 THEN 500 ELSE 0 END)
  + (frame_id*7919 + y*104729 + x*1299709) % 500 AS INTEGER) AS prob_pm FROM pix2)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with a logits array per class, for the loss metrics."""
    p, y, x = F.col("frame_id"), F.col("y"), F.col("x")
    px = pixels(spark, sf)
    logits = [
        ((p * a + y * b + x * c) % 17 / 4.0 + F.when(F.col("pred_a") == k, 1.5).otherwise(0.0))
        for k, (a, b, c) in enumerate(((31, 7, 3), (13, 5, 11), (17, 19, 2)))
    ]
    teacher = [
        ((p * a + y * b + x * c) % 13 / 4.0 + F.when(F.col("gt") == k, 2.0).otherwise(0.0))
        for k, (a, b, c) in enumerate(((3, 5, 7), (11, 2, 9), (5, 3, 4)))
    ]
    return px.withColumns({"logits": F.array(*logits), "teacher": F.array(*teacher)})


SCORES = (
    PIX
    + """,
scores AS (SELECT *,
  [(frame_id*31 + y*7 + x*3) % 17 / 4.0 + CASE WHEN pred_a = 0 THEN 1.5 ELSE 0.0 END,
   (frame_id*13 + y*5 + x*11) % 17 / 4.0 + CASE WHEN pred_a = 1 THEN 1.5 ELSE 0.0 END,
   (frame_id*17 + y*19 + x*2) % 17 / 4.0 + CASE WHEN pred_a = 2 THEN 1.5 ELSE 0.0 END]::DOUBLE[] AS logits,
  [(frame_id*3 + y*5 + x*7) % 13 / 4.0 + CASE WHEN gt = 0 THEN 2.0 ELSE 0.0 END,
   (frame_id*11 + y*2 + x*9) % 13 / 4.0 + CASE WHEN gt = 1 THEN 2.0 ELSE 0.0 END,
   (frame_id*5 + y*3 + x*4) % 13 / 4.0 + CASE WHEN gt = 2 THEN 2.0 ELSE 0.0 END]::DOUBLE[] AS teacher
  FROM pix),
prob AS (SELECT *, exp(logits[1]) + exp(logits[2]) + exp(logits[3]) AS z FROM scores),
sm AS (SELECT *, exp(logits[1])/z AS p0, exp(logits[2])/z AS p1, exp(logits[3])/z AS p2 FROM prob)"""
)


def points(spark: SparkSession, sf: str, each: int = PER_TASK) -> DataFrame:
    """64 points per cloud, a cloud per row of ``part``; milli-integers in mx, my, mz."""
    c, i = F.col("sample_id"), F.col("point_id")

    def axis(a, b):
        return (c * a + i.cast("bigint") * b) % 2001 - 1000

    return (
        _frame_ids(spark, sf, "sample_id", each)
        .select(
            (F.col("sample_id") % 40).cast("int").alias("set_id"),
            "sample_id",
            F.explode(F.sequence(F.lit(0), F.lit(63))).alias("point_id"),
        )
        .select(
            "*",
            axis(131, 7919).alias("mx"),
            axis(137, 104729).alias("my"),
            axis(139, 15485863).alias("mz"),
            ((c + i) % 5).cast("int").alias("label"),
        )
        .select(
            "*",
            (F.col("mx") / 1000.0).alias("px"),
            (F.col("my") / 1000.0).alias("py"),
            (F.col("mz") / 1000.0).alias("pz"),
        )
    )


PTS = """pts0 AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS set_id, p_partkey AS sample_id,
  CAST(r.i AS INTEGER) AS point_id, p_partkey AS c, CAST(r.i AS BIGINT) AS i
  FROM part, (SELECT range AS i FROM range(64)) r),
pts1 AS (SELECT set_id, sample_id, point_id, (c*131 + i*7919) % 2001 - 1000 AS mx,
  (c*137 + i*104729) % 2001 - 1000 AS my, (c*139 + i*15485863) % 2001 - 1000 AS mz,
  CAST((c + i) % 5 AS INTEGER) AS label FROM pts0),
pts AS (SELECT *, mx / 1000.0::DOUBLE AS px, my / 1000.0::DOUBLE AS py, mz / 1000.0::DOUBLE AS pz FROM pts1)"""


# Fixed tree shape of one skeleton: 30 nodes, two branches, five segments.
SKEL_EDGES = (
    [(k, k + 1) for k in range(19)]
    + [(7, 20)]
    + [(k, k + 1) for k in range(20, 24)]
    + [(14, 25)]
    + [(k, k + 1) for k in range(25, 29)]
)


def skeleton(
    spark: SparkSession, sf: str, source: str = "supplier", key: str = "s_suppkey"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a 30-node tree per row of ``source``."""
    s = table(spark, sf, source).select(F.col(key).alias("sample_id"))
    s = s.repartition(_tasks(spark, s), "sample_id")
    k = F.col("node_id").cast("bigint")
    nodes = s.select(
        "sample_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("node_id")
    ).select(
        "sample_id",
        "node_id",
        (k * 10).cast("double").alias("nx"),
        ((F.col("sample_id") * 3 + k * k) % 50).cast("double").alias("ny"),
        F.lit(0.0).alias("nz"),
    )
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SKEL_EDGES])
    edges = s.select("sample_id", F.inline(pairs))
    return nodes, edges


def skel_sql(source: str = "supplier", key: str = "s_suppkey") -> str:
    return f"""skel_nodes AS (SELECT {key} AS sample_id, CAST(r.k AS INTEGER) AS node_id,
  CAST(r.k*10 AS DOUBLE) AS nx, CAST(({key}*3 + r.k*r.k) % 50 AS DOUBLE) AS ny, 0.0::DOUBLE AS nz
  FROM {source}, (SELECT range AS k FROM range(30)) r),
skel_edges AS (SELECT {key} AS sample_id, e.a AS a, e.b AS b
  FROM {source}, (VALUES {', '.join(str(e) for e in SKEL_EDGES)}) e(a, b))"""


SKEL = skel_sql()
#: A tree for every cloud of ``points``.
CLOUD_SKEL = skel_sql("part", "p_partkey")


def eval_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training-log lines per arm: (arm, step, line), two line kinds per event."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("arm"), "ts", "event_id", "value"
    )
    e = row_index(e, ["arm"], ["ts", "event_id"], "_i")
    e = e.select(
        "arm",
        (F.col("_i") + 1).cast("bigint").alias("step"),
        (F.round(F.col("value") * 100).cast("bigint") % 10000).alias("v"),
    )
    d4 = "0.%04d"
    val = F.format_string(
        f"val: mIoU={d4} IoU(wire)={d4} IoU(bg)={d4} IoU(con)={d4}",
        (F.col("v") * 3) % 10000,
        (F.col("v") * 7) % 10000,
        (F.col("v") * 9) % 10000,
        F.col("v"),
    )
    loss = F.format_string(f"ep %d batch 1 loss={d4}", F.col("step"), F.col("v"))
    return e.select("arm", "step", F.explode(F.array(val, loss)).alias("line"))


EVALS = """ev0 AS (SELECT event_type AS arm,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
  CAST(round(value*100) AS BIGINT) % 10000 AS v FROM events),
evals AS (SELECT arm, step - 1 AS idx, ((v*3)%10000)/10000.0::DOUBLE AS miou, ((v*7)%10000)/10000.0::DOUBLE AS wire,
  ((v*9)%10000)/10000.0::DOUBLE AS bg, v/10000.0::DOUBLE AS con FROM ev0),
losses AS (SELECT arm, step AS epoch, v/10000.0::DOUBLE AS loss FROM ev0)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    """(img_id, img_set, centroid, feat) from ``embeddings``."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("img_id"),
        F.when(F.col("label") < 5, "ref").otherwise("new").alias("img_set"),
        F.col("label").alias("centroid"),
        F.col("embedding").cast("array<double>").alias("feat"),
    )


FEATS = """feats AS (SELECT vec_id AS img_id, CASE WHEN label < 5 THEN 'ref' ELSE 'new' END AS img_set,
  label AS centroid, CAST(unnest(range(len(embedding))) AS INTEGER) AS channel,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Split-manifest rows from ``documents``."""
    d = table(spark, sf, "documents")
    set_id = 2 * F.expr("try_cast(substr(source, 4) as int)")
    return d.select(
        F.col("lang").alias("dataset"),
        set_id.alias("set_id"),
        F.col("doc_id").alias("src"),
        F.lit(0).alias("anim"),
        F.col("lang").alias("view"),
        F.col("doc_id").alias("line_no"),
        F.format_string("%03d_%04d_00_%s", set_id, F.col("doc_id"), F.col("lang")).alias("base"),
    )


MAN = """man AS (SELECT lang AS dataset, 2 * CAST(substr(source, 4) AS INTEGER) AS set_id,
  doc_id AS src, CAST(0 AS INTEGER) AS anim, lang AS view, doc_id AS line_no,
  printf('%03d_%04d_00_%s', 2 * CAST(substr(source, 4) AS INTEGER), doc_id, lang) AS base FROM documents)"""


def content(spark: SparkSession, sf: str) -> DataFrame:
    """(id, kind, sha) of documents and benchmark texts."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("source") == "src0", "protected").otherwise("candidate").alias("kind"),
        F.sha2("text", 256).alias("sha"),
    )
    b = table(spark, sf, "benchmark").select(
        (F.col("item_id") + 1_000_000_000_000).alias("id"),
        F.lit("protected").alias("kind"),
        F.sha2("text", 256).alias("sha"),
    )
    return d.unionByName(b)


CONTENT = """content AS (
  SELECT doc_id AS id, CASE WHEN source = 'src0' THEN 'protected' ELSE 'candidate' END AS kind,
    sha256(text) AS sha FROM documents
  UNION ALL SELECT item_id + 1000000000000, 'protected', sha256(text) FROM benchmark)"""


def sign_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, protected, hash): signs of neighbouring-pair sums of an embedding, as an integer."""
    e = F.col("embedding")
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda k: F.when(F.get(e, 2 * k) + F.get(e, 2 * k + 1) > 0, 1).otherwise(0).cast("bigint"),
    )
    packed = F.aggregate(
        bits, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit)
    )
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") == 0).alias("protected"), packed.alias("hash")
    )


HASHES = """hashes AS (SELECT vec_id AS id, label = 0 AS protected,
  list_reduce(list_prepend(0::BIGINT, list_transform(range(32), lambda k:
    CASE WHEN embedding[2*k+1] + embedding[2*k+2] > 0 THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, b: a*2 + b) AS hash
  FROM embeddings)"""


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("model"),
        (F.col("user_id") % 2).alias("dtype"),
        (1 + F.col("user_id") % 3).alias("batch_size"),
        F.col("event_id").alias("iter"),
        F.col("value").alias("ms"),
    )


TIM = """tim AS (SELECT event_type AS model, user_id % 2 AS dtype, 1 + user_id % 3 AS batch_size,
  event_id AS iter, value AS ms FROM events)"""


def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """gt = quality, pred = toxic, per source: real rows for the confusion family."""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(docs.select("doc_id", "source"), "doc_id").select(
        "source", F.col("quality").alias("gt"), F.col("toxic").alias("pred")
    )


WIDE_H, WIDE_W = 128, 160

#: CTE ``wide`` with the rows of :func:`wide_pixels`
WIDE = f"""wr AS (SELECT p_partkey // 50 AS frame_id, (p_partkey * 37) % 120 AS y0, (p_partkey * 53) % 150 AS x0,
      CASE WHEN p_size >= 49 THEN p_size + 15 ELSE p_size // 8 END AS h, CASE WHEN p_size >= 49 THEN p_size + 5 ELSE p_size // 5 END AS w FROM part),
    wm AS (SELECT DISTINCT frame_id, y, x FROM (SELECT frame_id, y, unnest(range(x0, least(x0 + w, {WIDE_W}))) AS x
      FROM (SELECT *, unnest(range(y0, least(y0 + h, {WIDE_H}))) AS y FROM wr))),
    wide AS (SELECT g.frame_id, g.y, g.x, CAST(wm.x IS NOT NULL AS INTEGER) AS v FROM (SELECT frame_id, ys.y, xs.x
      FROM (SELECT DISTINCT frame_id FROM wr), range(0, {WIDE_H}) ys(y), range(0, {WIDE_W}) xs(x)) g LEFT JOIN wm USING (frame_id, y, x))"""


def wide_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 128 x 160, one per 50 rows of ``part``: v = 1 inside any of their rectangles."""
    big, size, key = F.col("p_size") >= 49, F.col("p_size"), F.col("p_partkey")
    rects = table(spark, sf, "part").select(
        F.floor(key / 50).alias("frame_id"),
        (key * 37 % 120).alias("y0"),
        (key * 53 % 150).alias("x0"),
        F.when(big, size + 15).otherwise(F.floor(size / 8)).alias("h"),
        F.when(big, size + 5).otherwise(F.floor(size / 5)).alias("w"),
    )
    # a frame collects its 50 rectangles, whatever the number of frames
    frames = rects.groupBy("frame_id").agg(F.collect_list(F.struct("y0", "x0", "h", "w")).alias("r"))
    cells = frames.repartition(parallelism(spark), "frame_id").select(
        "frame_id", "r", F.explode(F.sequence(F.lit(0), F.lit(WIDE_H * WIDE_W - 1))).alias("_i")
    )
    y, x = F.floor(F.col("_i") / WIDE_W).cast("int"), F.col("_i") % WIDE_W
    covered = F.exists(
        "r",
        lambda r: (y >= r["y0"]) & (y < r["y0"] + r["h"]) & (x >= r["x0"]) & (x < r["x0"] + r["w"]),
    )
    return cells.select("frame_id", y.alias("y"), x.alias("x"), covered.cast("int").alias("v"))
