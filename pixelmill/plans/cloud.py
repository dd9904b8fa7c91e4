"""Queries of the point-cloud and skeleton operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pixelmill.operators import cloud as cl
from pixelmill.operators import skeleton as sk
from pixelmill.operators import windows as wi
from pixelmill.plans.digest import digest, digest_sql
from pixelmill.plans.fixtures import CLOUD_SKEL, CLOUDS, PIX, PTS, SKEL, pixels, points, skeleton
from pixelmill.plans.registry import query, r6, r9
from pixelmill.plans.windows import motion

SIZE = (24, 32)
VIEWS = cl.canonical_views()
S = SIZE[0] / (2 * cl.FRUSTUM)


def _round(df, f, *cols):
    return df.withColumns({c: f(F.col(c)) for c in cols})


_VROWS = ", ".join(
    f"('{n}', {', '.join(f'{float(c)}::DOUBLE' for row in m for c in row)})" for n, m in VIEWS.items()
)
PROJ = f"""vw(view, r0, r1, r2, r3, r4, r5, r6, r7, r8) AS (VALUES {_VROWS}),
    pj AS (SELECT pts.*, view, px*r0 + py*r1 + pz*r2 AS cx, px*r3 + py*r4 + pz*r5 AS cy, px*r6 + py*r7 + pz*r8 AS cz FROM pts, vw),
    pu AS (SELECT *, CAST(round_even(cx*{S!r}::DOUBLE + 16.0, 0) AS INTEGER) AS u, CAST(round_even(cy*{S!r}::DOUBLE + 12.0, 0) AS INTEGER) AS v,
      CAST(floor((cz + 1.1::DOUBLE)/2.2::DOUBLE*1000.0 + 500.0) AS INTEGER) AS mm FROM pj WHERE cz BETWEEN -1.1::DOUBLE AND 1.1::DOUBLE)"""


def _disc_sql(r: int) -> str:
    return ", ".join(str(o) for o in cl._disc(r))


ZBUF = f"""{PROJ}, sp AS (SELECT sample_id, view, v + o.dy AS y, u + o.dx AS x, mm, point_id, label FROM pu, (VALUES {_disc_sql(1)}) o(dx, dy) WHERE label <> 3
      UNION ALL SELECT sample_id, view, v + o.dy, u + o.dx, mm, point_id, label FROM pu, (VALUES {_disc_sql(2)}) o(dx, dy) WHERE label = 3),
    zb AS (SELECT sample_id, view, y, x, min(mm) AS depth_mm, arg_min(label + 1, mm*100 + point_id) AS label6, CAST(min(mm*100 + point_id) % 100 AS INTEGER) AS point_id
      FROM sp WHERE y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 31 GROUP BY ALL)"""


def _zbuf(spark, sf):
    return cl.z_buffer(cl.project(points(spark, sf), VIEWS), SIZE, big_scale=1.5)


@query(
    "G1",
    f"""WITH {PTS}, {PROJ} SELECT sample_id, view, round(sum(cx), 9) AS cx, round(sum(cy), 9) AS cy, round(sum(cz), 9) AS cz, count(*) AS n FROM pj GROUP BY ALL""",
)
def project(spark, sf):
    d = cl.project(points(spark, sf), VIEWS)
    return d.groupBy("sample_id", "view").agg(
        *[r9(F.sum(c)).alias(c) for c in ("cx", "cy", "cz")], F.count(F.lit(1)).alias("n")
    )


@query("G2", f"WITH {PTS}, {ZBUF} " + digest_sql("zb", "sample_id, view", ["depth_mm", "label6", "point_id"]))
def z_buffer(spark, sf):
    return digest(_zbuf(spark, sf), ["sample_id", "view"], ["depth_mm", "label6", "point_id"])


@query(
    "G3",
    f"""WITH {PTS}, {ZBUF}, fr AS MATERIALIZED (SELECT sample_id, view, y, x, depth_mm, label6 FROM zb),
    dl AS MATERIALIZED (SELECT DISTINCT f.sample_id, f.view, f.y + a.range AS y, f.x + b.range AS x FROM fr f, range(-1, 2) a, range(-1, 2) b WHERE f.y + a.range BETWEEN 0 AND 23 AND f.x + b.range BETWEEN 0 AND 31),
    nb0 AS (SELECT d.sample_id, d.view, d.y, d.x, d.y + a.range AS sy, d.x + b.range AS sx FROM dl d, range(-1, 2) a, range(-1, 2) b WHERE d.y + a.range BETWEEN 0 AND 23 AND d.x + b.range BETWEEN 0 AND 31),
    cls AS (SELECT n.sample_id, n.view, n.y, n.x FROM nb0 n LEFT JOIN dl ON dl.sample_id = n.sample_id AND dl.view = n.view AND dl.y = n.sy AND dl.x = n.sx GROUP BY ALL HAVING count(dl.y) = count(*)),
    gap AS (SELECT * FROM cls ANTI JOIN fr USING (sample_id, view, y, x)),
    nn AS (SELECT g.sample_id, g.view, g.y, g.x, arg_min(struct_pack(d := f.depth_mm, l := f.label6), ((g.y-f.y)*(g.y-f.y) + (g.x-f.x)*(g.x-f.x))*1000000 + f.y*1000 + f.x) AS s FROM gap g JOIN fr f USING (sample_id, view) GROUP BY ALL),
    al AS (SELECT sample_id, view, y, x, depth_mm, label6, CAST(0 AS INTEGER) AS filled FROM fr UNION ALL SELECT sample_id, view, y, x, s.d, s.l, 1 FROM nn)
    SELECT sample_id, view, count(*) AS n, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(depth_mm*(y*37+x+1)) AS BIGINT) AS depth, CAST(sum(label6*(y*37+x+1)) AS BIGINT) AS label FROM al GROUP BY sample_id, view""",
)
def fill_gaps(spark, sf):
    frame = F.concat_ws("/", "sample_id", "view").alias("frame")
    z = _zbuf(spark, sf).select("*", frame)
    full = cl.dense(z, SIZE, ["frame", "sample_id", "view"], ["depth_mm", "label6"])
    out = cl.fill_gaps(full, "frame").filter(F.col("depth_mm") > 0)
    place = F.col("y") * 37 + F.col("x") + 1
    return out.groupBy("sample_id", "view").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("filled").alias("filled"),
        F.sum(F.col("depth_mm") * place).alias("depth"),
        F.sum(F.col("label6") * place).alias("label"),
    )


WORLD = f"""wc AS (SELECT sample_id, view, y, x, zb.label6, depth_mm, (x - 16.0)/{S!r}::DOUBLE AS c0, (y - 12.0)/{S!r}::DOUBLE AS c1, (depth_mm - 500.0)/1000.0*2.2::DOUBLE - 1.1::DOUBLE AS c2 FROM zb),
    wd AS (SELECT wc.*, c0*r0 + c1*r3 + c2*r6 AS wx, c0*r1 + c1*r4 + c2*r7 AS wy, c0*r2 + c1*r5 + c2*r8 AS wz FROM wc JOIN vw USING (view))"""


@query(
    "G4",
    f"""WITH {PTS}, {ZBUF}, {WORLD} SELECT sample_id, count(*) AS n, round(sum(wx), 6) AS px, round(sum(wy), 6) AS py, round(sum(wz), 6) AS pz FROM wd GROUP BY sample_id""",
)
def unproject(spark, sf):
    w = cl.unproject(_zbuf(spark, sf), VIEWS, SIZE)
    return w.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.sum(a)).alias(a) for a in cl.AXES]
    )


@query(
    "G5",
    f"""WITH {PIX}, b AS (SELECT frame_id, (x - 15.5)/40.0*(depth_mm*0.001::DOUBLE) AS px, (y - 11.5)/42.0*(depth_mm*0.001::DOUBLE) AS py, depth_mm*0.001::DOUBLE AS pz FROM pix
      WHERE depth_mm > 0 AND depth_mm*0.001::DOUBLE BETWEEN 0.6 AND 1.3)
    SELECT frame_id, count(*) AS n, round(sum(px), 6) AS px, round(sum(py), 6) AS py, round(sum(pz), 6) AS pz FROM b GROUP BY frame_id""",
)
def backproject_pinhole(spark, sf):
    d = cl.backproject_pinhole(pixels(spark, sf), 40.0, 42.0, 15.5, 11.5, z_min=0.6, z_max=1.3)
    return d.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.sum(a)).alias(a) for a in cl.AXES]
    )


def _axes_sum(df):
    k = F.col("point_id") + 1
    return df.groupBy("sample_id").agg(*[r6(F.sum(F.col(a) * k)).alias(a) for a in cl.AXES])


_AXSUM = ", ".join(f"round(sum({a}*(point_id + 1)), 6) AS {a}" for a in cl.AXES)


@query(
    "G6",
    f"""WITH {PTS}, m AS (SELECT sample_id, avg(px) AS mx_, avg(py) AS my_, avg(pz) AS mz_ FROM pts GROUP BY sample_id),
    c AS (SELECT sample_id, point_id, px - mx_ AS a, py - my_ AS b, pz - mz_ AS c FROM pts JOIN m USING (sample_id)),
    h AS (SELECT sample_id, 0.9::DOUBLE*1.1::DOUBLE/max(greatest(abs(a), abs(b), abs(c))) AS k FROM c GROUP BY sample_id), o AS (SELECT sample_id, point_id, a*k AS px, b*k AS py, c*k AS pz FROM c JOIN h USING (sample_id))
    SELECT sample_id, {_AXSUM} FROM o GROUP BY sample_id""",
)
def normalise_cloud(spark, sf):
    return _axes_sum(cl.normalise_cloud(points(spark, sf)))


@query(
    "G7",
    f"""WITH {PTS}, m AS (SELECT sample_id, (min(px)+max(px))/2 AS cx, min(py) AS cy, (min(pz)+max(pz))/2 AS cz, greatest(max(px)-min(px), max(py)-min(py), max(pz)-min(pz)) AS e FROM pts GROUP BY sample_id),
    o AS (SELECT sample_id, point_id, (px-cx)/e AS px, (py-cy)/e AS py, (pz-cz)/e AS pz FROM pts JOIN m USING (sample_id)) SELECT sample_id, {_AXSUM} FROM o GROUP BY sample_id""",
)
def local_frame(spark, sf):
    return _axes_sum(cl.local_frame(points(spark, sf)))


@query("G16", f"WITH {PTS} SELECT sample_id, point_id, mz FROM pts WHERE pz BETWEEN -0.25 AND 0.3")
def crop_axis(spark, sf):
    return cl.crop_axis(points(spark, sf), "pz", -0.25, 0.3).select("sample_id", "point_id", "mz")


D2 = "(a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz)"


@query(
    "J9",
    f"""WITH {PTS}, d AS (SELECT a.sample_id, a.point_id, b.point_id AS near_id, {D2} AS d2 FROM pts a JOIN pts b ON a.sample_id = b.sample_id AND a.label < 3 AND b.label >= 3),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id, point_id ORDER BY d2, near_id) AS INTEGER) AS rank FROM d)
    SELECT sample_id, point_id, rank, near_id, round(sqrt(d2), 9) AS distance FROM r WHERE rank <= 2""",
)
def nearest_point(spark, sf):
    p = points(spark, sf)
    out = cl.nearest_point(p.filter("label < 3"), p.filter("label >= 3"), 2)
    return _round(out, r9, "distance")


@query(
    "J10",
    f"""WITH {PTS}, d AS (SELECT a.sample_id, a.point_id, b.point_id AS near_id, {D2} AS d2 FROM pts a JOIN pts b ON a.sample_id = b.sample_id WHERE {D2} <= 0.25),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, point_id ORDER BY near_id) AS rn FROM d)
    SELECT sample_id, point_id, near_id, round(sqrt(d2), 9) AS distance FROM r WHERE rn <= 4""",
)
def within_radius(spark, sf):
    p = points(spark, sf)
    return _round(cl.within_radius(p, p, 0.5, 4), r9, "distance")


BIND = """sp AS (SELECT sample_id, point_id, px*100 AS px, py*100 AS py, pz*100 AS pz FROM pts),
    se AS (SELECT e.*, x.nx AS ax, x.ny AS ay, x.nz AS az, z.nx - x.nx AS ex, z.ny - x.ny AS ey, z.nz - x.nz AS ez FROM skel_edges e JOIN skel_nodes x ON x.sample_id = e.sample_id AND x.node_id = e.a
      JOIN skel_nodes z ON z.sample_id = e.sample_id AND z.node_id = e.b),
    bt AS (SELECT p.sample_id, p.point_id, a, b, px-ax AS vx, py-ay AS vy, pz-az AS vz, ex, ey, ez, greatest(0.0, least(1.0, ((px-ax)*ex + (py-ay)*ey + (pz-az)*ez)/greatest(ex*ex + ey*ey + ez*ez, 1e-12))) AS t
      FROM sp p JOIN se e USING (sample_id)),
    bd AS (SELECT *, (vx-t*ex)*(vx-t*ex) + (vy-t*ey)*(vy-t*ey) + (vz-t*ez)*(vz-t*ez) AS d2 FROM bt),
    bind AS (SELECT * FROM bd QUALIFY row_number() OVER (PARTITION BY sample_id, point_id ORDER BY d2, a, b) = 1)"""


def bound(spark, sf):
    nodes, edges = skeleton(spark, sf, "part", "p_partkey")
    p = points(spark, sf).withColumns({a: F.col(a) * 100 for a in cl.AXES})
    return p, nodes, edges, cl.bind_to_edge(p, nodes, edges)


@query(
    "J11",
    f"""WITH {PTS}, {CLOUD_SKEL}, {BIND} SELECT sample_id, point_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(t, 9) AS t, round(1-t, 9) AS weight_a, round(sqrt(d2), 9) AS distance FROM bind""",
)
def bind_to_edge(spark, sf):
    out = bound(spark, sf)[3]
    cols = ["sample_id", "point_id", "a", "b", "t", "weight_a", "distance"]
    return _round(out.select(*cols), r9, "t", "weight_a", "distance")


WNEAR = """wn AS (SELECT w.sample_id, view, y, x, label6, min((wx-px)*(wx-px) + (wy-py)*(wy-py) + (wz-pz)*(wz-pz)) AS d2,
      arg_min(p.label, ((wx-px)*(wx-px) + (wy-py)*(wy-py) + (wz-pz)*(wz-pz), p.point_id)) AS nl FROM wd w JOIN pts p ON p.sample_id = w.sample_id GROUP BY ALL)"""


@query(
    "G8",
    f"""WITH {PTS}, {ZBUF}, {WORLD}, {WNEAR} SELECT sample_id, view, count(*) AS n, round(avg(sqrt(d2)), 9) AS mean, round(max(sqrt(d2)), 9) AS max,
      round(quantile_cont(sqrt(d2), 0.95), 9) AS p95 FROM wn GROUP BY ALL""",
)
def roundtrip_error(spark, sf):
    out = cl.roundtrip_error(points(spark, sf), _zbuf(spark, sf), VIEWS, SIZE)
    return _round(out, r9, "mean", "p95", "max")


@query(
    "G9",
    f"""WITH {PTS}, {PROJ}, v AS (SELECT sample_id, point_id, max(CAST(cz BETWEEN -1.1 AND 1.1 AND cx*{S!r}::DOUBLE*2 + 16 >= 0 AND cx*{S!r}::DOUBLE*2 + 16 < 32 AND cy*{S!r}::DOUBLE*2 + 24 >= 0 AND cy*{S!r}::DOUBLE*2 + 24 < 48 AS INTEGER)) AS i FROM pj GROUP BY ALL)
    SELECT sample_id, count(*) AS points, CAST(sum(i) AS BIGINT) AS visible, round(avg(i), 9) AS coverage FROM v GROUP BY sample_id""",
)
def view_coverage(spark, sf):
    # a narrow image, so that some points fall outside every view
    return _round(cl.view_coverage(points(spark, sf), VIEWS, (48, 32)), r9, "coverage")


@query(
    "G10",
    f"""WITH {PTS}, {ZBUF}, {WORLD}, {WNEAR} SELECT CAST(label6 AS INTEGER) AS label6, count(*) AS n, count(*) FILTER (nl + 1 = label6) AS agree, round(count(*) FILTER (nl + 1 = label6)/count(*), 9) AS share FROM wn GROUP BY label6""",
)
def label_consistency(spark, sf):
    out = cl.label_consistency(points(spark, sf), _zbuf(spark, sf), VIEWS, SIZE)
    return _round(out, r9, "share")


PAIRS = [("front", "back"), ("right", "left"), ("top", "bottom")]


@query(
    "G11",
    f"""WITH {PTS}, {ZBUF}, {WORLD}, pr(a, b) AS (VALUES ('front', 'back'), ('right', 'left'), ('top', 'bottom')),
    d AS (SELECT f.sample_id, pr.a || '-' || pr.b AS pair, f.y, f.x, sqrt(min((f.wx-s.wx)*(f.wx-s.wx) + (f.wy-s.wy)*(f.wy-s.wy) + (f.wz-s.wz)*(f.wz-s.wz))) AS d
      FROM wd f JOIN pr ON pr.a = f.view JOIN wd s ON s.sample_id = f.sample_id AND s.view = pr.b
      AND abs(f.wx-s.wx) <= 0.1 AND abs(f.wy-s.wy) <= 0.1 AND abs(f.wz-s.wz) <= 0.1 GROUP BY ALL)
    SELECT sample_id, pair, count(*) AS matches, round(avg(d), 9) AS mean_error FROM d WHERE d < 0.1 GROUP BY ALL""",
)
def cross_view_error(spark, sf):
    out = cl.cross_view_error(_zbuf(spark, sf), VIEWS, PAIRS, SIZE, 0.1)
    return _round(out, r9, "mean_error")


@query(
    "G12",
    f"""WITH {PTS}, {ZBUF}, e AS (SELECT sample_id, view, min((cz + 1.1)/2.2::DOUBLE*1000 + 500) AS lo, max((cz + 1.1)/2.2::DOUBLE*1000 + 500) AS hi FROM pj GROUP BY ALL),
    g AS (SELECT sample_id, view, min(depth_mm) AS a, max(depth_mm) AS b, avg(depth_mm) AS m FROM zb GROUP BY ALL)
    SELECT sample_id, view, round(lo, 6) AS expected_min, round(hi, 6) AS expected_max, a AS actual_min, b AS actual_max, round(m, 6) AS actual_mean,
      a >= greatest(lo - 2, 500) AND b <= least(hi + 2, 1500) AND m BETWEEN lo - 2 AND hi + 2 AS passed FROM e JOIN g USING (sample_id, view)""",
)
def depth_envelope(spark, sf):
    out = cl.depth_envelope(points(spark, sf), _zbuf(spark, sf), VIEWS, SIZE)
    return _round(out, r6, "expected_min", "expected_max", "actual_mean")


@query(
    "G13",
    f"""WITH {PTS}, d AS (SELECT a.sample_id, a.point_id, a.label, sqrt(min({D2})) AS d FROM pts a JOIN pts b ON a.sample_id = b.sample_id AND b.point_id % 2 = 1 GROUP BY ALL)
    SELECT label, round(avg(CASE WHEN d < 0.4 THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(avg(d), 9) AS mean, round(max(d), 9) AS max, count(*) AS n, round(median(d), 9) AS median FROM d GROUP BY label""",
)
def cloud_coverage(spark, sf):
    p = points(spark, sf, CLOUDS)
    out = cl.cloud_coverage(p, p.filter(F.col("point_id") % 2 == 1), 0.4)
    return _round(out, r9, "coverage", "mean", "max", "median")


EPS = {0: 0.5, 1: 0.6, 2: 0.7, 3: 0.7, 4: 0.8}
_EPS = "CASE a.label WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END"


@query(
    "G14",
    f"""WITH RECURSIVE {PTS}, nb AS MATERIALIZED (SELECT a.sample_id, a.label, a.point_id AS p, b.point_id AS q FROM pts a JOIN pts b ON a.sample_id = b.sample_id AND a.label = b.label WHERE {D2} <= ({_EPS})*({_EPS})),
    core AS MATERIALIZED (SELECT sample_id, label, p FROM nb GROUP BY ALL HAVING count(*) >= 3),
    ce AS MATERIALIZED (SELECT nb.* FROM nb SEMI JOIN core USING (sample_id, label, p) SEMI JOIN (SELECT sample_id, label, p AS q FROM core) c USING (sample_id, label, q)),
    rch(sample_id, label, p, root) AS (SELECT sample_id, label, p, p FROM core UNION SELECT e.sample_id, e.label, e.q, r.root FROM rch r JOIN ce e ON e.sample_id = r.sample_id AND e.label = r.label AND e.p = r.p),
    cc AS (SELECT sample_id, label, p, min(root) AS c FROM rch GROUP BY ALL),
    bo AS (SELECT nb.sample_id, nb.label, nb.p, min(c) AS c FROM nb JOIN cc ON cc.sample_id = nb.sample_id AND cc.label = nb.label AND cc.p = nb.q GROUP BY ALL)
    SELECT pts.sample_id, pts.label, pts.point_id, CAST(coalesce(cc.c, bo.c, -1) AS BIGINT) AS cluster FROM pts LEFT JOIN cc ON cc.sample_id = pts.sample_id AND cc.label = pts.label AND cc.p = pts.point_id
      LEFT JOIN bo ON bo.sample_id = pts.sample_id AND bo.label = pts.label AND bo.p = pts.point_id""",
)
def dbscan(spark, sf):
    return cl.dbscan(points(spark, sf), EPS, 3)


@query(
    "G15",
    f"""WITH {PTS}, d AS (SELECT a.sample_id, a.point_id, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.sample_id, a.point_id ORDER BY {D2}, b.point_id) AS rn FROM pts a JOIN pts b ON a.sample_id = b.sample_id),
    m AS (SELECT sample_id, point_id, avg(d) AS md FROM d WHERE rn <= 6 GROUP BY ALL), s AS (SELECT sample_id, avg(md) AS mu, stddev_samp(md) AS sd FROM m GROUP BY sample_id)
    SELECT sample_id, point_id, round(md, 9) AS mean_distance, md <= mu + 1.0*sd AS keep FROM m JOIN s USING (sample_id)""",
)
def statistical_outliers(spark, sf):
    out = cl.statistical_outliers(points(spark, sf, CLOUDS), 6, 1.0)
    return _round(out, r9, "mean_distance")


def _draw(tag: str, *keys: str) -> str:
    """SQL of ``seeded.uniform``."""
    key = " || ".join(f"'|' || {k}" for k in keys)
    return f"(CAST(('0x' || substr(md5('{tag}' || {key}), 1, 8)) AS BIGINT)/4294967296.0::DOUBLE)"


def _normal(tag: str, *keys: str) -> str:
    """SQL of ``seeded.normal``."""
    u, v = _draw(f"{tag}/u", *keys), _draw(f"{tag}/v", *keys)
    return f"(sqrt(-2.0::DOUBLE*ln(1.0::DOUBLE - {u}))*cos(6.283185307179586::DOUBLE*{v}))"


def _spread(axis: str) -> str:
    z = _normal(f"3/{axis}", "sample_id", "point_id", "copy")
    return f"round(avg({axis} + CASE WHEN copy > 0 THEN std*{z} ELSE 0 END), 6) AS {axis}"


@query(
    "G17",
    f"""WITH {PTS}, e AS (SELECT sample_id, count(*) AS k, (max(px)-min(px) + max(py)-min(py) + max(pz)-min(pz))/3.0 AS ext FROM pts GROUP BY sample_id),
    d AS (SELECT pts.*, k, row_number() OVER (PARTITION BY sample_id ORDER BY point_id) - 1 AS i, 0.2::DOUBLE*ext/greatest(pow(k, 1.0::DOUBLE/3.0), 1.0) AS std,
      unnest(range(greatest(CAST(ceil(150/k) AS BIGINT), 1))) AS copy FROM pts JOIN e USING (sample_id))
    SELECT sample_id, count(*) AS n, {', '.join(_spread(a) for a in cl.AXES)} FROM d WHERE copy = 0 OR copy*k + i < 150 GROUP BY sample_id""",
)
def densify(spark, sf):
    out = cl.densify(points(spark, sf), 150, 0.2, 3)
    return out.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(a)).alias(a) for a in cl.AXES]
    )


@query(
    "G18",
    f"""WITH {PTS}, s AS (SELECT *, {_draw('5/turn', 'sample_id')}*{2 * math.pi!r}::DOUBLE AS th, 0.8::DOUBLE + 0.4::DOUBLE*{_draw('5/scale', 'sample_id')} AS k FROM pts),
    o AS (SELECT sample_id, point_id, (cos(th)*px - sin(th)*py)*k + 0.01::DOUBLE*{_normal('5/px', 'sample_id', 'point_id')} AS px,
      (sin(th)*px + cos(th)*py)*k + 0.01::DOUBLE*{_normal('5/py', 'sample_id', 'point_id')} AS py, pz*k + 0.01::DOUBLE*{_normal('5/pz', 'sample_id', 'point_id')} AS pz FROM s)
    SELECT sample_id, {_AXSUM} FROM o GROUP BY sample_id""",
)
def augment_cloud(spark, sf):
    return _axes_sum(cl.augment_cloud(points(spark, sf), 5))


def _u(tag: str) -> str:
    return f"(CAST(('0x' || substr(md5('4/{tag}|' || clip || '|' || pair), 1, 8)) AS BIGINT)/4294967296.0::DOUBLE)"


@query(
    "G19",
    f"""WITH {PTS}, mo AS (SELECT sample_id - sample_id % 5 AS clip, sample_id % 5 AS frame, point_id, px, py, pz FROM pts),
    dr AS (SELECT clip, r.range AS pair FROM (SELECT DISTINCT clip FROM mo), range(40) r), ij AS (SELECT clip, pair, CAST(floor({_u('i')}*64) AS INTEGER) AS i, CAST(floor({_u('j')}*64) AS INTEGER) AS j FROM dr),
    d AS (SELECT ij.clip, pair, a.frame, sqrt({D2}) AS d FROM ij JOIN mo a ON a.clip = ij.clip AND a.point_id = i JOIN mo b ON b.clip = ij.clip AND b.frame = a.frame AND b.point_id = j),
    f AS (SELECT d.clip, d.frame, avg(abs(d.d - o.d)/(o.d + 1e-8)) AS r FROM d JOIN d o ON o.clip = d.clip AND o.pair = d.pair AND o.frame = 0 GROUP BY ALL)
    SELECT clip, round(avg(r), 6) AS mean_relative_change, round(max(r), 6) AS max_relative_change FROM f GROUP BY clip""",
)
def distance_preservation(spark, sf):
    out = cl.distance_preservation(motion(spark, sf), 40, 4)
    return _round(out, r6, "mean_relative_change", "max_relative_change")


# ---- skeletons

ARCS = """arc AS (SELECT sample_id, a AS u, b AS v FROM skel_edges UNION ALL SELECT sample_id, b, a FROM skel_edges),
    deg AS (SELECT sample_id, u AS n, count(*) AS degree FROM arc GROUP BY ALL)"""


@query(
    "H1",
    f"WITH {SKEL}, {ARCS} SELECT sample_id, CAST(n AS INTEGER) AS node_id, degree, degree <> 2 AS structural FROM deg",
)
def node_degrees(spark, sf):
    return sk.node_degrees(skeleton(spark, sf)[1])


WALK = f"""{ARCS}, wk(sample_id, s0, s1, pos, u, v) AS (
      SELECT arc.sample_id, u, v, 1, u, v FROM arc JOIN deg ON deg.sample_id = arc.sample_id AND deg.n = u AND degree <> 2
      UNION ALL SELECT w.sample_id, s0, s1, pos + 1, a.u, a.v FROM wk w JOIN deg ON deg.sample_id = w.sample_id AND deg.n = w.v AND degree = 2
        JOIN arc a ON a.sample_id = w.sample_id AND a.u = w.v AND a.v <> w.u),
    en AS (SELECT sample_id, s0, s1, arg_max(v, pos) AS e0, arg_max(u, pos) AS e1 FROM wk GROUP BY ALL),
    kp AS (SELECT * FROM en WHERE s0 < e0 OR (s0 = e0 AND s1 <= e1)),
    sg AS (SELECT wk.sample_id, wk.s0, wk.s1, pos, v AS node FROM wk JOIN kp USING (sample_id, s0, s1) UNION ALL SELECT sample_id, s0, s1, 0, s0 FROM kp)"""


@query(
    "H2",
    f"""WITH RECURSIVE {SKEL}, {WALK} SELECT sample_id, CAST(s0 AS INTEGER) AS seg_start, CAST(s1 AS INTEGER) AS seg_next, CAST(pos AS BIGINT) AS pos, CAST(node AS INTEGER) AS node_id FROM sg""",
)
def segments(spark, sf):
    return sk.segments(skeleton(spark, sf)[1])


ROOT = """ctr AS (SELECT sample_id, avg(nx) AS mx, avg(ny) AS my FROM skel_nodes GROUP BY sample_id),
    rt AS (SELECT n.sample_id, arg_min(n.node_id, ((nx-mx)*(nx-mx) + (ny-my)*(ny-my), n.node_id)) AS root FROM skel_nodes n JOIN ctr USING (sample_id) JOIN deg ON deg.sample_id = n.sample_id AND deg.n = n.node_id AND degree <> 2 GROUP BY n.sample_id)"""


@query("H3", f"WITH {SKEL}, {ARCS}, {ROOT} SELECT sample_id, root FROM rt")
def pick_root(spark, sf):
    return sk.pick_root(*skeleton(spark, sf))


@query(
    "H4",
    f"""WITH RECURSIVE {SKEL}, {ARCS}, {ROOT}, bf(sample_id, n, parent, depth) AS (SELECT sample_id, root, CAST(NULL AS INTEGER), 0 FROM rt
      UNION ALL SELECT b.sample_id, a.v, b.n, b.depth + 1 FROM bf b JOIN arc a ON a.sample_id = b.sample_id AND a.u = b.n AND a.v IS DISTINCT FROM b.parent)
    SELECT sample_id, CAST(n AS INTEGER) AS node_id, parent, CAST(depth AS INTEGER) AS depth FROM bf""",
)
def bfs_parents(spark, sf):
    nodes, edges = skeleton(spark, sf)
    return sk.bfs_parents(edges, sk.pick_root(nodes, edges))


@query(
    "H5",
    f"""WITH RECURSIVE {SKEL}, {WALK}, l AS (SELECT *, max(pos) OVER (PARTITION BY sample_id, s0, s1) AS last FROM sg)
    SELECT DISTINCT sample_id, CAST(node AS INTEGER) AS node_id FROM l WHERE pos = 0 OR pos = last OR (pos - 1) % 3 = 0""",
)
def pick_joints(spark, sf):
    return sk.pick_joints(sk.segments(skeleton(spark, sf)[1]), 3)


@query(
    "W13",
    f"""WITH RECURSIVE {SKEL}, {WALK}, c AS (SELECT sg.*, nx, ny FROM sg JOIN skel_nodes n ON n.sample_id = sg.sample_id AND n.node_id = node),
    l AS (SELECT *, coalesce(sqrt(pow(nx - lag(nx) OVER w, 2) + pow(ny - lag(ny) OVER w, 2)), 0.0) AS st FROM c WINDOW w AS (PARTITION BY sample_id, s0, s1 ORDER BY pos))
    SELECT sample_id, CAST(s0 AS INTEGER) AS seg_start, CAST(s1 AS INTEGER) AS seg_next, CAST(node AS INTEGER) AS node_id,
      round(sum(st) OVER (PARTITION BY sample_id, s0, s1 ORDER BY pos), 9) AS arc FROM l""",
)
def arc_length(spark, sf):
    nodes, edges = skeleton(spark, sf)
    chain = sk.segments(edges).join(nodes, ["sample_id", "node_id"])
    out = wi.arc_length(chain, ["sample_id", "seg_start", "seg_next"], "pos")
    return _round(out.select("sample_id", "seg_start", "seg_next", "node_id", "arc"), r9, "arc")
