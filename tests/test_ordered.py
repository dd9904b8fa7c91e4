import random

import numpy as np
from pyspark.sql import functions as F

from pixelmill.operators import ordered as o


def test_running_splits_one_group_over_many_slices(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", i, rng.randint(-5, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = o.running(df, ["g"], ["i"], {"s": ("sum", "v"), "m": ("max", "v"), "n": ("count", F.lit(1))})
        got = {(r["g"], r["i"]): (r["s"], r["m"], r["n"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("hot", "cold"):
        s, m, n = 0, None, 0
        for _, i, v in sorted(r for r in rows if r[0] == g):
            s, m, n = s + v, v if m is None else max(m, v), n + 1
            assert got[(g, i)] == (s, m, n)


def test_exact_percentiles_match_numpy(spark):
    rng = random.Random(5)
    vals = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(vals, "g string, v double")
    out = o.exact_percentiles(df, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p98": 0.98}).collect()
    for r in out:
        want = np.percentile([v for g, v in vals if g == r["g"]], [5, 50, 98])
        np.testing.assert_allclose([r["p5"], r["p50"], r["p98"]], want, rtol=1e-12)


def test_first_n_both_ways_agree(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 101).alias("v"), "id")
    a = o.first_n(df, 5, ["g"], ["v", "id"])
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "4")
    b = o.first_n(df, 5, ["g"], ["v", "id"])
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert "WindowGroupLimit" in a._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_null_groups_are_groups(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = o.row_index(df, ["g"], ["id"]).collect()
        pct = {r["g"]: (r["n"], r["p50"]) for r in o.exact_percentiles(df, ["g"], "id", {"p50": 0.5}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(r["row_index"] == r["id"] // 2 for r in got) and len(got) == 4000
    assert pct == {"a": (2000, 1999.0), None: (2000, 2000.0)}
