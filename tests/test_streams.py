"""Monitors on live streams: gaps in the data, and an arm that falls silent."""

import time

import pytest
from pyspark.sql import functions as F

from pixelmill.streaming import monitors as mo


@pytest.fixture
def source(spark, tmp_path):
    kind = "arm string, step bigint, ts timestamp"
    state = {"n": 0}

    def put(*rows):
        state["n"] += 1
        df = spark.createDataFrame([(a, s, t) for a, s, t in rows], "arm string, step bigint, t string")
        df.select("arm", "step", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{state['n']:03d}")

    (tmp_path / "in").mkdir()
    read = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mo.ROCKSDB)
    yield put, read, str(tmp_path)


def day(h, m=0):
    return f"2025-01-01 {h:02d}:{m:02d}:00"


def test_gaps_within_and_between_batches(spark, source):
    put, read, path = source
    put(("a", 1, day(1)), ("a", 2, day(1, 30)), ("a", 3, day(4)), ("b", 1, day(1)), ("a", 9, None))
    put(("a", 4, day(4, 50)), ("b", 2, day(9)), ("a", 5, day(4, 20)))
    alerts = mo.stall_detector(read(), 3600, live=False)
    mo.run_available(alerts, f"{path}/c", f"{path}/out")
    got = spark.read.schema(alerts.schema).parquet(f"{path}/out").select("arm", F.hour("last_seen"), F.minute("last_seen"), F.hour("resumed"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 30, 4), ("b", 1, 0, 9)]


def test_a_silent_arm_is_reported_live(spark, source):
    put, read, path = source
    put(("a", 1, day(1)), ("b", 1, day(1)))
    q = mo.stall_detector(read(), 3, forget=2).writeStream.format("memory").queryName("stalls").option("checkpointLocation", f"{path}/c").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("stalls").filter("resumed is null").count() < 4:
            time.sleep(1)
        rows = [tuple(r) for r in spark.table("stalls").select("arm", F.col("resumed").isNull()).collect()]
        # both arms, twice, and then they are forgotten
        assert sorted(rows) == [("a", True)] * 2 + [("b", True)] * 2
        time.sleep(5)
        assert spark.table("stalls").count() == 4
        put(("a", 2, day(1, 5)))
        until = time.time() + 60
        while time.time() < until and spark.table("stalls").count() < 5:
            time.sleep(1)
        assert spark.table("stalls").filter("arm = 'a'").count() >= 3
    finally:
        q.stop()


def test_repeats_are_forgotten(spark, source):
    put, read, path = source
    put(("a", 6, day(1)), ("a", 6, day(1, 1)), ("a", 7, day(1)))
    put(("a", 12, day(12)))
    put(("a", 12, day(12, 5)), ("a", 30, day(23)))
    put(("a", 6, day(23, 30)))
    out = mo.new_evals(read(), ts="ts", within="1 hour")
    mo.run_available(out, f"{path}/c", f"{path}/out")
    got = spark.read.schema(out.schema).parquet(f"{path}/out").select("arm", "step").collect()
    assert sorted(map(tuple, got)) == [("a", 6), ("a", 6), ("a", 12), ("a", 30)]
