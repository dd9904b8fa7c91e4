"""Live monitors as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pixelmill.operators.metrics import coverage

#: State store that timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_evals(
    stream: DataFrame, every: int = 6, always_from: int = 26, arm: str = "arm", step: str = "step",
    ts: str | None = None, within: str | None = None,
) -> DataFrame:
    """Each (arm, step) once; reported for every 6th step and for late steps.

    The filter runs before the de-duplication, so state holds reported steps only. With
    ``ts`` and ``within``, a step is forgotten when the watermark has passed it by that much,
    so state stays bounded; a repeat that comes later still is reported anew.
    """
    keep = (F.col(step) % every == 0) | (F.col(step) >= always_from)
    kept = stream.filter(keep)
    if ts is None:
        return kept.dropDuplicates([arm, step])
    return kept.withWatermark(ts, within).dropDuplicatesWithinWatermark([arm, step])


_SPANS = "arm string, start_us bigint, stop_us bigint"
_ALERTS = "arm string, last_seen timestamp, resumed timestamp"


def activity_spans(stream: DataFrame, timeout_s: int, arm: str = "arm", ts: str = "ts") -> DataFrame:
    """(arm, start_us, stop_us): times of an arm that follow each other within the timeout.

    Each task shortens the rows it holds to spans, so one busy arm is no long list for anybody.
    Spans of different tasks may overlap. Rows without a time are left out.
    """
    gap = timeout_s * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arms = batch.column(0).dictionary_encode(null_encoding="encode")
            code, us = arms.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((us, code))
            code, us = code[order], us[order]
            new = np.ones(len(us), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (us[1:] - us[:-1] > gap)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(us))[: len(first)] - 1
            cols = [arms.dictionary.take(pa.array(code[first])), pa.array(us[first]), pa.array(us[last])]
            yield pa.RecordBatch.from_arrays(cols, ["arm", "start_us", "stop_us"])

    rows = stream.filter(F.col(ts).isNotNull()).select(F.col(arm).cast("string").alias("arm"), F.unix_micros(ts).alias("us"))
    return rows.mapInArrow(run, _SPANS)


class _Watch(StatefulProcessor):
    """Keeps the last time of an arm; a timer goes off if nothing comes after it."""

    def __init__(self, timeout_s: int, live: bool, forget: int):
        self.timeout_s, self.live, self.forget = timeout_s, live, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, silent int")

    def _wait(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_s * 1000)

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        arms, seen, resumed = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame(
            {
                "arm": pd.Series(arms, dtype=object),
                "last_seen": pd.to_datetime(pd.Series(seen, dtype="Int64"), unit="us").astype("datetime64[us]"),
                "resumed": pd.to_datetime(pd.Series(resumed, dtype="Int64"), unit="us").astype("datetime64[us]"),
            }
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = sorted({(int(a), int(b)) for table in rows for a, b in zip(table["start_us"], table["stop_us"])})
        stop = self.last.get()[0] if self.last.exists() else None
        alerts = []
        for a, b in spans:
            if stop is not None and a - stop > self.timeout_s * 1_000_000:
                alerts.append((key[0], stop, a))
            stop = b if stop is None else max(stop, b)
        self.last.update((stop, 0))
        if self.live:
            self._wait(timerValues)
        yield self._table(alerts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        stop, silent = self.last.get()
        if silent + 1 >= self.forget:
            self.last.clear()
        else:
            self.last.update((stop, silent + 1))
            self._wait(timerValues)
        yield self._table([(key[0], stop, None)])

    def close(self) -> None:
        pass


def stall_detector(
    stream: DataFrame, timeout_s: int = 3600, arm: str = "arm", ts: str = "ts", live: bool = True, forget: int = 24
) -> DataFrame:
    """Alerts (arm, last_seen, resumed) for arms without a new row for ``timeout_s``.

    A gap inside the data is reported with the time the arm came back, also between batches;
    rows that come late don't take an alert back. An arm that is silent in wall-clock time is
    reported with resumed = NULL by a timer that starts anew, and forgotten after ``forget``
    such alerts, so that arms which never come back leave no state. ``live`` = False is for
    backfills, which stop at the end of the data and set no timers.

    The state lives in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to
    ``ROCKSDB`` first.
    """
    spans = activity_spans(stream, timeout_s, arm, ts)
    return spans.groupBy("arm").transformWithStateInPandas(
        statefulProcessor=_Watch(timeout_s, live, forget),
        outputStructType=_ALERTS,
        outputMode="append",
        timeMode="ProcessingTime" if live else "None",
    )


def running_confusion(stream: DataFrame, gt: str = "gt", pred: str = "pred", k: int = 3) -> DataFrame:
    """Confusion counts kept current as prediction batches land (update mode)."""
    ok = F.col(gt).between(0, k - 1) & F.col(pred).between(0, k - 1)
    return (
        stream.filter(ok)
        .groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def batch_writer(path: str, transform=None):
    """foreachBatch sink: every batch goes to its own ``batch=<id>`` folder, so a batch that
    is replayed after a failure replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        out = df if transform is None else transform(df)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def frame_coverage_writer(path: str, fg, frame: str = "frame_id"):
    """Per-frame coverage appended as whole frames arrive. ``fg`` builds the mask column."""
    return batch_writer(path, lambda df: coverage(df, fg(), frame))


def run_available(stream: DataFrame, checkpoint: str, sink: str | None = None, mode="append", each=None):
    """Process everything that is there and stop; used for backfills and tests."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if each is not None:
        w = w.foreachBatch(each)
    else:
        w = w.format("parquet").option("path", sink)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()


def latest_per_key(history: DataFrame, keys: list[str], value: str, batch: str = "batch") -> DataFrame:
    """Current value per key from the update batches."""
    newest: Column = F.max_by(value, F.col(batch))
    return history.groupBy(*keys).agg(newest.alias(value))
