"""Sleep scores as a stream: labels of epochs once no later row can change them."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.sleep import COLE_KRIPKE, HALO, SLEEP, WAKE, WEBSTER

OUTPUT = "pid string, ts timestamp, activity double, label int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_sleep(activity: DataFrame, late: str = "1 hour", quiet: str = "2 days") -> DataFrame:
    """(pid, ts, activity, label) of a stream of activity: what score_sleep gives for the whole recording, in any batching.

    An epoch is closed once the watermark (``late``) is past it, and its label
    goes out once HALO later epochs are closed too, as no row beyond those has
    a say. A pid's last epochs go out when the watermark is ``quiet`` past
    them: the recording is over, and rows that come later begin another.

    The state of a pid are the rows that aren't closed yet and the last
    2 * HALO closed ones at most, whatever the length of the recording. Times
    are in the session's time zone. The session must use the RocksDB state
    store, which keyed state with timers needs.
    """
    spark = activity.sparkSession
    if (found := spark.conf.get("spark.sql.streaming.stateStore.providerClass")) != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}, not {found}")
    wait = spark.sql(f"SELECT unix_millis(timestamp'2000-01-03' + INTERVAL {quiet}) - unix_millis(timestamp'2000-01-03')").first()[0]
    rows = activity.where("pid is not null and ts is not null").select(F.col("pid").cast("string").alias("pid"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("activity").cast("double").alias("activity"))
    return rows.withWatermark("ts", late).groupBy("pid").transformWithStateInPandas(SleepScorer(wait), OUTPUT, "Append", "EventTime")


class SleepScorer(StatefulProcessor):
    """Keeps a pid's open rows, and the closed ones that labels still need."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.epochs = handle.getValueState("epochs", "packed binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat([*rows])
        yield from self._step(key[0], new["at"].to_numpy(np.int64), new["activity"].to_numpy(float), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._step(key[0], np.zeros(0, np.int64), np.zeros(0), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _step(self, pid: str, at: np.ndarray, values: np.ndarray, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = _unpacked(self.epochs.get()[0]) if self.epochs.exists() else {"at": at[:0], "values": values[:0], "open_at": at[:0], "open_values": values[:0], "out": np.array(0)}
        open_at, open_values = np.r_[held["open_at"], at], np.r_[held["open_values"], values]
        order = np.lexsort((open_values, open_at))
        open_at, open_values = open_at[order], open_values[order]
        n = int(np.searchsorted(open_at, watermark_ms * 1000))
        at, values, out = np.r_[held["at"], open_at[:n]], np.r_[held["values"], open_values[:n]], int(held["out"])
        over = len(open_at) == n and len(at) and at[-1] // 1000 + self.quiet_ms < watermark_ms
        ready = len(at) if over else max(out, len(at) - HALO)
        if ready > out:
            labels = scored(values)[out:ready]
            yield pd.DataFrame({"pid": pid, "ts": pd.to_datetime(at[out:ready], unit="us"), "activity": values[out:ready], "label": labels})
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if over:
            self.epochs.clear()
            return
        cut = max(0, ready - HALO)
        self.epochs.update((_packed(at=at[cut:], values=values[cut:], open_at=open_at[n:], open_values=open_values[n:], out=np.array(ready - cut)),))
        last = int(open_at[-1] if len(open_at) > n else at[-1]) // 1000
        # once the open rows are closed, or the recording is over
        self.handle.registerTimer(last + (1 if len(open_at) > n else self.quiet_ms + 1))


def scored(values: np.ndarray) -> np.ndarray:
    """Labels of consecutive epochs by the Cole-Kripke scorer and the rescoring rules."""
    if not len(values):
        return np.zeros(0, np.int32)
    a = np.maximum(np.nan_to_num(values), 0.0)
    padded, total = np.r_[np.zeros(4), a, np.zeros(3)], np.zeros(len(a))
    for k, w in enumerate(COLE_KRIPKE):
        total = total + padded[k : k + len(a)] * float(w)
    labels = np.where(total * 1e-5 >= 1.0, WAKE, SLEEP)
    starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    sizes = np.diff(np.r_[starts, len(labels)])
    around = np.zeros(len(sizes), np.int64)
    around[1:-1] = np.minimum(sizes[:-2], sizes[2:])
    rescued = np.zeros(len(sizes), bool)
    for most, least in WEBSTER:
        rescued |= (sizes <= most) & (around >= least)
    rescued &= labels[starts] == SLEEP
    return np.where(np.repeat(rescued, sizes), WAKE, labels).astype(np.int32)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(data))) as found:
        return {k: found[k] for k in found.files}
