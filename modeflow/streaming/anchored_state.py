"""Session-anchored windows of a stream by state that holds open windows only, with Spark's transformWithState.

A window [t0 + k step, t0 + k step + size] of a session goes out as soon as the watermark has passed its end and its session is
known to reach far enough; its points are dropped when no later window needs them. So the state of a session of any length is
the points of the last window and of the time that rows may be late.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ingest import LATENESS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Open:
    """A session whose first point is final: that point, the next window's number, and the last final point (microseconds)."""

    anchor: int
    next: int
    last: int


def advanced(t: np.ndarray, v: np.ndarray, held: Open | None, mark: int, gap: int, size: int, step: int) -> tuple[list[tuple], np.ndarray, Open | None, int | None]:
    """What the watermark `mark` settles: windows (t0, start, end, n, mean), which points stay, the open session, and the time
    at which to look again. t is sorted; no point at or before the mark can come any more."""
    out: list[tuple] = []
    stay = np.ones(len(t), bool)
    known = ~np.isnan(v)

    def window(k: int, last: int) -> None:
        start = held.anchor + k * step
        a, b = np.searchsorted(t, start, "left"), np.searchsorted(t, min(start + size, last), "right")
        ok = known[a:b]
        n = int(ok.sum())
        out.append((held.anchor, start, start + size, n, float(v[a:b][ok].sum() / n) if n else None))

    while True:
        if held is None:
            left = np.flatnonzero(stay)
            if not len(left):
                return out, stay, None, None
            first = int(t[left[0]])
            if first > mark:
                return out, stay, None, first
            held = Open(first, 0, first)
        reach = held.last
        for x in t[np.searchsorted(t, held.last, "right") :].tolist():
            if x - reach > gap:
                break
            reach = x
            if x <= mark:
                held.last = x
        if mark >= held.last + gap:  # nothing can follow
            while held.anchor + held.next * step + size <= held.last + step:
                window(held.next, held.last)
                held.next += 1
            stay &= t > held.last
            held = None
            continue
        while (end := held.anchor + held.next * step + size) <= mark and end <= reach + step:
            window(held.next, end)
            held.next += 1
        stay &= (t >= held.anchor + held.next * step) | (t > held.last)
        end = held.anchor + held.next * step + size
        return out, stay, held, end if end <= reach + step else held.last + gap


class Windows(StatefulProcessor):
    """State of a user: points in buckets of time (a map), and the open session (a value)."""

    def __init__(self, gap_us: int, size_us: int, step_us: int):
        self.gap, self.size, self.step = gap_us, size_us, step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", T.StructType([T.StructField("bucket", T.LongType())]), T.StructType([T.StructField("t", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.DoubleType()))]))
        self.open = handle.getValueState("open", T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "next", "last")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat(rows)
        new = new[new["t"] > mark] if mark > 0 else new
        for bucket, part in new.groupby(new["t"] // self.step):
            at = (int(bucket),)
            t, v = map(list, self.points.getValue(at)) if self.points.containsKey(at) else ([], [])
            self.points.updateValue(at, (t + part["t"].astype("int64").tolist(), v + [None if pd.isna(x) else float(x) for x in part["v"]]))
        return self.settle(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.settle(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def settle(self, key, mark: int) -> Iterator[pd.DataFrame]:
        buckets = {k[0]: row for k, row in self.points.iterator()}
        t = np.array([x for b in sorted(buckets) for x in buckets[b][0]], np.int64)
        v = np.array([np.nan if x is None else x for b in sorted(buckets) for x in buckets[b][1]], float)
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        held = Open(*(int(x) for x in self.open.get())) if self.open.exists() else None
        out, stay, held, again = advanced(t, v, held, mark, self.gap, self.size, self.step)
        if not stay.all():
            keep: dict[int, tuple[list, list]] = {}
            for x, y in zip(t[stay].tolist(), v[stay].tolist(), strict=True):
                a, b = keep.setdefault(x // self.step, ([], []))
                a.append(x)
                b.append(None if y != y else y)
            for b, row in buckets.items():
                if b not in keep:
                    self.points.removeKey((b,))
                elif len(keep[b][0]) != len(row[0]):
                    self.points.updateValue((b,), keep[b])
        if held is None:
            self.open.clear()
        else:
            self.open.update((held.anchor, held.next, held.last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if again is not None:
            self.handle.registerTimer(max(-(-again // 1000), mark // 1000 + 1))
        if out:
            yield pd.DataFrame([(key[0], *w) for w in out], columns=["userId", "t0", "ts_start", "ts_end", "n", "speed"]).astype({"n": "int64", "speed": "float64"})

    def close(self) -> None:
        pass


def anchored_windows(points: DataFrame, gap_s: int = 300, lateness: str = LATENESS, size_s: int = 120, step_s: int = 60) -> DataFrame:
    """userId, t0, ts_start, ts_end, n and mean speed of the windows of each session, anchored at its first point and closed at
    both ends, as in batch; each goes out once no late row can change it. points: userId, time, speed.

    Rows later than `lateness` do not count. Points of equal times all count; an unknown speed (null) has its time but no
    share in n and the mean. Sets the session's state store, as only one kind keeps such state.
    """
    spark: SparkSession = points.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    late = points.withWatermark("time", lateness).select("userId", "time", F.unix_micros("time").alias("t"), F.col("speed").cast("double").alias("v"))
    us = 1_000_000
    found = late.groupBy("userId").transformWithStateInPandas(Windows(gap_s * us, size_s * us, step_s * us), "userId string, t0 bigint, ts_start bigint, ts_end bigint, n bigint, speed double", "Append", "EventTime")
    return found.select("userId", *[F.timestamp_micros(c).alias(c) for c in ("t0", "ts_start", "ts_end")], "n", F.when(~F.isnan("speed"), F.col("speed")).alias("speed"))
