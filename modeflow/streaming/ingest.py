"""Incremental ingestion and streaming sessions with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.smoothing import coherent, min_windows
from ..sources.tables import appended

#: How late rows may come: a day of delay and as much again for safety.
LATENESS = "2 days"


def read_new(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the files that appear under a path; the checkpoint of the query remembers which were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def cursors(df: DataFrame, key: str = "userId", time: str = "timestamp") -> DataFrame:
    """The last time seen of each key: high-water marks for sources that must be asked again."""
    return df.groupBy(key).agg(F.max(time).alias("last_ms"))


def since(marks: DataFrame, overlap_ms: int) -> int | None:
    """Where to read on from for all keys: the least mark less the overlap."""
    least = marks.agg(F.min("last_ms")).first()[0]
    return None if least is None else least - overlap_ms


def upsert(stream: DataFrame, target: str, keys: list[str], checkpoint: str, kept_versions: int = 2):
    """Write each micro-batch into a Parquet table of versions, the last row of each key winning, in every batch.

    Version b is made of the last complete version below b and of batch b alone. A replayed batch therefore reads the same
    version as before and never the one that it writes anew; a lost driver or executor leaves the version before as it was.
    Versions older than the last `kept_versions` go. Each batch rewrites the table: a large one is best upserted by month.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = current(spark, target, below=batch_id)
        whole = appended(batch.limit(0) if before is None else before, batch, keys)
        whole.write.mode("overwrite").parquet(f"{target}/v{batch_id:09d}")
        for name in complete(spark, target)[:-kept_versions]:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete(spark: SparkSession, target: str) -> list[str]:
    """Names of the complete versions of an upserted table, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def current(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The latest complete version of an upserted table, or the latest below a batch's number; None where there is none."""
    done = [v for v in complete(spark, target) if below is None or v < f"v{below:09d}"]
    return spark.read.parquet(f"{target}/{done[-1]}") if done else None


def sessions(points: DataFrame, gap: str = "300 seconds", lateness: str = LATENESS) -> DataFrame:
    """userId, t0, t1, n_gps, n_imu of sessions, each emitted once no late row can extend it.

    points: userId, time (timestamp), is_fix. The window's own end is a gap after the last point, so the end is max(time).
    """
    late = points.withWatermark("time", lateness)
    s = late.groupBy("userId", F.session_window("time", gap)).agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.count_if("is_fix").alias("n_gps"), F.count_if(~F.col("is_fix")).alias("n_imu"))
    return s.select("userId", "t0", "t1", "n_gps", "n_imu")


def windowed(points: DataFrame, lateness: str = LATENESS, size: str = "120 seconds", step: str = "60 seconds") -> DataFrame:
    """Counts and mean speeds of sliding windows (on the clock, half open) as the watermark passes them."""
    late = points.withWatermark("time", lateness)
    return late.groupBy("userId", F.window("time", size, step)).agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("speed")).select("userId", F.col("window.start").alias("ts_start"), F.col("window.end").alias("ts_end"), "n", "speed")


def swept(times: np.ndarray, speeds: np.ndarray, size: int, step: int) -> list[dict]:
    """k, n and mean speed of the windows [k * step, k * step + size] from a session's first point on, by two searches each."""
    order = np.argsort(times, kind="stable")
    t, v = times[order] - times[order[0]], speeds[order]
    k = np.arange(max(0, (int(t[-1]) + step - size) // step + 1))
    low, high = np.searchsorted(t, k * step, "left"), np.searchsorted(t, k * step + size, "right")
    known, total = (np.concatenate(([0], np.cumsum(x))) for x in (~np.isnan(v), np.nan_to_num(v)))
    n = known[high] - known[low]
    means = (total[high] - total[low]) / np.maximum(n, 1)
    return [{"k": int(i), "n": int(h - l), "speed": float(m) if some else None} for i, l, h, m, some in zip(k, low, high, means, n > 0, strict=True)]


def anchored(points: DataFrame, gap: str = "300 seconds", lateness: str = LATENESS, size_s: int = 120, step_s: int = 60) -> DataFrame:
    """userId, t0, ts_start, ts_end, n and mean speed of the windows of each session, anchored at its first point and closed at
    both ends as in batch; emitted once no late row can extend the session. points: userId, time, speed.

    Where windows lie is known only when the first point is, so the state holds a session's points until it ends.
    """

    @F.pandas_udf("array<struct<k:bigint,n:bigint,speed:double>>")
    def windows(times: pd.Series, speeds: pd.Series) -> pd.Series:
        return pd.Series([swept(np.asarray(t, dtype=np.int64), np.asarray(v, dtype=float), size_s * 1_000_000, step_s * 1_000_000) for t, v in zip(times, speeds, strict=True)])

    late = points.withWatermark("time", lateness)
    held = F.collect_list(F.struct(F.unix_micros("time").alias("t"), F.col("speed").cast("double").alias("v")))
    s = late.groupBy("userId", F.session_window("time", gap)).agg(F.min("time").alias("t0"), held.alias("__p"))
    rows = s.select("userId", "t0", F.explode(windows(F.col("__p.t"), F.col("__p.v"))).alias("w"))
    start = F.unix_micros("t0") + F.col("w.k") * (step_s * 1_000_000)
    return rows.select("userId", "t0", F.timestamp_micros(start).alias("ts_start"), F.timestamp_micros(start + size_s * 1_000_000).alias("ts_end"), "w.n", "w.speed")


def deduplicated(stream: DataFrame, keys: list[str], time: str = "time", lateness: str = LATENESS) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def healed(windows: DataFrame, idle_ms: int = 600_000, least: dict[str, int] | None = None) -> DataFrame:
    """userId, session_id, ts_start, mode, coherent of whole sessions, emitted when a session has been idle in event time.

    windows: userId, session_id, ts_start (timestamp, watermarked here), mode. State is the list of a session's window modes.
    """
    limits = least or min_windows()

    def on(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            times, modes = state.get
            state.remove()
            order = sorted(range(len(times)), key=lambda i: times[i])
            fixed = coherent([modes[i] for i in order], limits)
            yield pd.DataFrame({"userId": key[0], "session_id": key[1], "ts_start": pd.to_datetime([times[i] for i in order], unit="us"), "mode": [modes[i] for i in order], "coherent": fixed})
            return
        times, modes = (list(x) for x in state.get) if state.exists else ([], [])
        for pdf in batches:
            times += [int(t.value // 1000) for t in pdf["ts_start"]]
            modes += pdf["mode"].tolist()
        state.update((times, modes))
        state.setTimeoutTimestamp(max(max(times) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    late = windows.withWatermark("ts_start", LATENESS)
    return late.groupBy("userId", "session_id").applyInPandasWithState(on, "userId string, session_id string, ts_start timestamp, mode string, coherent string", "times array<bigint>, modes array<string>", "append", "EventTimeTimeout")
