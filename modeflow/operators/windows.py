"""Windows over sessions and labelled segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def anchors(points: DataFrame, keys: list[str], time: str = "timestamp") -> DataFrame:
    """keys, anchor and last: first and last time of each group."""
    return points.groupBy(*keys).agg(F.min(time).alias("anchor"), F.max(time).alias("last"))


def sliding(anchored: DataFrame, win_ms: int = 120_000, step_ms: int = 60_000) -> DataFrame:
    """A row ts_start, ts_end for each window from the anchor on, while its end is at most a step after the last point."""
    n = F.floor((F.col("last") + step_ms - win_ms - F.col("anchor")) / step_ms)
    starts = F.when(n >= 0, F.sequence(F.lit(0).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))
    rows = anchored.withColumn("__k", F.explode(starts)).withColumn("ts_start", F.col("anchor") + F.col("__k") * step_ms)
    return rows.withColumn("ts_end", F.col("ts_start") + win_ms).drop("__k", "anchor", "last")


def assign(points: DataFrame, anchored: DataFrame, keys: list[str], win_ms: int = 120_000, step_ms: int = 60_000, time: str = "timestamp") -> DataFrame:
    """points with ts_start and ts_end of every sliding window [ts_start, ts_end], closed at both ends, that holds them.

    The windows of a point follow from its distance to the anchor, so this is one join by key and no range join.
    """
    joined = points.join(anchored, keys)
    d = F.col(time) - F.col("anchor")
    n = F.floor((F.col("last") + step_ms - win_ms - F.col("anchor")) / step_ms)
    low, high = F.greatest(F.lit(0), F.ceil((d - win_ms) / step_ms)), F.least(n, F.floor(d / step_ms))
    ks = F.when((low <= high) & (d >= 0), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    rows = joined.withColumn("__k", F.explode(ks)).withColumn("ts_start", F.col("anchor") + F.col("__k") * step_ms)
    return rows.withColumn("ts_end", F.col("ts_start") + win_ms).drop("__k", "anchor", "last")


def tumbling(points: DataFrame, segments: DataFrame, keys: list[str], win_ms: int = 120_000, least: int = 3, time: str = "timestamp") -> DataFrame:
    """Half-open windows from the start of each segment on, the last one partial, of at least `least` points.

    segments: keys, t0_ms, t1_ms and further columns.
    """
    from .sessions import within

    k = F.floor((F.col(time) - F.col("t0_ms")) / win_ms)
    rows = within(points, segments, keys, time).withColumn("ts_start", F.col("t0_ms") + k * win_ms)
    w = W.partitionBy(*keys, "t0_ms", "ts_start")
    return rows.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= least).drop("__n")


def rolling_stop_rate(windows: DataFrame, n: int = 5) -> DataFrame:
    """B_stop_rate_<n>win: mean stop share of the last n windows of the session, missing ones left out."""
    w = W.partitionBy("userId", "session_id").orderBy("ts_start").rowsBetween(-(n - 1), 0)
    return windows.withColumn(f"B_stop_rate_{n}win", F.avg("B_stop_frac").over(w))
