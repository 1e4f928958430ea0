"""Sessions: islands of the union of both sensors' timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Time is first cut into buckets, so that a user with very many points is spread over tasks.
BUCKET_MS = 6 * 3_600_000


def islands(points: DataFrame, gap_ms: int, keys: list[str], time: str = "timestamp", bucket_ms: int = BUCKET_MS, sums: dict | None = None) -> DataFrame:
    """keys, t0_ms, t1_ms and sums of the maximal runs of points whose gaps are at most gap_ms.

    Runs are found inside (keys, bucket) first; the few runs of all buckets of a key are then merged where the gap between
    two of them is within the limit. Both steps give what one pass over the whole timeline would.
    """
    sums = sums or {}
    b = points.withColumn("__bucket", F.floor(F.col(time) / bucket_ms))
    times = b.groupBy(*keys, "__bucket", time).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(x).alias(n) for n, x in sums.items()])
    w = W.partitionBy(*keys, "__bucket").orderBy(time)
    cut = F.coalesce((F.col(time) - F.lag(time).over(w) > gap_ms).cast("int"), F.lit(0))
    runs = times.withColumn("__cut", cut).withColumn("__run", F.sum("__cut").over(w)).groupBy(*keys, "__bucket", "__run")
    runs = runs.agg(F.min(time).alias("t0_ms"), F.max(time).alias("t1_ms"), *[F.sum(n).alias(n) for n in sums])
    u = W.partitionBy(*keys).orderBy("t0_ms")
    cut = F.coalesce((F.col("t0_ms") - F.lag("t1_ms").over(u) > gap_ms).cast("int"), F.lit(0))
    merged = runs.withColumn("__cut", cut).withColumn("__island", F.sum("__cut").over(u)).groupBy(*keys, "__island")
    return merged.agg(F.min("t0_ms").alias("t0_ms"), F.max("t1_ms").alias("t1_ms"), *[F.sum(n).alias(n) for n in sums]).drop("__island")


def within(points: DataFrame, spans: DataFrame, keys: list[str], time: str = "timestamp", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """points joined to all spans [t0_ms, t1_ms] (closed) of their keys that hold them: an equi-join on time buckets."""
    p = points.withColumn("__bucket", F.floor(F.col(time) / bucket_ms))
    s = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("t0_ms") / bucket_ms), F.floor(F.col("t1_ms") / bucket_ms))))
    return p.join(s, [*keys, "__bucket"]).where(F.col(time).between(F.col("t0_ms"), F.col("t1_ms"))).drop("__bucket")


def rates(samples: DataFrame, sessions: DataFrame, keys: list[str], default: float = 50.0) -> DataFrame:
    """keys, t0_ms and imu_hz: 1000 / the median gap of consecutive samples below a second, held to 10 to 250; else default."""
    inside = within(samples, sessions, keys)
    w = W.partitionBy(*keys, "t0_ms").orderBy("timestamp", "event_id")
    gap = inside.withColumn("__isi", F.col("timestamp") - F.lag("timestamp").over(w)).where("__isi < 1000")
    median = gap.groupBy(*keys, "t0_ms").agg(F.percentile("__isi", F.lit(0.5)).alias("__m"))
    hz = F.when(F.col("__m") > 0, F.greatest(F.lit(10.0), F.least(F.lit(250.0), F.lit(1000.0) / F.col("__m")))).otherwise(default)
    return median.select(*keys, "t0_ms", hz.alias("imu_hz"))


def build(fixes: DataFrame, samples: DataFrame, gap_s: float = 300.0, min_s: float = 60.0, user: str = "userId") -> DataFrame:
    """session_id, user, t0_ms, t1_ms, dur_s, n_gps, n_imu, imu_hz, type; a gap of exactly gap_s does not cut."""
    both = fixes.select(user, "timestamp", F.lit(1).alias("g"), F.lit(0).alias("i")).union(samples.select(user, "timestamp", F.lit(0).alias("g"), F.lit(1).alias("i")))
    spans = islands(both, int(gap_s * 1000), [user], sums={"n_gps": "g", "n_imu": "i"})
    spans = spans.where(F.col("t1_ms") - F.col("t0_ms") >= int(min_s * 1000))
    with_rate = spans.join(rates(samples, spans, [user]), [user, "t0_ms"], "left")
    kind = F.when((F.col("n_gps") > 0) & (F.col("n_imu") > 0), "tracking").when(F.col("n_gps") == 0, "imu_only").otherwise("gps_only")
    return with_rate.select(
        F.concat(F.substring(user, 1, 8), F.lit("_"), F.col("t0_ms").cast("string")).alias("session_id"), user, "t0_ms", "t1_ms",
        ((F.col("t1_ms") - F.col("t0_ms")) / F.lit(1000.0)).alias("dur_s"), "n_gps", "n_imu", F.coalesce("imu_hz", F.lit(50.0)).alias("imu_hz"), kind.alias("type"),
    )


def processable(sessions: DataFrame) -> DataFrame:
    """Sessions with inertial samples."""
    return sessions.where(F.col("type") != "gps_only")
