"""The trajectory view of the events table: position fixes, inertial samples and reference intervals of each user.

Integer arithmetic on the event id alone places the events, and one second of event time becomes a millisecond, so both this
plan and plain SQL derive the same rows from the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP_S, MIN_S, WIN_MS, STEP_MS = 60.0, 60.0, 120_000, 60_000
MODES = ("Still", "Walk", "Car", "Bus", "Train")


def _mod(a: int, m: int) -> Column:
    return (F.col("event_id") * a) % m


def _d(x: Column) -> Column:
    return x.cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """userId, event_id, timestamp, is_fix, latitude, longitude, speed, accuracy, acc_*, gyr_*, value, event_type."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    band = F.element_at(F.array(*[F.lit(x) for x in (0.1, 1.2, 3.0, 8.0, 20.0)]), (F.expr("(timestamp div 300000 + user_id) % 5") + 1).cast("int"))
    fix = F.col("event_id") % 3 != 0
    unit = F.when(F.col("user_id") % 4 == 0, F.lit(9.80665)).otherwise(F.lit(1.0)) * F.when(F.col("event_id") % 97 == 0, F.lit(5.0)).otherwise(F.lit(1.0))
    return (
        ev.withColumn("timestamp", t)
        .withColumn("latitude", F.lit(46.07) + _d(_mod(7919, 2003)) / F.lit(2003.0) * F.lit(0.01))
        .withColumn("longitude", F.lit(11.12) + _d(_mod(104729, 1999)) / F.lit(1999.0) * F.lit(0.01))
        .withColumn("speed", band * (F.lit(1.0) + _d(_mod(31, 11) - 5) / F.lit(25.0)) * F.when(F.col("event_id") % 7 == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        .withColumn("accuracy", F.when(F.col("event_id") % 13 == 0, None).otherwise(_d(_mod(17, 80))))
        .withColumn("is_fix", fix)
        .withColumn("acc_x", _d(_mod(37, 401) - 200) / F.lit(2000.0) * unit)
        .withColumn("acc_y", _d(_mod(53, 301) - 150) / F.lit(1500.0) * unit)
        .withColumn("acc_z", (F.lit(1.0) + _d(_mod(71, 201) - 100) / F.lit(1000.0)) * unit)
        .withColumn("gyr_x", _d(_mod(29, 101) - 50) / F.lit(100.0))
        .withColumn("gyr_y", _d(_mod(41, 103) - 51) / F.lit(100.0))
        .withColumn("gyr_z", _d(_mod(59, 107) - 53) / F.lit(100.0))
        .select(F.col("user_id").cast("string").alias("userId"), "event_id", "timestamp", "is_fix", "latitude", "longitude", "speed", "accuracy", "acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z", "value", "event_type")
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("is_fix").select("userId", "event_id", "timestamp", "latitude", "longitude", "speed", "accuracy")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("not is_fix").select("userId", "event_id", "timestamp", "acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference intervals: each signup opens 300 s in a mode by its id; they overlap."""
    modes = F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = points(spark, sf_dir).where("event_type = 'signup'")
    return rows.select("userId", F.col("event_id").alias("seq"), F.col("timestamp").alias("started_at"), (F.col("timestamp") + 300_000).alias("finished_at"), modes.alias("mode"))


def layer(spark: SparkSession, sf_dir: str, name: str = "supplier") -> DataFrame:
    """A layer of places: one for each key of a table, placed like the events."""
    key = {"supplier": "s_suppkey", "customer": "c_custkey"}[name]
    k = F.col(key)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(
        k.alias("place_id"), (F.lit(46.07) + _d(k * 7919 % 2003) / F.lit(2003.0) * F.lit(0.01)).alias("lat"), (F.lit(11.12) + _d(k * 104729 % 1999) / F.lit(1999.0) * F.lit(0.01)).alias("lon")
    )


#: The same view as DuckDB common table expressions, for oracles.
SQL = """
WITH points AS (
  SELECT CAST(user_id AS VARCHAR) AS "userId", event_id, epoch_us(ts) // 1000000 AS "timestamp", event_id % 3 <> 0 AS is_fix,
    46.07::DOUBLE + CAST((event_id * 7919) % 2003 AS DOUBLE) / 2003.0::DOUBLE * 0.01::DOUBLE AS latitude,
    11.12::DOUBLE + CAST((event_id * 104729) % 1999 AS DOUBLE) / 1999.0::DOUBLE * 0.01::DOUBLE AS longitude,
    [0.1::DOUBLE, 1.2::DOUBLE, 3.0::DOUBLE, 8.0::DOUBLE, 20.0::DOUBLE][(epoch_us(ts) // 1000000 // 300000 + user_id) % 5 + 1]
      * (1.0::DOUBLE + CAST((event_id * 31) % 11 - 5 AS DOUBLE) / 25.0::DOUBLE) * (CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS speed,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 17) % 80 AS DOUBLE) END AS accuracy,
    CAST((event_id * 37) % 401 - 200 AS DOUBLE) / 2000.0::DOUBLE * unit AS acc_x, CAST((event_id * 53) % 301 - 150 AS DOUBLE) / 1500.0::DOUBLE * unit AS acc_y,
    (1.0::DOUBLE + CAST((event_id * 71) % 201 - 100 AS DOUBLE) / 1000.0::DOUBLE) * unit AS acc_z,
    CAST((event_id * 29) % 101 - 50 AS DOUBLE) / 100.0::DOUBLE AS gyr_x, CAST((event_id * 41) % 103 - 51 AS DOUBLE) / 100.0::DOUBLE AS gyr_y,
    CAST((event_id * 59) % 107 - 53 AS DOUBLE) / 100.0::DOUBLE AS gyr_z, value, event_type
  FROM (SELECT *, (CASE WHEN user_id % 4 = 0 THEN 9.80665::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN event_id % 97 = 0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END) AS unit FROM events)
),
fixes AS (SELECT * FROM points WHERE is_fix),
samples AS (SELECT * FROM points WHERE NOT is_fix),
intervals AS (
  SELECT "userId", event_id AS seq, "timestamp" AS started_at, "timestamp" + 300000 AS finished_at, ['Still', 'Walk', 'Car', 'Bus', 'Train'][event_id % 5 + 1] AS mode
  FROM points WHERE event_type = 'signup'
),
places AS (
  SELECT s_suppkey AS place_id, 46.07::DOUBLE + CAST((s_suppkey * 7919) % 2003 AS DOUBLE) / 2003.0::DOUBLE * 0.01::DOUBLE AS lat,
    11.12::DOUBLE + CAST((s_suppkey * 104729) % 1999 AS DOUBLE) / 1999.0::DOUBLE * 0.01::DOUBLE AS lon FROM supplier
)"""

#: Sessions of the view: islands of the union of both sensors' distinct times, cut where a gap is above 60 s, of 60 s at least.
SESSIONS_SQL = (
    SQL
    + """,
times AS (SELECT DISTINCT "userId", "timestamp" FROM points),
cuts AS (SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER (PARTITION BY "userId" ORDER BY "timestamp") > 60000 THEN 1 ELSE 0 END AS cut FROM times),
islands AS (SELECT *, sum(cut) OVER (PARTITION BY "userId" ORDER BY "timestamp") AS island FROM cuts),
spans AS (SELECT "userId", island, min("timestamp") AS t0_ms, max("timestamp") AS t1_ms FROM islands GROUP BY ALL HAVING max("timestamp") - min("timestamp") >= 60000),
gaps AS (
  SELECT s."userId", s.t0_ms, p."timestamp" - lag(p."timestamp") OVER (PARTITION BY s."userId", s.t0_ms ORDER BY p."timestamp", p.event_id) AS isi
  FROM spans s JOIN samples p ON p."userId" = s."userId" AND p."timestamp" BETWEEN s.t0_ms AND s.t1_ms
),
rates AS (SELECT "userId", t0_ms, quantile_cont(isi, 0.5) AS m FROM gaps WHERE isi < 1000 GROUP BY ALL),
tallied AS (
  SELECT s."userId", s.t0_ms, s.t1_ms, count(p.event_id) FILTER (WHERE p.is_fix) AS n_gps, count(p.event_id) FILTER (WHERE NOT p.is_fix) AS n_imu
  FROM spans s JOIN points p ON p."userId" = s."userId" AND p."timestamp" BETWEEN s.t0_ms AND s.t1_ms GROUP BY ALL
),
sessions AS (
  SELECT substr(t."userId", 1, 8) || '_' || CAST(t.t0_ms AS VARCHAR) AS session_id, t."userId", t.t0_ms, t.t1_ms, (t.t1_ms - t.t0_ms) / 1000.0::DOUBLE AS dur_s, n_gps, n_imu,
    CASE WHEN r.m > 0 THEN greatest(10.0::DOUBLE, least(250.0::DOUBLE, 1000.0::DOUBLE / r.m)) ELSE 50.0::DOUBLE END AS imu_hz,
    CASE WHEN n_gps > 0 AND n_imu > 0 THEN 'tracking' WHEN n_gps = 0 THEN 'imu_only' ELSE 'gps_only' END AS type
  FROM tallied t LEFT JOIN rates r USING ("userId", t0_ms)
)"""
)
