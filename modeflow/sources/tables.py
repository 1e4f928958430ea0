"""Scans and sinks of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of a schema: missing ones null, further ones left out, all cast."""
    has = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def gps(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Fixes in a closed time range, which reaches the Parquet scan; sorted by user and time."""
    df = conformed(spark.read.parquet(path), schemas.GPS)
    for bound, test in ((since, lambda b: F.col("timestamp") >= b), (until, lambda b: F.col("timestamp") <= b)):
        df = df if bound is None else df.where(test(bound))
    return df.orderBy("userId", "timestamp")


def imu(spark: SparkSession, path: str, user: str | None = None, start: int | None = None, end: int | None = None, margin_ms: int = 3_600_000) -> DataFrame:
    """Samples from a table partitioned by user, or from one file for each user; a user without samples gives no rows."""
    df = spark.read.parquet(path)
    if "userId" not in df.columns:
        df = df.withColumn("userId", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""))
    if user is not None:
        df = df.where(F.col("userId") == user)
    if start is not None:
        df = df.where(F.col("timestamp") >= start - margin_ms)
    if end is not None:
        df = df.where(F.col("timestamp") <= end + margin_ms)
    return df


def users(df: DataFrame) -> DataFrame:
    return df.select("userId").distinct()


def labels(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Reference intervals that meet a closed time range."""
    return meeting(conformed(spark.read.parquet(path), schemas.LABELS), since, until)


def meeting(df: DataFrame, since: int | None, until: int | None) -> DataFrame:
    if since is not None:
        df = df.where(F.col("finished_at") >= since)
    return df if until is None else df.where(F.col("started_at") <= until)


def month(ms: Column) -> Column:
    """The UTC month of a time in ms, as yyyy-MM."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def write_by_month(df: DataFrame, path: str, time: str = "timestamp", mode: str = "append") -> None:
    df.withColumn("year_month", month(F.col(time))).repartition("year_month", F.floor(F.col(time) / 86_400_000)).write.mode(mode).option("parquet.block.row.count.limit", ROW_GROUP).partitionBy("year_month").parquet(path)


#: Rows of a row group: a scan for a range of times skips the others by their statistics.
ROW_GROUP = 50_000


def write(df: DataFrame, path: str, schema: T.StructType | None = None, mode: str = "overwrite", row_group: int = ROW_GROUP) -> None:
    (conformed(df, schema) if schema else df).write.mode(mode).option("compression", "snappy").option("parquet.block.row.count.limit", row_group).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by `order`: an aggregate, which combines before it shuffles, rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in df.columns])


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two batches without repeats of a key: rows of the new batch win over old ones, later over earlier."""
    n = F.monotonically_increasing_id()
    both = old.withColumn("__batch", F.lit(0)).withColumn("__seq", n).unionByName(new.withColumn("__batch", F.lit(1)).withColumn("__seq", n), allowMissingColumns=True)
    return keep_last(both, keys, ["__batch", "__seq"]).drop("__batch", "__seq")


def largest(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row with the largest value of each column. Whole numbers, floats and dates come from the files' footers alone: only
    the scan of Spark's second data source version takes aggregates, so the table is read by it, in a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own.read.parquet(path).agg(*[F.max(c).alias(c) for c in columns])


def last_time(spark: SparkSession, path: str, time: str = "timestamp") -> int | None:
    """The largest time of a table, without reading its rows where the footers hold it."""
    return largest(spark, path, time).first()[0]
