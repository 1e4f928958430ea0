"""Queries through files of other formats: the given tables are written as a feed, a map, an archive or a sheet, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from ..sources import external, tables
from .registry import query, rounded


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 180 AS lon, s_suppkey % 90 AS lat FROM supplier)
SELECT 'n' || k AS id, 'Point' AS kind, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM s WHERE k % 3 = 0
UNION ALL SELECT 'w' || k, 'LineString', lat + i * 0.5::DOUBLE, lon + i * 0.25::DOUBLE FROM s, (SELECT unnest([0, 1, 2]) AS i) WHERE k % 3 = 1
UNION ALL SELECT 'r' || k, 'MultiLineString', lat + i * 0.5::DOUBLE, lon + i * 0.25::DOUBLE FROM s, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE k % 3 = 2""")
def map_sequence(spark, sf):
    """Suppliers as a sequence of map features - points, lines and groups of lines, with record separators - and their vertices."""
    k = F.col("s_suppkey")
    at = lambda i: F.concat(F.lit("["), (k % 180 + i * 0.25).cast("string"), F.lit(","), (k % 90 + i * 0.5).cast("string"), F.lit("]"))
    joined = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    kind = F.element_at(F.array(F.lit("Point"), F.lit("LineString"), F.lit("MultiLineString")), (k % 3 + 1).cast("int"))
    shape = F.when(k % 3 == 0, at(0)).when(k % 3 == 1, joined(at(0), at(1), at(2))).otherwise(joined(joined(at(0), at(1)), joined(at(2), at(3))))
    own = F.concat(F.element_at(F.array(F.lit("n"), F.lit("w"), F.lit("r")), (k % 3 + 1).cast("int")), k.cast("string"))
    line = F.concat(F.when(k % 2 == 0, "\x1e").otherwise(""), F.lit('{"type":"Feature","id":"'), own, F.lit('","geometry":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}}"))
    path = folder(spark, "map")
    spark.read.parquet(f"{sf}/supplier.parquet").select(line.alias("value")).write.text(path)
    return external.map_features(spark.read.text(path))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, CASE WHEN s_suppkey % 97 <> 0 THEN CAST(s_suppkey % 90 AS DOUBLE) + 0.5::DOUBLE END AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier WHERE s_suppkey % 97 <> 0""")
def feed_stops(spark, sf):
    """Suppliers written as the stops of a transit feed, with a further column, and read by the feed's schema."""
    k = F.col("s_suppkey")
    lat = F.when(k % 97 != 0, (k % 90 + 0.5).cast("string")).otherwise("unknown")
    path = folder(spark, "feed")
    spark.read.parquet(f"{sf}/supplier.parquet").select(k.cast("string").alias("stop_id"), F.lit("x, y").alias("stop_name"), lat.alias("stop_lat"), (k % 180).cast("string").alias("stop_lon")).write.option("header", True).csv(f"{path}/stops.txt")
    return external.coordinates(external.gtfs(spark, path, "stops"), "stop_lat", "stop_lon").select("stop_id", "lat", "lon")


#: Modes of the archive's label files by event, the last of them unknown to the engine, and what they are called there.
RAW = ("walk", "Car", "taxi", "bus", "boat")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, epoch_us(ts) // 1000000 AS t, event_id FROM events)
SELECT u AS "userId", t * 1000 AS started_at, (t + 600) * 1000 AS finished_at, ['Walk', 'Car', 'Car', 'Bus'][event_id % 5 + 1] AS mode FROM e WHERE event_id % 5 < 4""")
def archive_label_files(spark, sf):
    """Each user's events as the lines of a label file of the archive, under one heading."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    at = lambda s: F.date_format(F.timestamp_seconds(t + s), "yyyy/MM/dd HH:mm:ss")
    mode = F.element_at(F.array(*map(F.lit, RAW)), (F.col("event_id") % 5 + 1).cast("int"))
    user = F.col("user_id").cast("string")
    lines = ev.select(F.concat_ws("\t", at(0), at(600), mode).alias("value"), user.alias("user"))
    lines = lines.unionByName(ev.select(user.alias("user")).distinct().withColumn("value", F.lit("Start Time\tEnd Time\tTransportation Mode")))
    path = folder(spark, "archive")
    lines.repartition("user").write.partitionBy("user").text(path)
    # the archive has one file for each user, below a folder of the user's name
    found = external.text_with_path(spark, path).withColumn("path", F.concat(F.regexp_extract("path", r"user=([^/]+)/", 1), F.lit("/labels.txt")))
    return external.archive_labels(found)


@query("""SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice), 2) AS price, count(*) AS unknown FROM lineitem GROUP BY ALL""")
def wide_sink(spark, sf):
    """Items written under a schema of their own - other types, a column that is not there - and read back."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    schema = T.StructType([T.StructField("l_returnflag", T.StringType()), T.StructField("l_extendedprice", T.DoubleType()), T.StructField("l_quantity", T.FloatType()), T.StructField("not_there", T.LongType())])
    path = folder(spark, "wide")
    tables.write(li, path, schema)
    out = spark.read.parquet(path)
    if out.schema != schema:
        raise ValueError(f"written as {out.schema.simpleString()}")
    return rounded(out.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"), F.count_if(F.col("not_there").isNull()).alias("unknown")), 2)


@query("""SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY ALL""")
def sheet_sink(spark, sf):
    """A table of figures written as a sheet with a heading, and read back."""
    path = folder(spark, "sheet")
    figures: DataFrame = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").cast("double").alias("mean"))
    tables.write_csv(figures, path)
    return rounded(spark.read.option("header", True).schema("segment string, n bigint, mean double").csv(path))
