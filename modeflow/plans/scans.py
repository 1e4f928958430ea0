"""Scans, filters, sinks, and joins over the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.order import cumulated
from ..operators import joins, quality
from ..session import shared_dir
from ..sources import documents, external, tables
from ..streaming import merging
from . import trajectory as T
from .registry import query, rounded

SQL = T.SQL


@query(SQL + """ SELECT "userId", event_id, "timestamp", latitude, longitude, speed FROM fixes WHERE "timestamp" BETWEEN 1705000000 AND 1706000000""")
def scan_range_filter(spark, sf):
    rows = quality.epoch_filter(T.fixes(spark, sf), 1_705_000_000, 1_706_000_000)
    return rows.select("userId", "event_id", "timestamp", "latitude", "longitude", "speed")


@query(SQL + """ SELECT "timestamp", latitude AS lat, longitude AS lon, accuracy, NULL::DOUBLE AS acc_x, NULL::DOUBLE AS mag_x FROM fixes""")
def schema_adapt(spark, sf):
    other = T.fixes(spark, sf).select(F.col("timestamp").alias("ts"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "accuracy")
    return quality.adapt(other, "shl").select("timestamp", "lat", "lon", "accuracy", "acc_x", "mag_x")


@query("""
WITH b AS (SELECT user_id, event_type, ts, value, 0 AS batch, event_id FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT user_id, event_type, ts, value * 2, 1, event_id FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_max(value, (batch, event_id)) AS value, count(*) AS n FROM b GROUP BY ALL""")
def dedup_keep_last(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("day", F.to_date("ts"))
    old, new = ev.where("event_id % 5 <> 0").withColumn("batch", F.lit(0)), ev.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2).withColumn("batch", F.lit(1))
    both, keys = old.unionByName(new), ["user_id", "event_type", "day"]
    last = tables.keep_last(both.select(*keys, "value", "batch", "event_id"), keys, ["batch", "event_id"])
    return last.join(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys).select(*keys, "value", "n")


@query("SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS n, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY ALL")
def month_partition_counts(spark, sf):
    """Events written by month and read again."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"))
    path = f"{shared_dir(spark).rstrip('/')}/months-{uuid.uuid4().hex}"
    tables.write_by_month(rows, path, "ms")
    months = spark.read.schema("event_id bigint, ms bigint, year_month string").parquet(path)
    return months.groupBy("year_month").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("last_ms"))


@query("SELECT max(event_id) AS last_id, max(ts) AS last_ts, count(DISTINCT user_id) AS users FROM events")
def scan_high_water(spark, sf):
    """The marks by the library's own readers: maxima from the footers, users by enumeration."""
    path = f"{sf}/events.parquet"
    last_id, last_ts = (tables.last_time(spark, path, c) for c in ("event_id", "ts"))
    users = tables.users(spark.read.parquet(path).withColumnRenamed("user_id", "userId"))
    return users.agg(F.lit(last_id).cast("bigint").alias("last_id"), F.lit(last_ts).cast("timestamp_ntz").alias("last_ts"), F.count(F.lit(1)).alias("users"))


@query("""
WITH d AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CAST(props::JSON->>'k' AS INT) AS k, event_type FROM events)
SELECT CAST(user_id AS VARCHAR) AS "userId", ms AS started_at, ms + 60000 AS finished_at,
  CASE WHEN event_type IN ('click', 'view') THEN ['Walk', 'Car', 'Bus'][k % 3 + 1] ELSE 'Still' END AS mode,
  CASE WHEN event_type IN ('click', 'view') THEN ['walk', 'car', 'bus', 'boat'][k % 4 + 1] ELSE 'stay_' || event_type END AS mode_key
FROM (SELECT * REPLACE (k AS k) FROM d) WHERE event_type NOT IN ('click', 'view') AND event_type <> 'error'
UNION ALL
SELECT CAST(user_id AS VARCHAR), ms, ms + 60000, ['Walk', 'Car', 'Bus'][k % 4 + 1], ['walk', 'car', 'bus'][k % 4 + 1] FROM d WHERE event_type IN ('click', 'view') AND k % 4 < 3""")
def label_decode_json(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("walk", "car", "bus", "boat")]), k % 4 + 1)
    at = lambda s: F.date_format(F.expr(f"cast(ts as timestamp) + interval {s} seconds"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ride = F.col("event_type").isin("click", "view")
    doc = F.to_json(F.struct(F.when(ride, mode).alias("mode_key"), F.when(~ride & (F.col("event_type") != "error"), F.col("event_type")).alias("purpose_key"), at(0).alias("started_at"), at(60).alias("finished_at")))
    docs = ev.select(F.col("user_id").cast("string").alias("userId"), doc.alias("attributes"))
    return external.label_documents(docs, "attributes", {"walk": "Walk", "car": "Car", "bus": "Bus"}).select("userId", "started_at", "finished_at", "mode", "mode_key")


@query(SQL + """ SELECT "userId", event_id, accuracy FROM fixes WHERE accuracy IS NULL OR accuracy <= 50""")
def gps_accuracy_filter(spark, sf):
    return quality.accuracy_filter(T.fixes(spark, sf)).select("userId", "event_id", "accuracy")


UNIT_SQL = SQL + """, med AS (SELECT "userId", quantile_cont(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z), 0.5) AS m FROM samples GROUP BY ALL),
unit AS (SELECT s."userId", event_id, "timestamp", acc_x / f AS acc_x, acc_y / f AS acc_y, acc_z / f AS acc_z, gyr_x, gyr_y, gyr_z
  FROM (SELECT s.*, CASE WHEN m > 5 THEN 9.80665::DOUBLE ELSE 1.0::DOUBLE END AS f FROM samples s JOIN med USING ("userId")) s)"""


@query(UNIT_SQL + """ SELECT "userId", event_id, round(acc_x, 6) AS acc_x, round(acc_y, 6) AS acc_y, round(acc_z, 6) AS acc_z FROM unit""")
def unit_normalise(spark, sf):
    return rounded(quality.to_g(T.samples(spark, sf), ["userId"]).select("userId", "event_id", "acc_x", "acc_y", "acc_z"), 6)


@query(UNIT_SQL + """ SELECT "userId", count(*) AS kept FROM unit WHERE sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) <= 4 GROUP BY ALL""")
def spike_filter(spark, sf):
    return quality.spike_filter(quality.to_g(T.samples(spark, sf), ["userId"])).groupBy("userId").agg(F.count(F.lit(1)).alias("kept"))


@query(SQL + """ SELECT "userId", round(quantile_cont(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z), 0.5), 4) AS median_mag,
  CASE WHEN quantile_cont(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z), 0.5) < 5 THEN 'iOS' ELSE 'Android' END AS device FROM samples GROUP BY ALL""")
def device_map(spark, sf):
    return rounded(quality.devices(T.samples(spark, sf)))


@query(SQL + """ SELECT place_id FROM places WHERE lat BETWEEN 46.072 AND 46.076 AND lon BETWEEN 11.121 AND 11.127""")
def bounding_box(spark, sf):
    return quality.within_box(T.layer(spark, sf), (46.072, 46.076), (11.121, 11.127)).select("place_id")


@query(SQL + """ SELECT "userId", count(*) AS n FROM points WHERE "userId" NOT IN ('1', '2', '3') GROUP BY ALL""")
def exclude_users(spark, sf):
    return T.points(spark, sf).where(~F.col("userId").isin("1", "2", "3")).groupBy("userId").agg(F.count(F.lit(1)).alias("n"))


@query(SQL + """ SELECT CASE WHEN speed > 0 AND speed <= 1.5 THEN 'slow' WHEN speed > 1.5 AND speed <= 9 THEN 'middle' WHEN speed > 9 AND speed <= 40 THEN 'fast' END AS bin, count(*) AS n FROM fixes GROUP BY ALL""")
def binning(spark, sf):
    return T.fixes(spark, sf).groupBy(quality.binned(F.col("speed"), [0.0, 1.5, 9.0, 40.0], ["slow", "middle", "fast"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(SQL + """ SELECT "userId", event_id, row_number() OVER (ORDER BY CAST("userId" AS BIGINT), "timestamp", event_id) AS place FROM fixes""")
def stable_sort(spark, sf):
    """The place of every fix in the order by user and time."""
    rows = T.fixes(spark, sf).select("userId", F.col("userId").cast("bigint").alias("user"), "timestamp", "event_id", F.lit(1).cast("bigint").alias("one"))
    return cumulated(rows, ["user", "timestamp", "event_id"], ["one"]).select("userId", "event_id", (F.col("before_one") + 1).alias("place"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 10")
def top_users(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE value > 200")
def user_sets(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    of = lambda c: ev.where(c).select("user_id")
    return of("event_type = 'signup'").intersect(of("event_type = 'error'")).subtract(of("value > 200"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50) GROUP BY ALL""")
def first_n_keys(spark, sf):
    few = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").distinct().orderBy("o_orderkey").limit(50)
    return spark.read.parquet(f"{sf}/lineitem.parquet").join(few, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS stop_id, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon, CAST(c_nationkey % 4 AS VARCHAR) AS route_type
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_suppkey % 97 <> 0""")
def gtfs_like_join(spark, sf):
    """Stops that routes serve: suppliers are stops, orders trips with items as stop times, customers routes; some stops lie nowhere."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    text = lambda c: F.col(c).cast("string")
    place = lambda n: F.when(F.col("s_suppkey") % 97 == 0, "").otherwise((F.col("s_suppkey") % n).cast("string"))
    stops = read("supplier").select(text("s_suppkey").alias("stop_id"), place(90).alias("stop_lat"), place(180).alias("stop_lon"))
    times = read("lineitem").select(text("l_orderkey").alias("trip_id"), text("l_suppkey").alias("stop_id"))
    trips = read("orders").select(text("o_orderkey").alias("trip_id"), text("o_custkey").alias("route_id"))
    routes = read("customer").select(text("c_custkey").alias("route_id"), (F.col("c_nationkey") % 4).cast("string").alias("route_type"))
    return external.served_stops(stops, times, trips, routes)


WRITTEN = """SELECT user_id AS "userId", count(*) AS n, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_id % 3 <> 0 AND epoch_us(ts) // 1000 BETWEEN (SELECT min(epoch_us(ts) // 1000) + 5 * 86400000 FROM events) AND (SELECT max(epoch_us(ts) // 1000) - 5 * 86400000 FROM events) GROUP BY ALL"""


@query(WRITTEN)
def written_range_scan(spark, sf):
    """Fixes written with row groups of their own size and scanned for a range of times by the library's reader."""
    ev = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 3 <> 0").select(F.col("user_id").cast("string").alias("userId"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit(46.0).alias("latitude"), F.lit(11.0).alias("longitude"), F.col("value").alias("speed"))
    path = f"{shared_dir(spark).rstrip('/')}/fixes-{uuid.uuid4().hex}"
    tables.write(ev.repartitionByRange("timestamp").sortWithinPartitions("timestamp"), path)
    ends = spark.read.parquet(f"{sf}/events.parquet").agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))), F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()
    found = tables.gps(spark, path, ends[0] + 5 * 86_400_000, ends[1] - 5 * 86_400_000)
    return found.groupBy(F.col("userId").cast("bigint").alias("userId")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


@query("""SELECT CAST(user_id AS VARCHAR) AS "userId", count(*) AS n, round(sum(value), 3) AS total, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_type = 'purchase' AND value > 10 GROUP BY ALL""")
def document_store_scan(spark, sf):
    """All events exported as nested documents, found by type and value and projected by the document source."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    path = f"{shared_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    nested = F.struct(F.col("event_type").alias("type"), F.col("value").cast("double").alias("value"))
    ev.select(F.col("user_id").cast("string").alias("userId"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), nested.alias("event")).write.json(path)
    found = documents.documents(spark, path, "userId string, ms bigint, `event.type` string, `event.value` double")
    found = found.where((F.col("`event.type`") == "purchase") & (F.col("`event.value`") > 10))
    return rounded(found.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.sum("`event.value`").alias("total"), F.max("ms").alias("last_ms")), 3)


#: The events over five months: a user's are a whole number of months later.
MONTHS_MS = 31 * 86_400_000


@query(f"""WITH e AS (SELECT event_id, value, strftime(make_timestamp(epoch_us(ts) + user_id % 5 * {MONTHS_MS * 1000}), '%Y-%m') AS month FROM events),
v AS (SELECT month, CASE WHEN event_id % 5 = 0 AND month = '2024-01' THEN value + 2 WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS value FROM e)
SELECT month, count(*) AS n, round(sum(value), 3) AS total FROM v GROUP BY ALL""")
def upsert_months(spark, sf):
    """All events merged by month, then two batches of corrections, of which the last touches January only."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("userId"), "event_id", (F.unix_millis(F.col("ts").cast("timestamp")) + F.col("user_id") % 5 * MONTHS_MS).alias("timestamp"), F.col("value").cast("double").alias("value"))
    target = f"{shared_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    january = tables.month(F.col("timestamp")) == "2024-01"
    for number, batch in enumerate((ev, ev.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1), ev.where((F.col("event_id") % 5 == 0) & january).withColumn("value", F.col("value") + 2))):
        merging.merge(batch, number, target, ["userId", "event_id", "timestamp"])
    rows = merging.table(spark, target, ev.schema)
    return rounded(rows.groupBy(tables.month(F.col("timestamp")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("""SELECT o_orderkey, o_custkey, c_mktsegment AS segment, count(*) OVER () AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def left_join_metrics(spark, sf):
    orders, customers = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0")
    n = orders.count()
    segments = customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return joins.left_kept(orders, segments, ["o_custkey"]).select("o_orderkey", "o_custkey", "segment", F.lit(n).cast("bigint").alias("n"))


@query(SQL + """, g AS (SELECT "userId", count(*) AS n_gps FROM fixes WHERE speed > 10 GROUP BY ALL), i AS (SELECT "userId", count(*) AS n_imu FROM samples WHERE gyr_x > 0.3 GROUP BY ALL), l AS (SELECT "userId", count(*) AS n_labels FROM intervals GROUP BY ALL)
SELECT coalesce(g."userId", i."userId", l."userId") AS "userId", coalesce(n_gps, 0) AS n_gps, coalesce(n_imu, 0) AS n_imu, coalesce(n_labels, 0) AS n_labels FROM g FULL JOIN i ON g."userId" = i."userId" FULL JOIN l ON coalesce(g."userId", i."userId") = l."userId" """)
def full_outer_overview(spark, sf):
    n = lambda df, name: df.groupBy("userId").agg(F.count(F.lit(1)).alias(name))
    parts = [n(T.fixes(spark, sf).where("speed > 10"), "n_gps"), n(T.samples(spark, sf).where("gyr_x > 0.3"), "n_imu"), n(T.intervals(spark, sf), "n_labels")]
    out = parts[0].join(parts[1], "userId", "full").join(parts[2], "userId", "full")
    return out.select("userId", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_gps", "n_imu", "n_labels")])


@query("""SELECT 'semi' AS kind, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'anti', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def semi_anti_sessions(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    big = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")
    on = F.col("o_orderkey") == F.col("l_orderkey")
    n = lambda kind: orders.join(big, on, f"left_{kind}").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n("semi").union(n("anti"))


@query("""SELECT l_orderkey, coalesce(['Walk', 'Car', 'Bus'][o_orderkey % 4 + 1], 'Still') AS mode, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def map_lookup(spark, sf):
    from ..operators.models import remapped

    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 4).cast("string").alias("m"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", remapped(F.col("m"), {"0": "Walk", "1": "Car", "2": "Bus", "3": "Still"}).alias("mode"), "l_linenumber")


@query("""SELECT CAST(user_id AS VARCHAR) AS "userId", CAST(round((epoch_us(ts) / 86400000000.0::DOUBLE + 25569 - 25569) * 86400000.0::DOUBLE) AS BIGINT) AS "timestamp", 46.0::DOUBLE + event_id / 1000000.0::DOUBLE AS latitude, 11.1::DOUBLE AS longitude FROM events""")
def archive_readers(spark, sf):
    """Points and labels of a trajectory archive written from events, in its own text formats."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    line = F.concat_ws(",", (F.lit(46.0) + F.col("event_id") / 1e6).cast("string"), F.lit("11.1"), F.lit("0"), F.lit("100"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0) + external.DAY_ZERO).cast("string"), F.lit("d"), F.lit("t"))
    lines = ev.select(line.alias("value"), F.concat(F.lit("x/"), F.col("user_id").cast("string"), F.lit("/Trajectory/a.plt")).alias("path"))
    return external.archive_points(lines)
