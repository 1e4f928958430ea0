"""Readers of foreign formats: transit feeds, map exports, trajectory archives, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GTFS

#: Days from 1899-12-30 to 1970-01-01.
DAY_ZERO = 25_569
# Modes of the trajectory archive.
ARCHIVE_MODES = {"walk": "Walk", "car": "Car", "taxi": "Car", "bus": "Bus", "train": "Train", "subway": "Train"}


def gtfs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a transit feed as text columns of its schema; further columns of the file are left out."""
    df = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}.txt")
    has = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in has else F.lit(None)).cast("string").alias(f.name) for f in GTFS[name].fields])


def coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """lat and lon as numbers; rows where either is none are left out."""
    return df.withColumns({"lat": F.expr(f"try_cast({lat} as double)"), "lon": F.expr(f"try_cast({lon} as double)")}).where("lat is not null and lon is not null")


def served_stops(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct stop, coordinates and route type of all stops that a route serves."""
    kinds = trips.join(routes, "route_id").select("trip_id", "route_type")
    served = stop_times.select("trip_id", "stop_id").join(kinds, "trip_id").select("stop_id", "route_type").distinct()
    return coordinates(stops, "stop_lat", "stop_lon").join(served, "stop_id").select("stop_id", "lat", "lon", "route_type").distinct()


def map_features(lines: DataFrame, column: str = "value") -> DataFrame:
    """id, kind, lat, lon of all vertices in a GeoJSON sequence (one feature a line, record separators allowed)."""
    line = F.ltrim(F.regexp_replace(column, "\x1e", ""))
    kind = F.get_json_object(line, "$.geometry.type")
    raw = F.get_json_object(line, "$.geometry.coordinates")
    point = F.array(F.from_json(raw, T.ArrayType(T.DoubleType())))
    string = F.from_json(raw, T.ArrayType(T.ArrayType(T.DoubleType())))
    multi = F.flatten(F.from_json(raw, T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
    pairs = F.when(kind == "Point", point).when(kind == "LineString", string).when(kind == "MultiLineString", multi)
    rows = lines.select(F.coalesce(F.get_json_object(line, "$.id"), F.get_json_object(line, "$.properties.@id")).alias("id"), kind.alias("kind"), F.explode(pairs).alias("p"))
    return rows.select("id", "kind", F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lon")).where("lat is not null and lon is not null")


def archive_points(lines: DataFrame) -> DataFrame:
    """userId, timestamp (ms), latitude, longitude of a trajectory archive's point files, read as text with their `path`.

    Each file has six heading lines; data lines are told from these by their seven fields.
    """
    f = F.split("value", ",")
    rows = lines.select(F.regexp_extract("path", r"([^/]+)/Trajectory/[^/]+$", 1).alias("userId"), f.alias("f")).where(F.size("f") == 7)
    number = lambda i: F.expr(f"try_cast(f[{i}] as double)")
    ms = F.round((number(4) - DAY_ZERO) * F.lit(86_400_000.0)).cast("bigint")
    return rows.select("userId", ms.alias("timestamp"), number(0).alias("latitude"), number(1).alias("longitude")).where("timestamp is not null and latitude is not null and longitude is not null")


def archive_labels(lines: DataFrame) -> DataFrame:
    """userId, started_at, finished_at (ms), mode of the archive's label files (tab separated, one heading line)."""
    f = F.split("value", "\t")
    at = lambda i: F.unix_millis(F.try_to_timestamp(f[i], F.lit("yyyy/MM/dd HH:mm:ss")))
    mode = F.element_at(F.create_map(*[F.lit(x) for kv in ARCHIVE_MODES.items() for x in kv]), F.lower(F.trim(F.get(f, F.lit(2)))))
    rows = lines.where(F.size(f) >= 3).select(F.regexp_extract("path", r"([^/]+)/labels\.txt$", 1).alias("userId"), at(0).alias("started_at"), at(1).alias("finished_at"), mode.alias("mode"))
    return rows.where("started_at is not null and finished_at is not null and mode is not null")


def text_with_path(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.text(glob).withColumn("path", F.col("_metadata.file_path"))


def flattened(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Nested documents to flat columns: name to dotted path."""
    return df.select(*[F.col(p).alias(n) for n, p in paths.items()])


def iso_millis(text: Column) -> Column:
    """Milliseconds of an ISO time with its offset; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def label_documents(df: DataFrame, attributes: str, modes: dict[str, str], user: str = "userId") -> DataFrame:
    """userId, started_at, finished_at, mode, mode_key, detected_mode_key of label documents.

    attributes: a JSON object or a struct column. A mode key is mapped, unmapped ones are left out; without one, a purpose
    makes a stay, which is Still; other documents, and those with unreadable times, are left out.
    """
    fields = ("mode_key", "purpose_key", "started_at", "finished_at", "detected_mode_key")
    if isinstance(df.schema[attributes].dataType, T.StringType):
        df = df.withColumn(attributes, F.from_json(attributes, T.StructType([T.StructField(f, T.StringType()) for f in fields])))
    a = {f: F.col(f"{attributes}.{f}") for f in fields}
    filled = lambda x: x.isNotNull() & (x != "")
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in modes.items() for x in kv]), a["mode_key"])
    mode = F.when(filled(a["mode_key"]), mapped).when(filled(a["purpose_key"]), F.lit("Still"))
    key = F.when(filled(a["mode_key"]), a["mode_key"]).otherwise(F.concat(F.lit("stay_"), a["purpose_key"]))
    rows = df.select(user, iso_millis(a["started_at"]).alias("started_at"), iso_millis(a["finished_at"]).alias("finished_at"), mode.alias("mode"), key.alias("mode_key"), a["detected_mode_key"].alias("detected_mode_key"))
    return rows.where("mode is not null and started_at is not null and finished_at is not null")


def local_day_end(day: Column, zone: str = "Europe/Rome") -> Column:
    """The last millisecond of a local day: a millisecond before the next local midnight, whatever the clock change."""
    return F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)) - 1
