"""Places near points: nearest distances, proximity features, alignment, thinning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geo import DEGREE_M, EARTH_M, haversine
from ..functions.stats import pct, share
from ..session import cut

#: Layers, the distance (m) at which a point is at a place of them, and the features made of each.
LAYERS = {
    "bus_stops": (50.0, ("prop", "mean", "flag")), "rail_stations": (500.0, ("min", "flag")), "subway_stations": (200.0, ("mean", "flag")), "osm_rail": (30.0, ("prop", "p10")),
    "osm_subway": (200.0, ("prop",)), "osm_motorway": (50.0, ("flag", "min")), "osm_cycleway": (10.0, ("flag", "mean", "min")),
}
#: Places of a layer that may be broadcast to all executors: each Python worker holds some 50 bytes for each of them.
BROADCAST_PLACES = 250_000


def cell(lat: Column, lon: Column, size_m: float, at_lat: float) -> tuple[Column, Column]:
    """Row and column of a grid of about size_m, by a fixed latitude."""
    return F.floor(lat * DEGREE_M / size_m), F.floor(lon * DEGREE_M * math.cos(math.radians(at_lat)) / size_m)


def columns_of(row: Column, size_m: float) -> Column:
    """How many columns a row of a grid has around the globe: each at least size_m wide, in this row and the next ones."""
    edge = (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * (size_m / DEGREE_M)
    width = size_m * 1.001 / (DEGREE_M * F.cos(F.radians(F.least(edge, F.lit(89.9)))))
    return F.when(edge >= 89.9, F.lit(1).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(360.0) / width)))


def column_in(row: Column, lon: Column, size_m: float) -> Column:
    n = columns_of(row, size_m)
    return F.least(n - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n))


def standing(points: DataFrame, within_m: float) -> DataFrame:
    """points with the cell (__r, __c) of a grid of within_m that each stands in."""
    return points.withColumn("__r", F.floor(F.col("latitude") * (DEGREE_M / within_m))).withColumn("__c", column_in(F.col("__r"), F.col("longitude"), within_m))


def around(places: DataFrame, within_m: float) -> DataFrame:
    """places once for each cell (__r, __c) of that grid from which they can be reached."""
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    row = F.floor(F.col("lat") * (DEGREE_M / within_m))
    q = places.withColumn("__r", F.explode(F.transform(steps, lambda d: row + d)))
    column = column_in(F.col("__r"), F.col("lon"), within_m)
    return q.withColumn("__c", F.explode(F.array_distinct(F.transform(steps, lambda d: F.pmod(column + d, columns_of(F.col("__r"), within_m))))))


def near_pairs(points: DataFrame, places: DataFrame, within_m: float) -> DataFrame:
    """All pairs of points (latitude, longitude) and places (lat, lon) up to within_m apart, with dist_m.

    A point stands in one cell, a place in each cell from which it can be reached: an equi-join on cells, never a cross join, in
    which the points, the larger side, are not multiplied. Rows of cells have fewer columns the nearer they are to a pole,
    and columns go on over the date line, so no pair is missed anywhere.
    """
    p, q = standing(points, within_m), around(places, within_m)
    met = p.join(q, ["__r", "__c"]).drop("__r", "__c")
    return met.withColumn("dist_m", haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))).where(F.col("dist_m") <= within_m)


def spots(places: DataFrame, group: Column) -> DataFrame:
    """The distinct positions (lat, lon) of each group (__g), dealt out by number: few bytes, but much work for each."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = places.where("lat is not null and lon is not null").select("lat", "lon", group.alias("__g"))
    return known.repartition(n, "lat", "lon").distinct()


def reached_cells(places: DataFrame, within_m: float, group: Column) -> DataFrame:
    """__sr, __sc and __sure, a set of groups: cells of a quarter of within_m that lie within within_m of a place of each group
    as a whole. The farthest point of a cell from a place is one of its corners; a micrometre is left for rounding."""
    size = within_m / 4
    q = spots(places, group).withColumn("__sr", F.explode(F.transform(F.array(*[F.lit(x) for x in range(-3, 4)]), lambda d: F.floor(F.col("lat") * (DEGREE_M / size)) + d)))
    n = columns_of(F.col("__sr"), size)
    q = q.withColumn("__n", n).where("__n >= 16")  # rows next to a pole have too few columns for corners to be farthest
    q = q.withColumn("__sc", F.explode(F.transform(F.array(*[F.lit(x) for x in range(-4, 5)]), lambda d: F.pmod(column_in(F.col("__sr"), F.col("lon"), size) + d, F.col("__n")))))
    rim = [((F.col("__sr") + i) * (size / DEGREE_M), (F.col("__sc") + j) * 360.0 / F.col("__n") - 180.0) for i in (0, 1) for j in (0, 1)]
    whole = F.greatest(*[haversine(F.col("lat"), F.col("lon"), a, b) for a, b in rim]) < within_m - 1e-6
    return q.where(whole).select("__sr", "__sc", "__g").distinct().groupBy("__sr", "__sc").agg(F.collect_set("__g").alias("__sure"))


def groups_near(points: DataFrame, places: DataFrame, within_m: float, group: Column, strict: bool = True) -> DataFrame:
    """points and __near, the groups that have a place nearer than within_m (or, if not strict, as near): null or empty if none.

    Most answers come from whole cells that are within reach of a place, a join with one row for each cell. Only a point and a group of
    its surroundings that this leaves open meet the places of that group one by one; places at one spot count once. So
    dense layers, where all pairs would grow with the square, leave the less open the denser they are.
    """
    size, near = within_m / 4, F.col("dist_m") < within_m if strict else F.col("dist_m") <= within_m
    rows = points.withColumn("__sr", F.floor(F.col("latitude") * (DEGREE_M / size))).withColumn("__sc", column_in(F.col("__sr"), F.col("longitude"), size))
    rows = rows.join(reached_cells(places, within_m, group), ["__sr", "__sc"], "left").drop("__sr", "__sc").withColumn("__p", F.monotonically_increasing_id())
    rows = cut(rows)
    p, q = standing(rows, within_m), around(spots(places, group), within_m)
    here = q.groupBy("__r", "__c").agg(F.collect_set("__g").alias("__here"))
    none = F.array().cast(here.schema["__here"].dataType)
    asked = p.join(here, ["__r", "__c"]).select("__p", "latitude", "longitude", "__r", "__c", F.explode(F.array_except("__here", F.coalesce("__sure", none))).alias("__g"))
    met = asked.join(q, ["__r", "__c", "__g"]).withColumn("dist_m", haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))).where(near)
    found = met.groupBy("__p").agg(F.collect_set("__g").alias("__met"))
    return rows.join(found, "__p", "left").withColumn("__near", F.array_union(F.coalesce("__sure", none), F.coalesce("__met", none))).drop("__p", "__sure", "__met")


def nearest(points: DataFrame, places: DataFrame, name: str = "dist_m", step: int = 1024) -> DataFrame:
    """points with the exact distance to the nearest place, null without places; places without a position are none.

    Layers are small maps: they are collected only after a count shows them within BROADCAST_PLACES, and travel in boxes, so
    a point meets about the square root of their number. Larger layers go through `nearest_by_cells`.
    """
    spark = points.sparkSession
    places = cut(spots(places, F.lit(0)).select("lat", "lon"))  # places at one spot are as near
    n = places.count()
    if n == 0:
        return points.withColumn(name, F.lit(None).cast("double"))
    if n > BROADCAST_PLACES:
        return nearest_by_cells(points, places, name)
    known = spark.sparkContext.broadcast(boxes(unit(*(places.toPandas().to_numpy(float).T))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("latitude", "longitude"))
            out = np.full(len(lat), np.nan)
            ok = np.flatnonzero(~np.isnan(lat) & ~np.isnan(lon))
            for i in range(0, len(ok), step):
                at = ok[i : i + step]
                out[at] = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(chords(unit(lat[at], lon[at]), *known.value)) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return points.mapInArrow(run, StructType([*points.schema.fields, StructField(name, DoubleType())]))


def boxes(places: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places on the unit sphere in boxes of at most the square root of their number, with the lower and upper corners."""
    most, todo, done = max(16, math.isqrt(len(places))), [places], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        half = len(part) // 2
        part = part[np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)]
        todo += [part[:half], part[half:]]
    return done, np.stack([d.min(axis=0) for d in done]), np.stack([d.max(axis=0) for d in done])


def chords(points: np.ndarray, parts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared chords to the nearest place: each point looks into the nearest box left, until none can hold a nearer place."""
    gap = sum(np.maximum(0, np.maximum(low[:, a] - points[:, a, None], points[:, a, None] - high[:, a])) ** 2 for a in range(3))
    best, looking = np.full(len(points), np.inf), np.arange(len(points))
    while len(looking):
        box = gap[looking].argmin(axis=1)
        nearer = gap[looking, box] < best[looking]
        looking, box = looking[nearer], box[nearer]
        gap[looking, box] = np.inf
        for b in np.unique(box):
            at = looking[box == b]
            best[at] = np.minimum(best[at], ((points[at, None, :] - parts[b]) ** 2).sum(axis=2).min(axis=1))
    return best


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def first_cells(places: DataFrame, widest_m: float, crowd: float = 4.0) -> float:
    """Widths of cells from widest_m down by fours, the first in which a place shares its cell with at most `crowd` on average."""
    size = widest_m
    while size > 0.01:
        cells = standing(places.withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), size).groupBy("__r", "__c").agg(F.count(F.lit(1)).cast("double").alias("k"))
        if (cells.agg(F.sum(F.col("k") * F.col("k")) / F.sum("k")).first()[0] or 0.0) <= crowd:
            break
        size /= 4
    return size


def nearest_by_cells(points: DataFrame, places: DataFrame, name: str = "dist_m", start_m: float = 500.0, rounds: int = 12) -> DataFrame:
    """Nearest distances by widening the cells for the points that found nothing yet; for layers too large to broadcast.

    Dense layers begin with smaller cells, so that a point meets a few places only, and widen by as many more rounds.
    """
    rest = points.withColumn("__id", F.monotonically_increasing_id())
    rest, out, size = cut(rest), None, first_cells(places, start_m)
    last = start_m * 4.0 ** (rounds - 1)
    while size <= last:
        found = near_pairs(rest.select("__id", "latitude", "longitude"), places.select("lat", "lon"), size).groupBy("__id").agg(F.min("dist_m").alias(name))
        found = cut(found)
        got = rest.join(found, "__id")
        out = got if out is None else out.unionByName(got)
        rest = cut(rest.join(found, "__id", "left_anti"))
        if rest.isEmpty():
            break
        size *= 4
    return out.unionByName(rest.withColumn(name, F.lit(None).cast("double"))).drop("__id")


def proximity(fixes: DataFrame, keys: list[str], layers: dict[str, str | None]) -> DataFrame:
    """The 15 C features of each group from columns of nearest distances: layers maps a layer to its column.

    A layer mapped to None was not built: its shares and flags are 0 and its distances null. Without any layer all are null.
    """
    aggs = []
    for layer, (limit, kinds) in LAYERS.items():
        column = layers.get(layer)
        d = F.col(column) if column else F.lit(None).cast("double")
        made = {
            "prop": F.coalesce(share(F.coalesce(d < limit, F.lit(False))), F.lit(0.0)), "flag": F.when(F.coalesce(F.min(d) < limit, F.lit(False)), 1.0).otherwise(0.0),
            "mean": F.avg(d), "min": F.min(d), "p10": pct(d, 0.1),
        }
        aggs += [(made[k] if layers else F.lit(None).cast("double")).alias(f"C_{layer}_{k}") for k in kinds]
    return fixes.groupBy(*keys).agg(*aggs)


def aligned_share(fixes: DataFrame, vertices: DataFrame, keys: list[str], within_m: float = 50.0, least: int = 2) -> DataFrame:
    """keys and align: the largest share, over the shapes, of a group's points that are within_m from a vertex of the shape;
    null below `least` points, 0 where no shape is near. vertices: shape_id, lat, lon."""
    points = fixes.select(*keys, "latitude", "longitude")
    total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hit = groups_near(points, vertices, within_m, F.struct("shape_id")).select(*keys, F.explode("__near").alias("__s")).select(*keys, "__s.shape_id")
    best = hit.groupBy(*keys, "shape_id").agg(F.count(F.lit(1)).alias("__k")).groupBy(*keys).agg(F.max("__k").alias("__k"))
    return total.join(best, keys, "left").select(*keys, F.when(F.col("__n") >= least, F.coalesce(F.col("__k"), F.lit(0)) / F.col("__n")).alias("align"))


def rail_align(fixes: DataFrame, keys: list[str], distance: str, within_m: float = 20.0) -> DataFrame:
    return fixes.groupBy(*keys).agg(share(F.coalesce(F.col(distance) < within_m, F.lit(False))).alias("rail_align"))


def away_from(places: DataFrame, others: DataFrame, metres: float = 30.0) -> DataFrame:
    """places further than `metres` from all of others (both lat, lon)."""
    mine = places.select("*", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return groups_near(mine, others, metres, F.lit(0), strict=False).where(F.size("__near") == 0).select(*places.columns)


def thin(places: DataFrame, size_m: float, order: str, at_lat: float) -> DataFrame:
    """The first place, by `order`, of each grid cell of about size_m."""
    row, column = cell(F.col("lat"), F.col("lon"), size_m, at_lat)
    first = places.withColumn("__r", row).withColumn("__c", column).groupBy("__r", "__c").agg(F.min_by(F.struct(*places.columns), order).alias("__f"))
    return first.select("__f.*")


def arc_length(vertices: DataFrame, shape: str = "shape_id", order: str = "seq") -> DataFrame:
    """Metres along the line up to each vertex."""
    w = W.partitionBy(shape).orderBy(order)
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return vertices.withColumn("__d", F.coalesce(step, F.lit(0.0))).withColumn("along_m", F.sum("__d").over(w)).drop("__d")


def points_along(vertices: DataFrame, spacing_m: float, shape: str = "shape_id", order: str = "seq") -> DataFrame:
    """Points every spacing_m along each line, interpolated between its vertices."""
    w = W.partitionBy(shape).orderBy(order)
    v = arc_length(vertices, shape, order).withColumns({f"__{c}": F.lead(c).over(w) for c in ("lat", "lon", "along_m")}).where("__along_m > along_m")
    first, last = F.ceil(F.col("along_m") / spacing_m), F.ceil(F.col("__along_m") / spacing_m) - 1
    ks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    f = (F.col("__k") * spacing_m - F.col("along_m")) / (F.col("__along_m") - F.col("along_m"))
    rows = v.withColumn("__k", F.explode(ks))
    return rows.select(shape, (F.col("__k") * spacing_m).alias("along_m"), *[(F.col(c) + f * (F.col(f"__{c}") - F.col(c))).alias(c) for c in ("lat", "lon")])
