"""Inertial statistics whose rows meet in buckets of time: equal to windows over whole keys, for any size of bucket and group."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from modeflow.functions import quantiles
from modeflow.functions.order import numbered, shifted, with_totals
from modeflow.operators import imu, spatial

SCHEMA = "userId string, timestamp bigint, event_id bigint, v double"


def made(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["u", "u", "u", "v", None]), rng.randrange(2000) * rng.choice([1, 1, 1, 50]), i, rng.choice([None, rng.random()])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 300, 10**9])
def test_shifted_equals_lag_and_lead(spark, width):
    df = spark.createDataFrame(made(width), SCHEMA).repartition(5)
    w = W.partitionBy("userId").orderBy("timestamp", "event_id")
    moves = {"a": ("v", -1), "b": ("v", -3), "c": ("v", 2), "d": ("event_id", 40)}
    want = df.withColumns({n: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) for n, (c, k) in moves.items()})
    got = shifted(df, ["userId"], ["timestamp", "event_id"], moves, F.floor(F.col("timestamp") / width))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    places = df.withColumn("__at", F.row_number().over(w) - 1).withColumn("__total", F.count(F.lit(1)).over(W.partitionBy("userId")))
    got = numbered(df, ["userId"], ["timestamp", "event_id"], F.floor(F.col("timestamp") / width))
    assert sorted(map(str, got.select(places.columns).collect())) == sorted(map(str, places.collect()))
    total = with_totals(df, ["userId"], {"m": F.avg("v"), "n": F.count("v")})
    want = df.withColumns({"m": F.avg("v").over(W.partitionBy("userId")), "n": F.count("v").over(W.partitionBy("userId"))})
    assert sorted((r["event_id"], r["n"], pytest.approx(r["m"])) for r in total.collect()) == sorted((r["event_id"], r["n"], r["m"]) for r in want.collect())


def test_nothing_is_shifted(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert shifted(none, ["userId"], ["timestamp"], {"a": ("v", 1)}, F.lit(0)).count() == 0


def samples(spark):
    """One user with nearly all rows."""
    rng = random.Random(3)
    rows = [("hot" if i % 50 else "cold", 20 * i, i, *(rng.gauss(0, 1) for _ in range(6))) for i in range(6000)]
    return spark.createDataFrame(rows, "userId string, timestamp bigint, event_id bigint, acc_x double, acc_y double, acc_z double, gyr_x double, gyr_y double, gyr_z double")


WORK = {
    "statistics": lambda df: imu.statistics(df, ["userId"]),
    "jerk": lambda df: imu.jerk(df, ["userId"]),
    "autocorrelation": lambda df: imu.autocorrelation(df, ["userId"], {"short": 3, "long": 60}),
    "time_entropy": lambda df: imu.time_entropy(df, ["userId"], "acc_x"),
    "rotation_invariant": lambda df: imu.rotation_invariant(df, ["userId"], ("acc_x", "acc_y", "acc_z"), "A_acc"),
}


@pytest.mark.parametrize("name", sorted(WORK))
def test_one_user_is_spread(spark, monkeypatch, name):
    """Small buckets and quantiles by selection give what one bucket and one aggregation do; no task gets the user's rows alone."""
    df = samples(spark)
    want = {r["userId"]: r for r in WORK[name](df).collect()}
    monkeypatch.setattr(imu, "BUCKET_MS", 1000)
    monkeypatch.setattr(quantiles, "MOST", 200)
    monkeypatch.setattr(quantiles.quantiles, "__defaults__", (200,))
    out = WORK[name](df)
    for r in out.collect():
        assert r.asDict() == {k: pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v for k, v in want[r["userId"]].asDict().items()}
    assert out.count() == len(want) == 2


def test_rows_of_one_user_go_to_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = shifted(samples(spark), ["userId"], ["timestamp", "event_id"], {"p": ("acc_x", -1)}, F.floor(F.col("timestamp") / 1000))
        sizes = [r["count"] for r in got.where("userId = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 0.4 * sum(sizes)


def test_points_are_not_multiplied(spark):
    """Each point stands in one cell: the plan explodes the places only."""
    points = spark.createDataFrame([(1, 46.0, 11.0)], "id int, latitude double, longitude double")
    places = spark.createDataFrame([(46.0001, 11.0001), (46.3, 11.0)], "lat double, lon double")
    pairs = spatial.near_pairs(points, places, 50.0)
    assert pairs.count() == 1
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join") :].split("+- ")[0]
    assert "Generate" not in left


@pytest.mark.parametrize("lat,lon", [(46.0, 11.0), (-0.0001, 179.9999), (78.0, -179.9999), (89.9995, 20.0)])
def test_groups_near_equal_all_pairs(spark, lat, lon):
    """Answers from whole cells and from single pairs are those of all pairs, over the date line and at a pole too."""
    rng = random.Random(8)
    wide = 0.0015 / max(0.01, math.cos(math.radians(lat)))
    spot = lambda: (min(90.0, lat + rng.uniform(0, 0.0015)), (lon + rng.uniform(0, wide) + 180) % 360 - 180)
    points, places = [(i, *spot()) for i in range(300)] + [(300, None, 1.0)], [(j % 3 if j % 5 else None, *spot()) for j in range(60)] + [(1, None, None)]

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    p, q = spark.createDataFrame(points, "i int, latitude double, longitude double"), spark.createDataFrame(places, "g int, lat double, lon double")
    got = {r["i"]: {x["g"] for x in r["__near"] or []} for r in spatial.groups_near(p, q, 50.0, F.struct("g")).collect()}
    want = {i: {g for g, c, d in places if a is not None and c is not None and metres(a, b, c, d) < 50} for i, a, b in points}
    assert got == want and any(len(x) == 4 for x in want.values()) and any(len(x) < 4 for x in want.values())


def test_dense_layers_are_settled_by_cells(spark):
    """Where places lie close, whole cells answer for the points: no pair of a point and a place is left to be made."""
    at = lambda n: [(46.07 + i % n * 5e-5, 11.12 + i // n * 5e-5) for i in range(n * n)]
    places = spark.createDataFrame(at(60), "lat double, lon double")
    cells = spatial.reached_cells(places, 30.0, F.lit(0)).select("__sr", "__sc")
    size = 30.0 / 4
    points = spark.createDataFrame(at(59), "latitude double, longitude double")
    mine = points.withColumn("__sr", F.floor(F.col("latitude") * (spatial.DEGREE_M / size))).withColumn("__sc", spatial.column_in(F.col("__sr"), F.col("longitude"), size))
    assert mine.join(cells, ["__sr", "__sc"], "left_anti").count() == 0
    assert spatial.away_from(points.toDF("lat", "lon"), places).count() == 0


def test_dense_layers_begin_with_small_cells(spark, monkeypatch):
    """Beyond the broadcast a point meets a few places of a dense layer, and the distances are those of the boxes."""
    places = spark.range(10_000).select((46.07 + F.col("id") % 100 * 1e-5).alias("lat"), (11.12 + F.floor(F.col("id") / 100) * 1e-5).alias("lon"))
    points = spark.range(300).select("id", (46.0695 + F.col("id") * 7919 % 2003 * 1e-6).alias("latitude"), (11.1195 + F.col("id") * 104729 % 1999 * 1e-6).alias("longitude"))
    want = {r["id"]: r["d"] for r in spatial.nearest(points, places, "d").collect()}
    met, real = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda p, q, m: met.append((p.count(), q.count(), m)) or real(p, q, m))
    monkeypatch.setattr(spatial, "BROADCAST_PLACES", 9_999)
    got = {r["id"]: r["d"] for r in spatial.nearest(points, places.unionAll(places), "d").collect()}
    assert met[0][1] == 10_000 and met[0][2] < 3 and met[-1][2] > met[0][2] and met[-1][0] < 300
    assert got == pytest.approx(want, abs=1e-5)
