"""Hand-computed cases of the operators."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from modeflow import schemas
from modeflow.functions import geo
from modeflow.operators import aggregate, gps, imu, intervals, labeling, metrics, quality, selection, sessions, smoothing, spatial, spectral, windows


def spelled(text):
    return [m for part in text.split() for m, n in [re.fullmatch(r"(\w+?)×(\d+)", part).groups()] for _ in range(int(n))]


@pytest.mark.parametrize(("given", "healed"), [
    ("Train×1 Car×20", "Car×21"), ("Train×40 Car×3 Train×10", "Train×53"), ("Car×2 Train×6", "Train×8"), ("Bus×2 Car×1 Bus×2", "Car×5"),
    ("Bus×2 Train×2", "Train×4"), ("Bus×2", "Bus×2"), ("Walk×3 Bus×2 Walk×1 Bus×5", "Walk×6 Bus×5"), ("Car×6 Train×4 Walk×2 Train×7", "Car×10 Walk×2 Train×7"),
])
def test_coherence(given, healed):
    assert smoothing.coherent(spelled(given), smoothing.min_windows()) == spelled(healed)


def test_min_windows():
    assert smoothing.min_windows() == {"Train": 5, "Bus": 4, "Bike": 2, "Car": 1, "Walk": 1, "Still": 0}


@pytest.mark.parametrize(("given", "smooth"), [
    ("Bus Car Car Bus Walk", "Car Bus Bus Car Walk"), ("Bus Walk Bus", "Bus Bus Bus"), ("Car Still Car", "Car Still Car"), ("Bus Still Bus", "Bus Bus Bus"),
    ("Walk Car Walk Bus Walk", "Walk Car Walk Bus Walk"), ("Car Bus Train", "Car Car Car"),
])
def test_majority(spark, given, smooth):
    rows = spark.createDataFrame([("s", i, m) for i, m in enumerate(given.split())], "session_id string, ts_start bigint, predicted string")
    out = smoothing.majority(rows, ["session_id"]).orderBy("ts_start").collect()
    assert [r["smooth"] for r in out] == smooth.split()


def test_feature_names():
    assert (len(schemas.FEATURES_A), len(schemas.FEATURES_B), len(schemas.FEATURES_C), len(schemas.FEATURES_D)) == (188, 22, 15, 5)
    assert len(set(schemas.FEATURES)) == 230 and len(schemas.DROPPED) == 67 and set(schemas.DROPPED) <= set(schemas.FEATURES)


def sessions_of(spark, fixes, samples, gap=300.0):
    f = spark.createDataFrame([("user0001x", t, i) for i, t in enumerate(fixes)], "userId string, timestamp bigint, event_id bigint")
    s = spark.createDataFrame([("user0001x", t, i) for i, t in enumerate(samples)], "userId string, timestamp bigint, event_id bigint")
    return [(r["session_id"], r["t1_ms"], r["n_gps"], r["n_imu"], r["type"], r["imu_hz"]) for r in sessions.build(f, s, gap).orderBy("t0_ms").collect()]


def test_session_limits(spark):
    assert len(sessions_of(spark, [0, 300_000], [])) == 1  # a gap of exactly the limit does not cut
    assert sessions_of(spark, [0, 300_001], []) == []  # two points alone last no time
    assert sessions_of(spark, [0, 59_999], []) == [] and len(sessions_of(spark, [0, 60_000], [])) == 1
    bridged = sessions_of(spark, [0, 500_000], [250_000, 250_020, 250_040])
    assert bridged == [("user0001_0", 500_000, 2, 3, "tracking", 50.0)]
    assert sessions_of(spark, [], [0, 0, 60_000])[0][2:5] == (0, 3, "imu_only")
    far = [k * 250_000 for k in range(400)]  # many buckets, one session
    assert sessions_of(spark, far, [])[0][1:3] == (far[-1], 400)


def test_window_ends_are_closed(spark):
    a = spark.createDataFrame([("u", 0, 180_000)], "k string, anchor bigint, last bigint")
    assert [(r["ts_start"], r["ts_end"]) for r in windows.sliding(a).orderBy("ts_start").collect()] == [(0, 120_000), (60_000, 180_000), (120_000, 240_000)]
    p = spark.createDataFrame([("u", 120_000), ("u", 180_001)], "k string, timestamp bigint")
    got = windows.assign(p, a, ["k"]).groupBy("timestamp").agg(F.sort_array(F.collect_list("ts_start")).alias("w")).orderBy("timestamp").collect()
    assert [r["w"] for r in got] == [[0, 60_000, 120_000], [120_000]]
    one = spark.createDataFrame([("u", 0, 60_000)], "k string, anchor bigint, last bigint")
    assert windows.sliding(one).count() == 1 and windows.sliding(one.withColumn("last", F.lit(59_999))).count() == 0


def fixes(spark, rows):
    return spark.createDataFrame([("w", i, *r) for i, r in enumerate(rows)], "w string, event_id bigint, timestamp bigint, latitude double, longitude double, speed double, accuracy double")


def test_kinematic_edges(spark):
    two = gps.kinematics(fixes(spark, [(0, 46.0, 11.0, 1.0, 5.0), (1000, 46.0, 11.0, 1.0, 5.0)]), ["w"]).first()
    assert two["B_n_gps"] == 2 and two["B_n_valid_pairs"] is None and two["B_speed_mean"] is None
    chips = gps.kinematics(fixes(spark, [(0, 46.0, 11.0, 60.0, 5.0), (1000, 46.0, 11.0, 60.0, 5.0), (2000, 46.0, 11.0, 60.1, 5.0), (3000, 46.0, 11.0, -1.0, 5.0), (3000, 46.0, 11.0, None, 5.0)]), ["w"]).first()
    assert chips["B_n_valid_pairs"] == 4 and chips["B_speed_max"] == 60.0 and chips["B_n_stops"] == 2  # standing still by distance; dt = 0 has no speed
    assert geo  # bearing change is folded
    t = spark.range(1).select(geo.turn(F.lit(350.0), F.lit(10.0)).alias("t")).first()["t"]
    assert t == pytest.approx(20.0)


def test_stops(spark):
    rows = [("w", i, i * 1000, float(i), 0.0 if i in (2, 3, 4, 5) else 5.0) for i in range(9)]
    valid = spark.createDataFrame(rows, "w string, event_id bigint, timestamp bigint, mid double, sv double")
    assert [(r["start"], r["dwell"]) for r in gps.stops(valid, ["w"]).collect()] == [(2.0, 4.0)]
    open_end = spark.createDataFrame(rows[:6], "w string, event_id bigint, timestamp bigint, mid double, sv double")
    assert [(r["start"], r["dwell"]) for r in gps.stops(open_end, ["w"]).collect()] == [(2.0, 3.0)]
    short = spark.createDataFrame([r if r[1] != 6 else ("w", 6, 6000, 4.999, 5.0) for r in rows[:2] + rows[2:6] + rows[6:7]], "w string, event_id bigint, timestamp bigint, mid double, sv double")
    assert gps.stops(short, ["w"]).count() == 0


def test_quality_edges(spark):
    d = gps.quality(fixes(spark, [(0, 46.0, 11.0, 1.0, 20.0), (30_000, 46.0, 11.0, 1.0, 20.0), (60_001, 46.0, 11.0, 1.0, 25.0)]), ["w"]).first()
    assert d["D_has_reliable_gps"] == 1.0 and d["D_n_gaps"] == 1 and d["D_gap_fraction"] == pytest.approx(30.001 / 120)
    unknown = gps.quality(fixes(spark, [(0, 46.0, 11.0, 1.0, None), (1, 46.0, 11.0, 1.0, 5.0)]), ["w"]).first()
    assert unknown["D_acc_mean"] is None and unknown["D_has_reliable_gps"] == 0.0


def cascade_label(spark, **v):
    columns = {"B_speed_mean": None, "B_speed_max": None, "B_stop_frac": None, "B_path_efficiency": None, "B_n_gps": 0} | v
    df = spark.createDataFrame([tuple(float(x) if x is not None else None for x in columns.values())], ", ".join(f"{c} double" for c in columns))
    return labeling.cascade(df).first()["silver_label"]


def test_cascade(spark):
    make = lambda m, x, s, p, **k: cascade_label(spark, B_speed_mean=m, B_speed_max=x, B_stop_frac=s, B_path_efficiency=p, B_n_gps=10, **k)
    assert make(0.10, 0.30, 0.95, 0.30) == "Still"
    assert make(1.20, 2.00, 0.30, 0.80) == "Walk"
    assert make(15, 20, 0.05, 0.90, C_osm_rail_prop=0, C_bus_stops_prop=0) == "Car"
    assert make(3.0, 4.5, 0.4, 0.6) is None
    assert make(15, 20, 0.05, 0.9, C_osm_rail_prop=0.5) == "Train" and make(15, 20, 0.05, 0.9, C_osm_rail_prop=0.5, C_rail_align=0.1) is None
    assert make(6, 9, 0.2, 0.9, C_bus_stops_prop=0.3) == "Bus"
    assert cascade_label(spark) == "Still" and cascade_label(spark, A_lin_mag_mean=0.5, A_acc_x_psd_2_4=0.5) is None
    assert "C_rail_align" not in labeling.silver(spark.createDataFrame([(1.0, 1.0)], "B_n_gps double, C_rail_align double")).columns


def test_shares_and_correction(spark):
    rows = spark.createDataFrame([("Walk",)] * 2 + [("Car",)] * 6 + [("Bus",)] * 2, "m string")
    assert {r["mode"]: r["share"] for r in aggregate.modal_split(rows, "m").collect()} == {"Walk": 0.2, "Bus": 0.2, "Car": 0.6, "Train": 0.0}
    assert {r["share"] for r in aggregate.modal_split(rows.where("m = 'x'"), "m").collect()} == {0.0}
    q = [0.25, 0.25, 0.40, 0.10]
    assert np.allclose(aggregate.quantify(np.array(q), np.eye(4)), q)
    m = np.array([[0.5, 0, 0.5, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    assert np.allclose(aggregate.quantify(np.array([0.25, 0, 0.75, 0]), m), [0.5, 0, 0.5, 0])
    pairs = spark.createDataFrame(list(zip("WWCCC", "WCCCB", strict=True)), "t string, p string").replace({"W": "Walk", "C": "Car", "B": "Bus"})
    got = aggregate.matrix(aggregate.confusion(pairs, "t", "p"))
    assert np.allclose(got.sum(axis=1), 1) and got[1, 1] == 1 and got[3, 3] == 1 and got[0, 0] == 0.5
    km = spark.createDataFrame([("Walk", 10.0), ("Car", 5.0), ("Train", 20.0)], "m string, km double")
    assert aggregate.emissions(km, "m", F.col("km")).agg(F.sum("co2_g")).first()[0] == 1650.0


def test_overlap_labels(spark):
    w = spark.createDataFrame([("u", "s", 0, 100)], "userId string, session_id string, ts_start bigint, ts_end bigint")
    label = lambda spans: intervals.overlap_labels(w, spark.createDataFrame([("u", a, b, m, i) for i, (a, b, m) in enumerate(spans)], "userId string, started_at bigint, finished_at bigint, mode string, seq bigint"), ["userId"], ["session_id"]).first()["label"]
    assert label([(0, 80, "Car")]) == "Car" and label([(0, 79, "Car")]) is None
    assert label([(0, 50, "Car"), (50, 100, "Car")]) is None
    assert label([(10, 95, "Bus"), (5, 90, "Car")]) == "Car"  # equal cover: the earlier start


def test_as_of_asks_the_last_interval_only(spark):
    iv = spark.createDataFrame([("u", 0, 100, "Walk", 0), ("u", 10, 20, "Car", 1)], "userId string, started_at bigint, finished_at bigint, mode string, seq bigint")
    f = spark.createDataFrame([("u", t) for t in (-1, 0, 10, 20, 21)], "userId string, ts_ms bigint")
    assert [r["label"] for r in intervals.as_of(f, iv, ["userId"]).orderBy("ts_ms").collect()] == [None, "Walk", "Car", "Car", None]


def test_proximity_of_missing_layers(spark):
    near = spark.createDataFrame([("w", 50.0), ("w", 10.0)], "w string, d double")
    some = spatial.proximity(near, ["w"], {"bus_stops": "d"}).first()
    assert some["C_bus_stops_prop"] == 0.5 and some["C_osm_subway_prop"] == 0.0 and some["C_osm_motorway_min"] is None and some["C_osm_cycleway_flag"] == 0.0
    none = spatial.proximity(near, ["w"], {}).first()
    assert all(none[c] is None for c in schemas.FEATURES_C)


def test_bootstrap_weighs_whole_clusters(spark):
    """Each replicate's macro F1 is that of all rows repeated by a Poisson number of times for their cluster."""
    draw = random.Random(5)
    rows = [(c, draw.choice("abc"), draw.choice("abcd")) for c in range(12) for _ in range(draw.randint(1, 5))]
    df = spark.createDataFrame(rows, "c bigint, t string, p string")
    got = {r["replicate"]: r["macro_f1"] for r in metrics.bootstrap_f1(df, "c", "t", "p", 40).collect()}
    word = lambda c, r: int(hashlib.md5(f"{c}/{r // 4}/7".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8], 16)
    u = {(c, k): word(c, k - 1) / 2**32 for c in range(12) for k in range(1, 41)}
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    weights = {at: int((x > below).sum()) for at, x in u.items()}
    assert 0.85 < np.mean(list(weights.values())) < 1.15
    for k in range(1, 41):
        many = [(t, p) for c, t, p in rows for _ in range(weights[c, k])]
        classes = {t for t, _ in many}
        f1 = [2 * sum(t == p == x for t, p in many) / (sum(t == x for t, _ in many) + sum(p == x for _, p in many)) for x in classes]
        assert got.get(k) == (pytest.approx(sum(f1) / len(f1)) if f1 else None)


@pytest.mark.parametrize("n", [1, 16, 17, 500, 3000])
def test_nearest_by_boxes_is_exact(n):
    draw = np.random.default_rng(n)
    places, points = (spatial.unit(draw.uniform(-90, 90, k), draw.uniform(-180, 180, k)) for k in (n, 400))
    places = np.concatenate([places, places[: n // 2]])  # repeated places, too
    parts = spatial.boxes(places)
    assert sum(map(len, parts[0])) == len(places) and max(map(len, parts[0])) <= max(16, len(places) ** 0.5)
    assert np.allclose(spatial.chords(points, *parts), ((points[:, None] - places) ** 2).sum(axis=2).min(axis=1), rtol=0, atol=1e-15)


def test_nearest_passes_over_missing_positions(spark):
    points = spark.createDataFrame([(1, 46.0, 11.0), (2, None, 11.0)], "i int, latitude double, longitude double")
    places = spark.createDataFrame([(None, 11.0), (46.0, 11.001)], "lat double, lon double")
    got = {r["i"]: r["dist_m"] for r in spatial.nearest(points, places).collect()}
    assert got[1] == pytest.approx(77.24, abs=0.01) and got[2] is None
    assert all(r["dist_m"] is None for r in spatial.nearest(points, places.where("lat is null")).collect())


def test_nearest_by_cells_agrees(spark, sf):
    from modeflow.plans import trajectory as T

    points = T.fixes(spark, sf).select("event_id", "latitude", "longitude")
    a = {r["event_id"]: r["d"] for r in spatial.nearest(points, T.layer(spark, sf), "d").collect()}
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    b = {r["event_id"]: r["d"] for r in spatial.nearest_by_cells(points, T.layer(spark, sf), "d").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-3) for k in a)


def test_spectra_and_filters():
    fs, t = 50.0, np.arange(0, 60, 1 / 50)
    got = spectral.spectrum(np.sin(2 * np.pi * 3 * t), "x", fs)
    assert got["x_dom_freq"] == pytest.approx(3, abs=0.1) and got["x_psd_2_4"] > 0.99 and got["x_spec_entropy"] < 0.4
    assert set(spectral.spectrum(np.ones(600), "x", fs).values()) == {0.0}
    acc = np.stack([np.sin(2 * np.pi * 5 * t), np.zeros_like(t), np.ones_like(t)], axis=1)
    g, lin = spectral.gravity_and_linear(acc, fs)
    assert np.abs(g[500:-500, 0]).max() < 0.01 and np.allclose(g[:, 2], 1, atol=1e-6) and np.allclose(lin[500:-500, 0], acc[500:-500, 0], atol=0.02) and np.abs(lin[:, 2]).max() < 1e-6
    short, rest = spectral.gravity_and_linear(acc[:10], fs)
    assert np.allclose(short + rest, acc[:10])
    names = set(spectral.inertial(acc, acc * 0.1, fs, mag=acc + 1))
    assert names == set(schemas.FEATURES_A)


def test_constant_signals_are_zero():
    flat = spectral.inertial(np.ones((150, 3)), np.zeros((150, 3)), 50.0)
    assert flat["A_acc_mag_skew"] == flat["A_acc_mag_kurt"] == flat["A_acc_corr_xy"] == flat["A_acc_autocorr_1s"] == 0.0


def test_eigenvalues_in_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ np.diag([3.0, 1.0, 0.2])
    rows = spark.createDataFrame([("u", i, i, *map(float, r)) for i, r in enumerate(x)], "k string, event_id bigint, timestamp bigint, x double, y double, z double")
    got = imu.rotation_invariant(rows, ["k"], ("x", "y", "z"), "A").first()
    want = spectral.invariants(x, "A")
    assert all(got[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items())


def test_sql_and_array_statistics_agree(spark, sf):
    from modeflow.plans import trajectory as T

    s = T.samples(spark, sf)
    sql = {r["userId"]: r for r in imu.statistics(s, ["userId"]).collect()}
    cols = ["A_acc_mag_skew", "A_acc_mag_zcr", "A_gyr_x_iqr", "A_gyr_corr_xz", "A_acc_sma", "A_acc_mag_p75"]
    for r in spectral.features(s, ["userId"], columns=cols).collect():
        assert all(r[c] == pytest.approx(sql[r["userId"]][c], rel=1e-6, abs=1e-9) for c in cols)


def test_unit_and_spikes(spark):
    rows = spark.createDataFrame([("a", 9.8, 0.0, 0.0), ("a", 9.7, 0.0, 0.0), ("b", 1.0, 0.0, 0.0), ("b", 4.1, 0.0, 0.0), ("b", 1.0, 0.0, 0.0)], "u string, acc_x double, acc_y double, acc_z double")
    out = quality.to_g(rows, ["u"])
    assert out.where("u = 'a'").agg(F.max("acc_x")).first()[0] == pytest.approx(9.8 / quality.G)
    assert quality.spike_filter(out).count() == 4


def test_redundancy():
    assert selection.redundant([("aa", "b", 0.97), ("b", "c", 0.99), ("d", "c", 0.5)], {"aa": 0, "b": 1, "c": 1, "d": 0}) == {"b": "aa", "c": "aa"}
    assert selection.prune(["a", "b", "c"], {frozenset("ab"): 0.99, frozenset("bc"): 0.99}) == ["a", "c"]


def test_average_ranks(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert sorted(r["r"] for r in metrics.average_rank(rows, "x", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def haversine(a, b, c, d):
    x, y, u, v = map(math.radians, (a, b, c, d))
    return 2 * 6371000 * math.asin(min(1, math.sqrt(math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2)))


@pytest.mark.parametrize(("lat", "lon"), [(0.0, 10.0), (46.0, 11.0), (51.5, -0.1), (60.0, 25.0), (-72.0, 180.0), (89.99, 0.0)])
def test_near_pairs_at_any_latitude(spark, lat, lon):
    """All pairs within the distance, also near a pole and across the date line."""
    rng = random.Random(int(lat))
    step = 49 / 111_195
    points, places = [], []
    for i in range(150):
        a, b = lat + rng.uniform(-0.005, 0.005), lon + rng.uniform(-0.01, 0.01)
        angle = rng.uniform(0, 2 * math.pi)
        points.append((i, a, (b + 180) % 360 - 180))
        places.append((i, a + step * math.sin(angle), (b + step * math.cos(angle) / math.cos(math.radians(a)) + 180) % 360 - 180))
    want = {(i, j) for i, a, b in points for j, c, d in places if haversine(a, b, c, d) <= 50}
    got = spatial.near_pairs(spark.createDataFrame(points, "i int, latitude double, longitude double"), spark.createDataFrame(places, "j int, lat double, lon double"), 50.0)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted(want) and len(want) >= 140
    nearest = {r["i"]: r["d"] for r in spatial.nearest_by_cells(spark.createDataFrame(points, "i int, latitude double, longitude double"), spark.createDataFrame(places, "j int, lat double, lon double"), "d", 50.0).collect()}
    assert all(nearest[i] == pytest.approx(min(haversine(a, b, c, d) for _, c, d in places), abs=1e-3) for i, a, b in points)


def test_cumulated_in_ranges(spark):
    from modeflow.functions.order import cumulated

    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "x int, n bigint").repartition(7)
    got = cumulated(df, ["x"], ["n"])
    total, want = 0, {}
    for x, n in sorted(rows):
        want[x] = total
        total += n
    assert {r["x"]: r["before_n"] for r in got.collect()} == want


def test_permuted_keeps_the_values(spark):
    from modeflow.operators import models

    df = spark.range(200).selectExpr("id", "id * 2 as v")
    got = models.permuted(df, "v").collect()
    assert sorted(r["v"] for r in got) == [2 * i for i in range(200)] and sum(r["v"] == 2 * r["id"] for r in got) < 20 and [c for c in got[0].asDict()] == ["id", "v"]


def test_as_of_over_many_buckets(spark):
    """The last interval may have started many buckets before the frame."""
    from modeflow.operators import intervals

    hour = intervals.BUCKET_MS
    spans = [("u", 0, 5, 40 * hour, "Bus"), ("u", 1, 9 * hour, 9 * hour + 10, "Car"), ("v", 0, 3 * hour, 90 * hour, "Train"), ("v", 1, 3 * hour, 4 * hour, "Walk")]
    times = [("u", t) for t in (4, 5, 8 * hour, 9 * hour, 9 * hour + 11, 50 * hour)] + [("v", t) for t in (3 * hour, 4 * hour + 1, 80 * hour)] + [(None, 7)]
    got = intervals.as_of(spark.createDataFrame(times, "userId string, ts_ms bigint"), spark.createDataFrame(spans, "userId string, seq bigint, started_at bigint, finished_at bigint, mode string"), ["userId"])
    want = {("u", 4): None, ("u", 5): "Bus", ("u", 8 * hour): "Bus", ("u", 9 * hour): "Car", ("u", 9 * hour + 11): None, ("u", 50 * hour): None, ("v", 3 * hour): "Walk", ("v", 4 * hour + 1): None, ("v", 80 * hour): None, (None, 7): None}
    assert {(r["userId"], r["ts_ms"]): r["label"] for r in got.collect()} == want


def test_one_long_group_is_walked_in_time():
    import time

    import pyarrow as pa

    from modeflow.operators.spectral import sorted_groups

    keys = ["a"] * 3 + ["b"] * 1_000_000 + ["c"] * 2
    table = pa.table([pa.array(keys), pa.array(range(len(keys)))], ["k", "x"])
    began = time.time()
    groups = list(sorted_groups(iter(table.to_batches(max_chunksize=1000)), ["k"]))
    assert [(g.column("k")[0].as_py(), g.num_rows) for g in groups] == [("a", 3), ("b", 1_000_000), ("c", 2)] and time.time() - began < 5


def test_windows_side_by_side_equal_single_ones(spark, monkeypatch):
    """Windows of equally many samples are computed together, whatever their rates; the features are those of each by itself."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 14, 15, 120):
        acc, gyr = rng.normal(size=(2, 6, n, 3))
        gyr[2], acc[3] = 0.0, 1.0
        fs = np.linspace(20.0, 60.0, 6) if n < spectral.SETTLES else 50.0
        many = spectral.inertial(acc, gyr, fs, mag=acc + 1)
        for i in range(6):
            one = spectral.inertial(acc[i], gyr[i], float(np.broadcast_to(fs, 6)[i]), mag=acc[i] + 1)
            assert one.keys() == many.keys() and all(np.broadcast_to(many[k], 6)[i] == pytest.approx(x, rel=1e-7, abs=1e-9, nan_ok=True) for k, x in one.items())
    calls = spark.sparkContext.accumulator(0)
    real = spectral.inertial
    monkeypatch.setattr(spectral, "inertial", lambda *a, **b: calls.add(1) or real(*a, **b))
    rows = spark.range(3000).select((F.col("id") % 1000).alias("w"), F.col("id").alias("event_id"), F.col("id").alias("timestamp"), *[F.sin(F.col("id") * k).alias(c) for k, c in enumerate(("acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z"), 1)])
    assert spectral.features(rows, ["w"]).count() == 1000 and calls.value <= 64
