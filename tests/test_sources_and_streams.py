"""Readers of foreign formats, incremental tables, models and streams."""

import json

import pytest
from pyspark.sql import functions as F

from modeflow import schemas
from modeflow.operators import models
from modeflow.sources import external, tables
from modeflow.streaming import ingest


def test_transit_feed(spark, tmp_path):
    for name, text in {"stops": "stop_id,stop_name,stop_lat,stop_lon\ns1,A,46.1,11.1\ns2,B,bad,11.2\n", "stop_times": "trip_id,stop_id\nt1,s1\nt2,s1\nt1,s2\n", "trips": "trip_id,route_id\nt1,r1\nt2,r2\n", "routes": "route_id,route_type\nr1,3\nr2,3\n"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    t = {n: external.gtfs(spark, str(tmp_path), n) for n in ("stops", "stop_times", "trips", "routes")}
    assert [tuple(r) for r in external.served_stops(t["stops"], t["stop_times"], t["trips"], t["routes"]).collect()] == [("s1", 46.1, 11.1, "3")]


def test_map_features(spark):
    shapes = [("Point", [11.0, 46.0]), ("LineString", [[11.0, 46.0], [11.1, 46.1]]), ("MultiLineString", [[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]]])]
    lines = ["\x1e" + json.dumps({"id": k, "geometry": {"type": k, "coordinates": c}, "properties": {}}) for k, c in shapes]
    got = external.map_features(spark.createDataFrame([(x,) for x in lines], "value string")).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"Point": 1, "LineString": 2, "MultiLineString": 3}


def test_archive(spark, tmp_path):
    folder = tmp_path / "010" / "Trajectory"
    folder.mkdir(parents=True)
    (folder / "a.plt").write_text("head\n" * 6 + "39.9,116.3,0,492,39744.5,2008-10-23,12:00:00\n")
    (tmp_path / "010" / "labels.txt").write_text("Start\tEnd\tMode\n2008/10/23 12:00:00\t2008/10/23 12:10:00\ttaxi\n2008/10/23 12:00:00\t2008/10/23 12:10:00\tboat\n")
    p = external.archive_points(external.text_with_path(spark, str(folder / "*.plt"))).collect()
    assert [tuple(r) for r in p] == [("010", (39744 - 25569) * 86_400_000 + 43_200_000, 39.9, 116.3)]
    label = external.archive_labels(external.text_with_path(spark, str(tmp_path / "010" / "labels.txt"))).collect()
    assert [(r["mode"], r["finished_at"] - r["started_at"]) for r in label] == [("Car", 600_000)]


def test_label_documents(spark):
    at = {"started_at": "2026-05-19T10:00:00.000+02:00", "finished_at": "2026-05-19T10:05:00.000+02:00"}
    docs = [at | {"mode_key": "car"}, at | {"mode_key": "boat"}, at | {"purpose_key": "home"}, at, {"mode_key": "car", "started_at": "x", "finished_at": "y"}]
    df = spark.createDataFrame([("u", json.dumps(d)) for d in docs], "userId string, attributes string")
    got = external.label_documents(df, "attributes", {"car": "Car"}).orderBy("mode").collect()
    assert [(r["mode"], r["mode_key"], r["started_at"]) for r in got] == [("Car", "car", 1_779_177_600_000), ("Still", "stay_home", 1_779_177_600_000)]


def test_local_day_end_over_clock_change(spark):
    ends = spark.createDataFrame([("2026-03-28",), ("2026-03-29",)], "d string").select(external.local_day_end(F.to_date("d")).alias("e")).collect()
    assert ends[1]["e"] - ends[0]["e"] == 23 * 3_600_000


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("u", 5, 46.0), ("u", 1, 46.5), ("v", 3, 47.0)], "userId string, timestamp bigint, latitude double")
    tables.write(rows, str(tmp_path / "gps"), schemas.GPS)
    got = tables.gps(spark, str(tmp_path / "gps"), since=2)
    assert [(r["userId"], r["timestamp"], r["accuracy"]) for r in got.collect()] == [("u", 5, None), ("v", 3, None)]
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,2)]" in got._jdf.queryExecution().toString()
    assert tables.last_time(spark, str(tmp_path / "gps")) == 5
    tables.write_by_month(rows, str(tmp_path / "months"))
    assert spark.read.parquet(str(tmp_path / "months")).select("year_month").distinct().collect()[0][0] in ("1970-01", 197001)
    spark.createDataFrame([(0, 1.0), (9_000_000, 2.0)], "timestamp bigint, acc_x double").coalesce(1).write.parquet(str(tmp_path / "imu"))
    import glob
    import os

    os.makedirs(tmp_path / "users")
    os.rename(glob.glob(str(tmp_path / "imu" / "*.parquet"))[0], tmp_path / "users" / "u7.parquet")
    assert [r["userId"] for r in tables.imu(spark, str(tmp_path / "users"), "u7", 100, 200).collect()] == ["u7"]
    assert tables.imu(spark, str(tmp_path / "users"), "u8").count() == 0


def test_append_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, t bigint, v string")
    new = spark.createDataFrame([("a", 1, "y"), ("a", 1, "z"), ("c", 1, "w")], "k string, t bigint, v string").coalesce(1)
    assert {r["k"]: r["v"] for r in tables.appended(old, new, ["k", "t"]).collect()} == {"a": "z", "b": "x", "c": "w"}


def test_streamed_upsert_and_sessions_equal_batch(spark, sf, tmp_path):
    src, ev = str(tmp_path / "src"), spark.read.parquet(f"{sf}/events.parquet").where("user_id < 4")
    rows = ev.select(F.col("user_id").cast("string").alias("userId"), F.col("ts").cast("timestamp").alias("time"), (F.col("event_id") % 3 != 0).alias("is_fix"), F.col("value").alias("speed"), "event_id")
    rows.repartition(4).write.parquet(src)
    stream = ingest.read_new(spark, src, rows.schema, files=1)
    ingest.upsert(stream, str(tmp_path / "table"), ["event_id"], str(tmp_path / "c1")).awaitTermination()
    assert ingest.current(spark, str(tmp_path / "table")).count() == rows.count()
    # a last far row moves the watermark past all sessions
    end = spark.createDataFrame([("end", "2030-01-01 00:00:00", True, 0.0, -1), ("end", "2031-01-01 00:00:00", True, 0.0, -2)], "userId string, t string, is_fix boolean, speed double, event_id bigint").select("userId", F.col("t").cast("timestamp").alias("time"), "is_fix", "speed", "event_id")
    one = str(tmp_path / "one")
    rows.coalesce(1).write.parquet(one)
    end.where("event_id = -1").coalesce(1).write.mode("append").parquet(one)
    end.where("event_id = -2").coalesce(1).write.mode("append").parquet(one)
    q = ingest.sessions(ingest.read_new(spark, one, rows.schema, files=1), "36000 seconds").writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["userId"], r["t0"], r["t1"], r["n_gps"], r["n_imu"]) for r in spark.table("streamed").where("userId <> 'end'").collect()}
    batch = rows.groupBy("userId", F.session_window("time", "36000 seconds")).agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.count_if("is_fix").alias("g"), F.count_if(~F.col("is_fix")).alias("i"))
    assert got == {(r["userId"], r["t0"], r["t1"], r["g"], r["i"]) for r in batch.collect()}
    marks = ingest.cursors(rows.select("userId", F.unix_millis("time").alias("timestamp")))
    assert ingest.since(marks, 1000) == marks.agg(F.min("last_ms")).first()[0] - 1000


def test_classifier(spark, tmp_path):
    rows = [(float(i % 7) / 50 + base, float(base > 0), m) for m, base in (("Still", 0.0), ("Walk", 2.0), ("Car", 15.0)) for i in range(40)]
    df = spark.createDataFrame(rows, "B_a double, B_b double, label string")
    model = models.Hierarchical(["B_a", "B_b"], ["Still", "Walk", "Car"]).fit(df, "label", numTrees=5, maxDepth=4)
    out = model.predict(model.probabilities(df).drop("__moves", "__which").withColumn("s", F.col("p_Still") + F.col("p_Walk") + F.col("p_Car")).select("B_a", "B_b", "label", "s"))
    assert out.where("predicted <> label").count() == 0 and out.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-9
    assert model.predict(df, "hard").where("predicted <> label").count() == 0
    assert model.predict(df, forced_moving=True).where("predicted = 'Still'").count() == 0
    path = models.save(model, spark, str(tmp_path), "m", f1=1.0)
    assert models.versions(spark, str(tmp_path), "m")[-1].endswith(path.rpartition("/")[2])
    assert models.load(spark, path).predict(df).where("predicted <> label").count() == 0


def test_confident_weights(spark):
    rows = [("A", 0.9, 0.1)] * 5 + [("B", 0.1, 0.9)] * 5 + [("A", 0.05, 0.95)]
    df = spark.createDataFrame(rows, "label string, p_A double, p_B double")
    w = models.confident_weights(df, "label", ["A", "B"]).groupBy("weight").count().collect()
    assert {r["weight"]: r["count"] for r in w} == {1.0: 10, 0.1: 1}


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_random_sessions(spark, share):
    from modeflow.operators import splits

    df = spark.createDataFrame([(f"s{i % 10}", i) for i in range(100)], "session_id string, ts_start bigint")
    assert splits.random_sessions(df, share).where("split = 'test'").select("session_id").distinct().count() == int(10 * share)


def test_streamed_coherence_equals_batch(spark, tmp_path):
    import random

    from modeflow.operators.smoothing import coherence

    rng, src = random.Random(4), str(tmp_path / "w")
    rows = [("u", f"s{s}", 1_700_000_000 + s * 20_000 + 60 * i, rng.choice(["Bus", "Car", "Train", "Still"])) for s in range(5) for i in range(rng.randrange(3, 25))]
    df = spark.createDataFrame(rows, "userId string, session_id string, t bigint, mode string").select("userId", "session_id", F.timestamp_seconds("t").alias("ts_start"), "mode")
    df.coalesce(1).write.parquet(src)
    for day in ("2030-01-01", "2031-01-01", "2032-01-01"):  # later sessions move the watermark on
        spark.createDataFrame([("u", "end", day, "Car")], "userId string, session_id string, d string, mode string").select("userId", "session_id", F.to_timestamp("d").alias("ts_start"), "mode").coalesce(1).write.mode("append").parquet(src)
    q = ingest.healed(ingest.read_new(spark, src, df.schema, files=1)).writeStream.format("memory").queryName("healed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["session_id"], r["ts_start"], r["coherent"]) for r in spark.table("healed").where("session_id <> 'end'").collect()}
    assert got == {(r["session_id"], r["ts_start"], r["coherent"]) for r in coherence(df, ["userId", "session_id"], mode="mode").collect()}


def test_streamed_windows_and_first_rows(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 2")
    rows = ev.select(F.col("user_id").cast("string").alias("userId"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("speed"), "event_id")
    rows.write.parquet(str(tmp_path / "p"))
    rows.write.mode("append").parquet(str(tmp_path / "p"))
    once = ingest.deduplicated(ingest.read_new(spark, str(tmp_path / "p"), rows.schema), ["event_id"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == rows.count()
    w = ingest.windowed(ingest.read_new(spark, str(tmp_path / "p"), rows.schema), "1 second", "1 day", "12 hours").writeStream.format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "b")).outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination()
    batch = {(r["userId"], r["s"]): r["n"] for r in rows.union(rows).groupBy("userId", F.window("time", "1 day", "12 hours")).agg(F.count(F.lit(1)).alias("n")).select("userId", F.col("window.start").alias("s"), "n").collect()}
    streamed = {(r["userId"], r["ts_start"]): r["n"] for r in spark.table("windowed").collect()}
    assert streamed and all(batch[k] == n for k, n in streamed.items())


def test_upsert_keeps_the_last_row_in_every_batch(spark, tmp_path):
    """Repeated keys in the first batch; a replay reads the version below its own; old versions go."""
    schema, src, target = "k string, v string", str(tmp_path / "src"), str(tmp_path / "table")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda checkpoint: ingest.upsert(ingest.read_new(spark, src, spark.createDataFrame([], schema).schema), target, ["k"], str(tmp_path / checkpoint)).awaitTermination()
    table = lambda: {r["k"]: r["v"] for r in ingest.current(spark, target).collect()}
    write([("a", "first"), ("a", "mid"), ("a", "last"), ("b", "x")])
    run("c")
    assert table() == {"a": "last", "b": "x"}
    write([("b", "y"), ("b", "z"), ("c", "w")])
    run("c")
    assert table() == {"a": "last", "b": "z", "c": "w"}
    assert {r["k"]: r["v"] for r in ingest.current(spark, target, below=1).collect()} == {"a": "last", "b": "x"}
    import shutil

    for kind in ("commits", "offsets"):  # the second batch is replayed
        for name in ("1", ".1.crc"):
            if kind == "commits" and (tmp_path / "c" / kind / name).exists():
                (tmp_path / "c" / kind / name).unlink()
    shutil.rmtree(tmp_path / "table" / "v000000001")
    run("c")
    assert table() == {"a": "last", "b": "z", "c": "w"}
    write([("d", "n")])
    run("c")
    assert table() == {"a": "last", "b": "z", "c": "w", "d": "n"} and len(ingest.complete(spark, target)) == 2


def test_streamed_windows_are_anchored_as_in_batch(spark, tmp_path):
    """Rows in another order, a gap, points on both ends of a window, unknown speeds; the last session is still open."""
    from modeflow.operators import windows

    base = 1_700_000_000_000
    at = [0, 60, 119, 120, 180, 250, 365, 1000, 1001, 1121, 1300]
    rows = [(u, base + (s + 7 * i) * 1000, None if s == 119 else float(s)) for i, u in enumerate(("u", "v")) for s in at] + [("u", base + 9 * 86_400_000, 1.0)]
    df = spark.createDataFrame(rows, "userId string, ms bigint, speed double").withColumn("time", F.timestamp_millis("ms"))
    df.orderBy(F.desc("ms")).coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = ingest.anchored(ingest.read_new(spark, str(tmp_path / "p"), df.schema)).writeStream.format("memory").queryName("anchored").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    got = {(r["userId"], r["a"], r["b"]): (r["n"], r["speed"]) for r in spark.table("anchored").select("userId", F.unix_millis("ts_start").alias("a"), F.unix_millis("ts_end").alias("b"), "n", "speed").collect()}
    parts = df.where(F.col("ms") < base + 86_400_000).withColumn("s", (F.col("ms") % 86_400_000 - base % 86_400_000 >= 900_000).cast("int"))
    anchors = windows.anchors(parts, ["userId", "s"], "ms")
    full = windows.sliding(anchors).select("userId", "ts_start", "ts_end")
    held = windows.assign(parts, anchors, ["userId", "s"], time="ms").groupBy("userId", "ts_start").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("speed"))
    batch = {(r["userId"], r["ts_start"], r["ts_end"]): (r["n"] or 0, r["speed"]) for r in full.join(held, ["userId", "ts_start"], "left").collect()}
    assert len(got) == len(batch) > 10 and got == batch
