"""Frames counted by arithmetic, upserts by month, and windows from bounded state."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modeflow.operators import intervals, metrics
from modeflow.streaming import anchored_state, ingest, merging
from modeflow.streaming.anchored_state import Open, advanced

# ---------------------------------------------------------------- frames


def as_of(rows, ts):
    """The label at a time: of the interval that started last (then of the last seq), if it still lasts."""
    started = [r for r in rows if r[1] <= ts]
    last = max(started, key=lambda r: (r[1], r[3]), default=None)
    return last[4] if last and ts <= last[2] else None


def made(rng, users, n, span, hour=3_600_000):
    rows = []
    for u in users:
        for i in range(rng.randrange(n)):
            a = rng.randrange(0, span, 500) + (rng.randrange(3) * 30 * hour if rng.random() < 0.2 else 0)
            rows.append((u, a, a + rng.choice([0, 1, 999, 1000, 5000, 90_000]), i, rng.choice(["A", "B", None])))
    return rows


SCHEMA = "userId string, started_at bigint, finished_at bigint, seq bigint, mode string"


def listed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as a", "2 as b", "3 as n", "'x' as value", "4 as o").repartition(4)


@pytest.mark.parametrize("seed", range(4))
def test_cells_equal_frames(spark, seed, monkeypatch):
    """Against a loop over all frames; hours apart, so that states are carried over many buckets."""
    rng = random.Random(seed)
    users = ["u", "v", "w", "x"]
    truth, pred = made(rng, users[:3], 12, 200_000), made(rng, users[1:], 12, 200_000)
    want = Counter()
    for u in users:
        g, p = [r for r in truth if r[0] == u], [r for r in pred if r[0] == u]
        if g or p:
            first, last = min(r[1] for r in g + p), max(r[2] for r in g + p)
            for ts in range(first, last + 1, 1000):
                key = (u, as_of(g, ts), as_of(p, ts))
                want[key] += key[1:] != (None, None)
    want = {k: n for k, n in want.items() if n}
    got = {(r["userId"], r["t"], r["p"]): r["n"] for r in intervals.frame_cells(listed(spark, truth), listed(spark, pred), ["userId"]).collect()}
    assert got == want
    spans = [(u, 1000 * k, 1000 * k + 700 * k) for u in users for k in (3, 20, 150)]
    want = Counter()
    for u, a, b in spans:
        for ts in range(a, b + 1, 1000):
            key = (u, as_of([r for r in truth if r[0] == u], ts), as_of([r for r in pred if r[0] == u], ts))
            want[key] += key[1:] != (None, None)
    df = spark.createDataFrame(spans, "userId string, t0_ms bigint, t1_ms bigint")
    got = {(r["userId"], r["t"], r["p"]): r["n"] for r in intervals.frame_cells(listed(spark, truth), listed(spark, pred), ["userId"], spans=df).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_a_long_timeline_makes_few_rows(spark):
    """Ten years of one user: rows follow the intervals."""
    year = 365 * 86_400_000
    rows = [("u", k * year, k * year + year // 2, k, "A" if k % 2 else "B") for k in range(10)]
    parts = intervals.pieces({"t": listed(spark, rows).withColumn("value", F.col("mode"))}, ["userId"])
    assert parts.count() <= 20
    cells = intervals.frame_cells(listed(spark, rows), listed(spark, rows), ["userId"])
    assert {(r["t"], r["p"]): r["n"] for r in cells.collect()} == {(m, m): 5 * (year // 2 // 1000 + 1) for m in "AB"}
    assert metrics.by_class(cells, "t", "p", "n").where("f1 < 1").count() == 0 and metrics.kappa(cells, "t", "p", "n").first()["kappa"] == 1.0
    assert intervals.frame_cells(listed(spark, []), listed(spark, []), ["userId"]).count() == 0


# ---------------------------------------------------------------- upserts by month

DAY = 86_400_000
ROWS = "userId string, timestamp bigint, v string"


def month_ms(m, day=1):
    return (m * 31 + day) * DAY


def folders(target):
    return sorted(f"{p.parent.name}/{p.name}" for p in (target / "data").glob("b=*/upsert_month=*"))


def stand(spark, target):
    schema = spark.createDataFrame([], ROWS).schema
    return sorted((r["userId"], r["timestamp"], r["v"]) for r in merging.table(spark, str(target), schema).collect())


def plain(*batches):
    held = {}
    for rows in batches:
        held |= {(u, t): v for u, t, v in rows}
    return sorted((u, t, v) for (u, t), v in held.items())


FIRST = [("a", month_ms(0), "1"), ("a", month_ms(0), "2"), ("b", month_ms(1), "3"), ("a", month_ms(2), "4")]
SECOND = [("b", month_ms(1), "5"), ("c", month_ms(1, 9), "6"), ("c", month_ms(1, 9), "7")]
THIRD = [("d", month_ms(3), "8"), ("a", month_ms(0), "9")]


def batch(spark, rows):
    return spark.createDataFrame(rows, ROWS).coalesce(1)


def test_a_batch_touches_its_months_only(spark, tmp_path, monkeypatch):
    target, keys = tmp_path / "t", ["userId", "timestamp"]
    assert merging.merge(batch(spark, FIRST), 0, str(target), keys) == {}
    assert stand(spark, target) == plain(FIRST)
    read = []
    pieces = merging.pieces
    monkeypatch.setattr(merging, "pieces", lambda s, t, months, schema: read.append(dict(months)) or pieces(s, t, months, schema))
    before = {p: p.stat().st_mtime_ns for p in target.glob("data/**/*.parquet")}
    assert merging.merge(batch(spark, SECOND), 1, str(target), keys) == {"1970-02": 0} == read[0]
    assert {p: p.stat().st_mtime_ns for p in before} == before  # nothing is rewritten
    assert folders(target) == ["b=0/upsert_month=1970-01", "b=0/upsert_month=1970-02", "b=0/upsert_month=1970-03", "b=1/upsert_month=1970-02"]
    monkeypatch.undo()
    assert stand(spark, target) == plain(FIRST, SECOND)
    merging.merge(batch(spark, THIRD), 2, str(target), keys, kept=1)
    assert stand(spark, target) == plain(FIRST, SECOND, THIRD)
    # January and February of the first batch, and two manifests, are gone
    assert folders(target) == ["b=0/upsert_month=1970-03", "b=1/upsert_month=1970-02", "b=2/upsert_month=1970-01", "b=2/upsert_month=1970-04"]
    assert merging.batches(spark, str(target)) == [2]
    schema = batch(spark, []).schema
    assert merging.table(spark, str(target), schema, "1970-02", "1970-03").count() == 3


@pytest.mark.parametrize("step", ["write", "commit", "clean"])
def test_a_replay_after_a_kill_gives_the_same(spark, tmp_path, monkeypatch, step):
    target, keys = tmp_path / "t", ["userId", "timestamp"]
    merging.merge(batch(spark, FIRST), 0, str(target), keys, kept=1)

    class Killed(Exception):
        pass

    def kill(*_, **__):
        raise Killed

    with monkeypatch.context() as m:
        if step == "write":  # the pieces are written in part
            (target / "data" / "b=1" / "upsert_month=1970-02").mkdir(parents=True)
            batch(spark, [("z", month_ms(1), "part")]).write.mode("overwrite").parquet(str(target / "data" / "b=1" / "upsert_month=1970-02"))
            m.setattr(merging, "appended", kill)
        else:
            m.setattr(merging, step, kill)
        with pytest.raises(Killed):
            merging.merge(batch(spark, SECOND), 1, str(target), keys, kept=1)
    assert stand(spark, target) == plain(FIRST, *([SECOND] if step == "clean" else []))  # a reader sees one state or the other
    merging.merge(batch(spark, SECOND), 1, str(target), keys, kept=1)
    assert stand(spark, target) == plain(FIRST, SECOND)
    merging.merge(batch(spark, THIRD), 2, str(target), keys, kept=1)
    assert stand(spark, target) == plain(FIRST, SECOND, THIRD)


def test_streamed_upsert_by_month(spark, tmp_path):
    src, target = str(tmp_path / "src"), tmp_path / "t"
    schema = batch(spark, []).schema
    for rows in (FIRST, SECOND, THIRD):
        batch(spark, rows).write.mode("append").parquet(src)
        merging.upsert_by_month(ingest.read_new(spark, src, schema), str(target), ["userId", "timestamp"], str(tmp_path / "c")).awaitTermination()
    assert stand(spark, target) == plain(FIRST, SECOND, THIRD)
    assert json.loads((target / "manifests" / "000000002.json").read_text()) == {"1970-01": 2, "1970-02": 1, "1970-03": 0, "1970-04": 2}


def test_upsert_edges(spark, tmp_path):
    target = tmp_path / "t"
    with pytest.raises(ValueError, match="must be a key"):
        merging.merge(batch(spark, FIRST), 0, str(target), ["userId"])
    merging.merge(batch(spark, []), 0, str(target), ["userId", "timestamp"])
    assert stand(spark, target) == []
    merging.merge(batch(spark, [("a", None, "x"), (None, None, "y"), (None, None, "z")]), 1, str(target), ["userId", "timestamp"])
    got = merging.table(spark, str(target), batch(spark, []).schema).collect()
    assert sorted((str(r["userId"]), r["v"]) for r in got) == [("None", "z"), ("a", "x")]
    assert merging.merge(batch(spark, FIRST), 1, str(target), ["userId", "timestamp"]) == {}  # committed before: nothing to do


def test_labels_look_back(spark, tmp_path):
    """A corrected label within the look-back replaces the old one; labels before it, and their months, are not touched."""
    schema = "userId string, started_at bigint, finished_at bigint, mode string"
    target = str(tmp_path / "labels")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    hour, now = 3_600_000, 400 * DAY
    first = [("u", k * 20 * DAY, k * 20 * DAY + hour, "Car") for k in range(20)]
    merging.refresh_labels(frame(first), target, 0, now, 10_000)
    changed = [("u", s, e, "Bus") for _, s, e, _ in first] + [("v", now - DAY, now, "Walk"), ("v", now + 5 * DAY, now + 6 * DAY, "Walk")]
    read = merging.refresh_labels(frame(changed), target, 1, now)
    assert 0 < len(read) <= 3 and set(read.values()) == {0}
    got = {(r["userId"], r["started_at"]): r["mode"] for r in merging.table(spark, target, frame([]).schema).collect()}
    assert got == {("u", s): "Bus" if e >= now - 60 * DAY else "Car" for _, s, e, _ in first} | {("v", now - DAY): "Walk"}
    assert merging.refresh_labels(frame(changed), target, 2, now, floor_ms=now + DAY) == {}
    frame(changed).coalesce(1).write.parquet(str(tmp_path / "src"))
    merging.streamed_labels(ingest.read_new(spark, str(tmp_path / "src"), frame([]).schema), str(tmp_path / "again"), str(tmp_path / "c"), now).awaitTermination()
    assert merging.table(spark, str(tmp_path / "again"), frame([]).schema).count() == sum(v == "Bus" for v in got.values()) + 1


# ---------------------------------------------------------------- windows from bounded state


def whole(points, gap, size, step):
    """All windows of all sessions of one user's points (t, v), in one pass."""
    out, points = [], sorted(points)
    runs = []
    for t, v in points:
        if runs and t - runs[-1][-1][0] <= gap:
            runs[-1].append((t, v))
        else:
            runs.append([(t, v)])
    for run in runs:
        a, last, k = run[0][0], run[-1][0], 0
        while a + k * step + size <= last + step:
            vs = [v for t, v in run if a + k * step <= t <= a + k * step + size and not math.isnan(v)]
            out.append((a, a + k * step, a + k * step + size, len(vs), sum(vs) / len(vs) if vs else None))
            k += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_windows_settle_as_in_one_pass(seed):
    """Points come late and in any order within the lateness, the watermark moves on by steps."""
    rng = random.Random(seed)
    gap, size, step, late = rng.choice([(50, 20, 10, 40), (15, 20, 10, 30), (100, 20, 20, 5), (30, 12, 7, 90)])
    times = sorted(rng.randrange(4000) for _ in range(rng.randrange(1, 400)))
    points = [(t, rng.choice([1.0, 2.5, math.nan])) for t in times]
    arriving = sorted(points, key=lambda p: p[0] + rng.uniform(0, late))
    t, v, held, mark, got, most = np.zeros(0, np.int64), np.zeros(0), None, -1, [], 0
    top = 0
    for i in range(0, len(arriving), 7):
        part = arriving[i : i + 7]
        t, v = np.concatenate([t, [p[0] for p in part]]).astype(np.int64), np.concatenate([v, [p[1] for p in part]])
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        top = max(top, *(p[0] for p in part))
        out, stay, held, _ = advanced(t, v, held, mark, gap, size, step)
        got += out
        t, v = t[stay], v[stay]
        mark = max(mark, min(top - late - 1, min((p[0] for p in arriving[i + 7 :]), default=top) - 1))
        out, stay, held, again = advanced(t, v, held, mark, gap, size, step)
        got += out
        t, v = t[stay], v[stay]
        assert again is None or again > mark
        most = max(most, int((t < mark - size - step - gap).sum()))
    out, stay, held, again = advanced(t, v, held, 10_000, gap, size, step)
    got += out
    assert not stay.any() and held is None and again is None and most == 0
    assert sorted(got, key=str) == sorted(whole(points, gap, size, step), key=str)


def test_a_long_session_keeps_few_points():
    """A session of a day, a point a second: what stays is the last window and the time that rows may be late."""
    t, v, held, most = np.zeros(0, np.int64), np.zeros(0), None, 0
    for now in range(0, 86_400, 600):
        t, v = np.r_[t, np.arange(now, now + 600)], np.r_[v, np.ones(600)]
        out, stay, held, _ = advanced(t, v, held, now - 300, 300, 120, 60)
        t, v = t[stay], v[stay]
        most = max(most, len(t))
    assert most <= 600 + 300 + 120 + 60 and held == Open(0, held.next, held.last) and held.next > 1400


def test_state_processor_equals_batch(spark, tmp_path):
    """Shuffled late input through the stream, against all sessions in one pass; a restart in between."""
    rng = random.Random(8)
    base = 1_700_000_000
    points = {u: [(base + t, rng.choice([1.0, 3.0, None])) for t in sorted(rng.sample(range(6000), 150))] for u in ("u", "v")}
    rows = [(u, t, x) for u, ps in points.items() for t, x in ps]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 500))
    schema = "userId string, s bigint, speed double"
    src = str(tmp_path / "p")
    write = lambda part: spark.createDataFrame(part, schema).select("userId", F.timestamp_seconds("s").alias("time"), "speed").coalesce(1).write.mode("append").parquet(src)
    shape = spark.createDataFrame([], schema).select("userId", F.timestamp_seconds("s").alias("time"), "speed").schema

    def run():
        stream = anchored_state.anchored_windows(ingest.read_new(spark, src, shape, files=1), 120, "600 seconds")
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for i in range(0, len(rows), 60):
        write(rows[i : i + 60])
        if i in (120, 240):
            run()
    write([("end", base + 90_000, 1.0)])
    write([("end", base + 190_000, 1.0)])
    run()
    got = sorted(((r["userId"], r["a"], r["b"], r["c"], r["n"], r["speed"]) for r in spark.read.parquet(str(tmp_path / "out")).where("userId <> 'end'").select("userId", *[F.unix_seconds(c).alias(n) for c, n in (("t0", "a"), ("ts_start", "b"), ("ts_end", "c"))], "n", "speed").collect()), key=str)
    want = sorted(((u, *w) for u, ps in points.items() for w in whole([(t, math.nan if x is None else x) for t, x in ps], 120, 120, 60)), key=str)
    assert len(want) > 30 and [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == [pytest.approx(w[5]) if w[5] is not None else None for w in want]
