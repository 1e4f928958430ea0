"""Measures summed in tasks, against plain loops: neighbours, ranks by null masks, weighted replicates, dealt columns, footers."""

import math
import random
from hashlib import md5

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from modeflow.operators import evaluation, metrics, models, selection
from modeflow.sources import tables

# ---------------------------------------------------------------- nearest neighbours


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def information(rows, k=3):
    known = [(x, y) for x, y in rows if x is not None and not math.isnan(x) and y is not None]
    sizes = {y: sum(c == y for _, c in known) for _, y in known}
    known = [(x, y) for x, y in known if sizes[y] > 1]
    if not known:
        return 0, None, None
    total = 0.0
    for i, (x, y) in enumerate(known):
        kk = min(k, sizes[y] - 1)
        r = sorted(abs(x - a) for j, (a, b) in enumerate(known) if b == y and j != i)[kk - 1]
        m = sum(abs(x - a) < r or abs(x - a) == r == 0 for a, _ in known)
        total += psi(kk) - psi(sizes[y]) - psi(m)
    estimate = psi(len(known)) + total / len(known)
    return len(known), estimate, max(0.0, estimate)


@pytest.mark.parametrize("k,pool,n", [(3, 8, 200), (3, 10_000, 300), (1, 50, 120), (5, 400, 40), (3, 1, 30)])
def test_neighbours_against_all_pairs(spark, k, pool, n):
    rng = random.Random(k * pool)
    rows = [(float(rng.randrange(pool) + 5 * (c == "b")), c) for c in (rng.choice("aabbbc") for _ in range(n))]
    rows += [(1.0, "lone"), (2.0, "two"), (7.0, "two"), (None, "a"), (1.0, None), (float("nan"), "b"), (-0.0, "a"), (0.0, "a")]
    df = spark.createDataFrame(rows, "x double, y string").selectExpr("x", "y", "1 as c", "2 as r", "'z' as v", "3 as kind").repartition(5)
    got = metrics.knn_information(df, "x", "y", k).first()
    want = information(rows, k)
    assert got["n"] == want[0] and got["estimate"] == pytest.approx(want[1], abs=1e-9) and got["mi"] == pytest.approx(want[2], abs=1e-9)


@pytest.mark.parametrize("k,pool,n,most", [(3, 10_000, 300, 16), (3, 60, 300, 9), (2, 400, 200, 5), (1, 90, 150, 4), (3, 10_000, 120, 1)])
def test_neighbours_by_ranges(spark, monkeypatch, k, pool, n, most):
    """Ranges of few values, some with fewer of a class than k and some that a rare class's distances pass over; no global order is made."""
    monkeypatch.setattr(metrics, "RANGE_VALUES", most, raising=False)
    monkeypatch.setattr(metrics, "cumulated", lambda *_: pytest.fail("all rows were put in one order"))
    rng = random.Random(k * pool + most)
    rows = [(rng.randrange(pool) / 4, rng.choice("aabbbc")) for _ in range(n)] + [(0.0, "far"), (pool / 4, "far"), (3.0, "lone"), (-1.0, "a"), (-1.0, "a")]
    got = metrics.knn_information(spark.createDataFrame(rows, "x double, y string").repartition(3), "x", "y", k).first()
    want = information(rows, k)
    assert got["n"] == want[0] and got["estimate"] == pytest.approx(want[1], abs=1e-9)


def test_neighbours_of_nothing(spark):
    assert tuple(metrics.knn_information(spark.createDataFrame([(1.0, "a")], "x double, y string"), "x", "y").first())[:2] == (0, None)


def test_rank_correlations_count_equal_rows_once(spark, monkeypatch):
    """A thousand rows of at most 18 distinct ones, some with nulls: cells are made for distinct rows only."""
    seen, cells = [], selection.unpivot
    monkeypatch.setattr(selection, "unpivot", lambda df, *more: seen.append(df.count()) or cells(df, *more))
    df = spark.range(1000).selectExpr("cast(id % 3 as double) as a", "case when id % 2 = 0 or id % 3 > 0 then cast(least(id % 9, 8) as double) end as b", "case when id % 3 > 0 then cast(id % 3 * -1 as double) end as c")
    got = {(r["a"], r["b"]): (r["n"], pytest.approx(r["rho"], abs=1e-12)) for r in selection.spearman_pairs(df, ["a", "b", "c"]).collect()}
    assert seen and max(seen) <= 18
    assert got == {(r["a"], r["b"]): (r["n"], r["rho"]) for r in selection.spearman_each(df, [("a", "b"), ("a", "c"), ("b", "c")]).collect()}


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 60).select(metrics.digamma(F.col("id"))).collect()]
    assert got == [pytest.approx(psi(n), abs=1e-10) for n in range(1, 60)]


# ---------------------------------------------------------------- ranks by null masks


def test_ranks_by_masks_equal_ranks_by_pairs(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a, b, c = rng.random() < 0.7, rng.random() < 0.5, rng.random() < 0.1
        v = rng.random()
        rows.append((v, float(rng.randrange(4)), v + rng.random() if a else None, -v if a else None, rng.random() if b else None, v * v if b else None, 1.0 if c else None, None))
    names = ["w1", "w2", "a1", "a2", "b1", "b2", "c1", "n1"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    want = {(r["a"], r["b"]): (r["n"], pytest.approx(r["rho"], abs=1e-9)) for r in selection.spearman_each(df, pairs).collect()}
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in selection.spearman_pairs(df, names).collect()}
    assert got == want and len(want) == 21
    masks = selection.null_masks(df.withColumn("__id", F.monotonically_increasing_id()), names)
    assert sorted(map(tuple, masks)) == [("a1", "a2"), ("b1", "b2"), ("c1",), ("n1",), ("w1", "w2")]
    assert selection.spearman_pairs(df, []).count() == selection.spearman_pairs(df, ["w1"]).count() == selection.spearman_pairs(df.limit(0), names).count() == 0


def test_masks_of_equal_marks_are_confirmed(spark, monkeypatch):
    """Were two marks ever equal by chance, the columns are still told apart."""
    df = spark.createDataFrame([(1.0, None, 2.0), (None, 1.0, 3.0)], "a double, b double, c double").withColumn("__id", F.lit(1).cast("bigint"))
    assert sorted(map(tuple, selection.null_masks(df, ["a", "b", "c"]))) == [("a",), ("b",), ("c",)]


# ---------------------------------------------------------------- replicates


def test_replicates_equal_repeated_rows(spark):
    """Each replicate's F1 is that of the rows repeated by their cluster's weight, drawn from MD5 digests."""
    rng = random.Random(6)
    rows = [(f"s{rng.randrange(30)}", rng.choice("ABC"), rng.choice("ABC")) for _ in range(500)] + [(None, "A", "B")]
    df = spark.createDataFrame(rows, "s string, t string, p string").repartition(6)
    n, seed = 11, 5
    got = {r["replicate"]: r["macro_f1"] for r in metrics.bootstrap_f1(df, "s", "t", "p", n, seed).collect()}

    def weight(cluster, r):
        raw = md5(f"{cluster}/{r // 4}/{seed}".encode()).digest()
        u = int.from_bytes(raw[4 * (r % 4) : 4 * (r % 4) + 4], "big") / 2**32
        return sum(u > sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8))

    for r in range(n):
        drawn = [(t, p) for s, t, p in rows for _ in range(weight(s or "", r))]
        seen = {t for t, _ in drawn}
        f1 = 0.0
        for c in seen:
            tp, ends = sum(t == p == c for t, p in drawn), sum(t == c for t, _ in drawn) + sum(p == c for _, p in drawn)
            f1 += 2 * tp / ends
        assert got[r + 1] == pytest.approx(f1 / len(seen))
    assert sorted(got) == list(range(1, n + 1))


def test_replicates_send_sums_only(spark):
    """Rows that leave the tasks follow tasks, replicates and cells, not clusters."""
    df = spark.range(40_000).select(F.col("id").cast("string").alias("s"), (F.col("id") % 2).cast("string").alias("t"), (F.col("id") % 3 % 2).cast("string").alias("p"))
    cells = metrics.bootstrap_cells(df, "s", "t", "p", 8)
    assert cells.count() == 8 * 4
    sums = {r["replicate"]: r["w"] for r in cells.groupBy("replicate").agg(F.sum("w").alias("w")).collect()}
    assert all(38_800 < w < 41_200 for w in sums.values()) and len(set(sums.values())) == 8


def test_weights_are_poisson():
    w = metrics.weights([str(i) for i in range(2000)], 50, 1)
    share = np.bincount(w.reshape(-1), minlength=9) / w.size
    assert share[:5] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=0.005)


def test_draws_side_by_side_are_md5_digests():
    """Names of any length, also beyond one block of the digest, weigh as their digests by hashlib say."""
    names = ["", "a", "\u00e9" * 30, "x" * 48, "x" * 49, "x" * 50, "x" * 200, *map(str, range(0, 5000, 37))]
    got = metrics.weights(names, 403, 7)
    raw = [b"".join(md5(f"{c}/{b}/7".encode()).digest() for b in range(101)) for c in names]
    draws = np.frombuffer(b"".join(raw), ">u4").reshape(len(names), -1)[:, :403]
    assert (got == np.searchsorted(np.array(metrics.WEIGHTS), draws / 2**32, "left")).all()


def test_replicates_are_drawn_once(spark, monkeypatch):
    """Each cluster is drawn in one task and by one run, whatever number of cells it has."""
    drawn = spark.sparkContext.accumulator(0)
    real = metrics.weights
    monkeypatch.setattr(metrics, "weights", lambda clusters, replicates, seed: drawn.add(len(clusters)) or real(clusters, replicates, seed))
    df = spark.range(100_000).select((F.col("id") % 10_000).cast("string").alias("s"), (F.col("id") % 2).cast("string").alias("t"), (F.floor(F.col("id") / 10_000) % 5).cast("string").alias("p"))
    assert metrics.bootstrap_f1(df, "s", "t", "p", 8).count() == 8
    assert 10_000 <= drawn.value < 10_200  # a cluster whose cells fall into two batches is drawn twice


# ---------------------------------------------------------------- dealt columns


def test_each_column_is_dealt_in_one_read(spark):
    rows = [(i, float(i), -float(i) if i % 5 else None, ("Still", "Walk", "Car")[i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, x double, y double, label string").repartition(3)
    out = evaluation.dealt_each(df, ["x", "y"], block=64).collect()
    parts = {c: [r for r in out if r["__column"] == c] for c in (None, "x", "y")}
    assert sorted(tuple(r)[:4] for r in parts[None]) == rows
    assert sorted(r["x"] for r in parts["x"]) == [r[1] for r in rows] and sorted(str(r["y"]) for r in parts["y"]) == sorted(str(r[2]) for r in rows)
    assert all(r["x"] != r["i"] for r in parts["x"]) and all((r["y"] is None) == (r["i"] % 5 == 0) for r in parts["x"])
    assert all(r["x"] == r["i"] and r["label"] == rows[r["i"]][3] for r in parts["y"])
    assert evaluation.dealt_each(df.limit(1), ["x"]).count() == 2 and evaluation.dealt_each(df.limit(0), ["x"]).count() == 0


def test_importance_equals_the_loop(spark):
    rows = [(float(i % 3) * 5, float(i % 7), ("Still", "Walk", "Car")[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "B_a double, B_b double, label string").coalesce(1)
    model = models.Hierarchical(["B_a", "B_b"], ["Still", "Walk", "Car"]).fit(df, "label", numTrees=5, maxDepth=4)
    got = evaluation.permutation_importance(model, df, "label", ["B_a", "B_b"], seed=3)
    share = lambda rows: rows.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    whole = share(model.predict(df))
    for c in ("B_a", "B_b"):
        alone = evaluation.dealt_each(df, [c], seed=3).where(F.col("__column") == c)
        assert got[c] == pytest.approx(whole - share(model.predict(alone)))
    assert got["B_a"] > 0.3 and abs(got["B_b"]) < 0.05


# ---------------------------------------------------------------- footers and row groups


def test_maxima_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(120_000).selectExpr("id as timestamp", "cast(id % 7 as double) as v", "'u' as userId")
    tables.write(df.coalesce(1), path)
    found = tables.largest(spark, path, "timestamp", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(timestamp), MAX(v)]" in plan, plan
    assert tuple(found.first()) == (119_999, 6.0) and tables.last_time(spark, path) == 119_999
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""  # the caller's session is as before
    file = next((tmp_path / "t").glob("*.parquet"))
    assert [pq.ParquetFile(file).metadata.row_group(i).num_rows for i in range(3)] == [50_000, 50_000, 20_000]
    tables.write(df.limit(0), str(tmp_path / "none"))
    assert tables.last_time(spark, str(tmp_path / "none")) is None
