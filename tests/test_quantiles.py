"""Quantiles by selection equal those of sorted lists, and no task gathers more than its bound."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modeflow.functions import quantiles as Q
from modeflow.functions.quantiles import exponent, quantiles
from modeflow.operators import models, quality

PROBS = [0.5, 0.0, 0.25, 0.95, 1.0]


def brute(rows, probs=PROBS):
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).extend([x] if x is not None and not math.isnan(x) else [])
    return {k: [float(v) for v in np.percentile(xs, [100 * p for p in probs])] if xs else None for k, xs in groups.items()}


def shapes(rng):
    """Groups of very different spreads: some are smaller than the bound, some hold few different values."""
    yield "normal", [rng.gauss(0, 1) for _ in range(3000)]
    yield "wide", [math.copysign(10.0 ** rng.uniform(-300, 300), rng.random() - 0.5) for _ in range(3000)]
    yield "close", [1.0 + rng.randrange(1 << 20) * 2.0**-52 for _ in range(3000)]
    yield "ties", [float(rng.randrange(3)) for _ in range(3000)]
    yield "one", [7.25] * 3000
    yield "small", [rng.random() for _ in range(30)]
    yield "tiny", [5e-324 * rng.randrange(5) for _ in range(400)]
    yield "lone", [3.0]
    yield "none", [None, float("nan")]
    yield None, [rng.random() if rng.random() < 0.8 else None for _ in range(900)]
    yield "hot", [0.5] * 9000 + [rng.random() for _ in range(1000)]


@pytest.mark.parametrize("most", [1, 50, 5000, 1 << 20])
def test_all_shapes(spark, most):
    rows = [(k, x) for k, xs in shapes(random.Random(1)) for x in xs]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {r["k"]: r["q"] for r in quantiles(df, ["k"], {"q": F.col("x")}, PROBS, most).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None or got[k] == [None] * 5) if v is None else got[k] == pytest.approx(v, rel=1e-12), k


def test_infinite_values(spark):
    df = spark.createDataFrame([(x,) for x in [float("-inf")] * 3 + [1.0] * 4 + [float("inf")] * 4], "x double")
    got = quantiles(df, [], {"q": F.col("x")}, [0.0, 0.5, 1.0], 2).first()["q"]
    assert got == [float("-inf"), 1.0, float("inf")]


def test_exponents_never_fall(spark):
    rng = random.Random(3)
    xs = sorted({s * math.ldexp(m, e) for s in (-1, 1) for e in range(-1070, 1020, 7) for m in (0.5, 0.5 + 2**-53, 1 - 2**-53, rng.uniform(0.5, 1))} | {0.0, 5e-324, float("inf"), float("-inf")})
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(exponent(F.col("x"))).collect()]
    assert got == sorted(got) and got[xs.index(0.0)] == 0


def test_columns_keys_and_names(spark):
    """Several columns and keys in one go; names that clash with the operator's own and with each other do no harm."""
    df = spark.range(4000).selectExpr("id % 2 as `__x`", "id % 3 as `a b`", "cast(id as double) as __n", "if(id % 5 = 0, null, -id) as y", "'z' as __p", "1 as __low")
    got = {(r["__x"], r["a b"]): (r["u"], r["v"]) for r in quantiles(df, ["__x", "a b"], {"u": F.col("__n"), "v": F.col("y")}, [0.1, 0.9], 100).collect()}
    for a in range(2):
        for b in range(3):
            ids = [i for i in range(4000) if i % 2 == a and i % 3 == b]
            want = [np.percentile(v, [10, 90]) for v in (ids, [-i for i in ids if i % 5])]
            assert [list(x) for x in got[a, b]] == [pytest.approx(list(w)) for w in want]


def test_one_key_is_spread(spark, monkeypatch):
    """With one key of all rows, no group that is gathered passes the bound, and each pass sends bounded counts."""
    seen = []
    kept = F.collect_list
    monkeypatch.setattr(Q.F, "collect_list", lambda c: seen.append(1) or kept(c))
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.xxhash64("id") / F.lit(2.0**40)).alias("x")).repartition(8)
    inside = Q.inside
    sizes = []

    def watched(rows, wanted, keys):
        out = inside(rows, wanted, keys)
        sizes.append(out.groupBy(*keys, "__low", "__high").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(Q, "inside", watched)
    got = quantiles(df, ["k"], {"q": F.col("x")}, [0.3, 0.5], 500).first()["q"]
    xs = np.sort(df.toPandas()["x"].to_numpy())
    assert got == pytest.approx(list(np.percentile(xs, [30, 50])), rel=1e-12)
    assert sizes[-1] <= 500 < sizes[0]


def test_users_of_it(spark):
    """Medians, units and devices of groups above the bound."""
    rows = [(f"u{i % 2}", i, x := 9.81 * (1 + i % 7 / 100) if i % 2 else 1 + i % 5 / 10, 0.0, 0.0) for i in range(40_000)]
    df = spark.createDataFrame(rows, "userId string, event_id bigint, acc_x double, acc_y double, acc_z double")
    del x
    assert {r["userId"]: r["device"] for r in quality.devices(df).collect()} == {"u0": "iOS", "u1": "Android"}
    scaled = quality.to_g(df, ["userId"]).groupBy("userId").agg(F.max("acc_x").alias("m")).collect()
    assert {r["userId"]: round(r["m"], 3) for r in scaled} == {"u0": 1.4, "u1": round(9.81 * 1.06 / 9.80665, 3)}
    assert models.medians(df.withColumn("nothing", F.lit(None).cast("double")), ["acc_x", "acc_y", "nothing"]) == {"acc_x": pytest.approx(float(np.median([r[2] for r in rows]))), "acc_y": 0.0, "nothing": 0.0}
    assert models.medians(df, []) == {}
    assert models.medians(df.limit(0), ["acc_x"]) == {"acc_x": 0.0}
