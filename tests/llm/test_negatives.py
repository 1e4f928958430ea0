"""Hard negatives by digits of scores equal those of all pairs, ranked in plain Python."""

import math
import random

import pytest

from modeflow.llm import negatives
from modeflow.llm.negatives import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, kept=3, every=50):
    """rows: (id, vector, label). The rows that take part, quantised, and every pair of them."""
    ok = [(i, [math.floor(256 * x) for x in v], la) for i, v, la in rows if i is not None and v is not None and la is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, tuple(q), la) for i, q, la in ok if i % every == 0}
    out = []
    for i, q, la in anchors:
        score = lambda o, q=q: sum(a * b for a, b in zip(q, o, strict=False))
        ranked = sorted((-score(v), j, k) for j, v, k in ok)
        for p, j, _ in [x for x in ranked if x[2] == la and x[1] != i][:positives]:
            hard = [(s, n) for s, n, k in ranked if k != la and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(hard[:kept], 1)]
    return sorted(out)


def found(df, **more):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in cols) for r in hard_negatives(df, **more).collect())


def made(seed, n=260, dims=6, pool=60):
    """Rows of few different vectors, so that scores tie; some repeat a row, some take no part."""
    rng = random.Random(seed)
    vectors = [[rng.choice([-1, 0, 0.25, 0.5, 1]) * rng.random() for _ in range(dims)] for _ in range(pool)]
    rows = [(i, rng.choice(vectors), rng.randrange(3)) for i in range(n)]
    rows += [(7, None, 1), (8, [0.1] * dims, None), (None, [0.2] * dims, 1), (9, [float("nan")] * dims, 1), (10, [float("inf")] + [0.0] * (dims - 1), 2), (11, [None] * dims, 2), (12, [], 1), (13, [0.5] * (dims - 2), 0)]
    return rows + rows[40:60] + [rows[50], rows[100]]


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "'x' as score", "2 as w", "3 as rank").repartition(5)
    assert found(df) == brute([(i, None if v is None else [None if x is None else spark_float(x) for x in v], la) for i, v, la in rows]) != []


def spark_float(x):
    import numpy as np

    return float(np.float32(x))


def test_rounds_and_parts_change_nothing(spark, monkeypatch):
    """Anchors of a few bytes a round, one score a step, and digits of two bits."""
    df = spark.createDataFrame(made(9), SCHEMA).repartition(3)
    want = found(df)
    monkeypatch.setattr(negatives, "STEP", 1)
    monkeypatch.setattr(negatives, "DIGIT", 2)
    assert found(df, round_bytes=400) == want != []


@pytest.mark.parametrize("scale", [1e3, 1e4, 1e5])
def test_large_components(spark, scale):
    """Scores that need double precision, or whole numbers of 63 bits."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(1, 1) * scale for _ in range(4)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert found(df) == brute(rows) != []
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives(df.selectExpr("vec_id", "transform(embedding, x -> x * 1e12) as embedding", "label"))


def test_one_hot_vector(spark):
    """A third of all rows are one vector: ties go by id, and a task sends the first few of them only."""
    hot = [0.6, 0.8]
    rows = [(i, hot if i % 3 == 0 else [math.cos(i), math.sin(i)], i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(6)
    got = found(df, every=500)
    assert got == brute(rows, every=500) != []


def test_nothing_to_mine(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], SCHEMA)) == []  # no anchor
    assert found(spark.createDataFrame([(50, [1.0], 0), (51, [1.0], 1)], SCHEMA)) == []  # no positive
    assert found(spark.createDataFrame([(50, [-1.0], 0), (51, [1.0], 0), (52, [1.0], 1)], SCHEMA)) == []  # a negative score leaves no window
    assert found(spark.createDataFrame([(50, [], 0), (51, [], 0), (52, [], 1)], SCHEMA)) == [(50, 51, 1, 52, 0, 0)]
