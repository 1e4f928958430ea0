"""Boosted trees: steps by their definition, falling loss, and stages of the hierarchy."""

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from modeflow.operators import evaluation, models
from modeflow.operators.boosting import boost


def frame(spark, rows):
    df = spark.createDataFrame(rows, "x double, z double, y double, w double")
    return VectorAssembler(inputCols=["x", "z"], outputCol="__features").transform(df).select("__features", F.col("y").alias("__y"), F.col("w").alias("__weight"))


def test_one_round_by_its_definition(spark):
    """A split at x, three classes: scores are the log shares, then one Newton step in each leaf of each class's tree."""
    rows = [(0.0, 0.0, 0.0, 2.0)] * 6 + [(1.0, 0.0, 1.0, 1.0)] * 4 + [(1.0, 0.0, 2.0, 1.0)] * 2
    data = frame(spark, rows)
    got = boost(data, 3, rounds=1, maxDepth=1, rate=0.5, minInstancesPerNode=1).transform(data).select("__features", vector_to_array("probability").alias("p")).distinct().collect()
    total = {0: 12.0, 1: 4.0, 2: 2.0}
    start = [math.log(total[k] / 18) for k in range(3)]
    for r in got:
        x = r["__features"][0]
        here = [(y, w) for a, _, y, w in rows if a == x]
        scores = []
        for k in range(3):
            p = total[k] / 18
            res = [((y == k) - p, w) for y, w in here]
            scores.append(start[k] + 0.5 * (2 / 3) * sum(w * e for e, w in res) / sum(w * abs(e) * (1 - abs(e)) for e, w in res))
        top = sum(math.exp(s) for s in scores)
        assert list(r["p"]) == pytest.approx([math.exp(s) / top for s in scores])
    assert len(got) == 2


def test_loss_falls(spark):
    """Classes on a checkerboard, which no single split tells apart."""
    rng = random.Random(2)
    rows = [(x, z, float((x > 0.5) != (z > 0.5)) + (x > 0.8), 1.0) for x, z in ((rng.random(), rng.random()) for _ in range(600))]
    data = frame(spark, rows).repartition(4).cache()
    loss, right = [], []
    for n in (1, 3, 7):
        out = boost(data, 3, rounds=n, maxDepth=3).transform(data)
        p = F.get(vector_to_array("probability"), F.col("__y").cast("int"))
        a, b, c = out.agg(F.avg(-F.log(p)), F.avg((F.col("prediction") == F.col("__y")).cast("double")), F.max(F.abs(1 - F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda s, v: s + v)))).first()
        loss.append(a)
        right.append(b)
        assert c < 1e-9
    assert loss == sorted(loss, reverse=True) and right[-1] > 0.95


def test_boosted_hierarchy(spark, tmp_path):
    rows = [(float(i % 7) / 50 + base, float(i % 5) if i % 11 else None, m) for m, base in (("Still", 0.0), ("Walk", 2.0), ("Car", 15.0), ("Bus", 8.0)) for i in range(40)]
    df = spark.createDataFrame(rows, "B_a double, B_b double, label string")
    model = models.Hierarchical(["B_a", "B_b"], ["Still", "Walk", "Car", "Bus"], learner="boosted").fit(df, "label", specialists=("S1",), rounds=3, maxDepth=3)
    got = model.predict(df)
    assert got.where("predicted <> label").count() == 0 and set(model.special) == {"S1"}
    assert model.probabilities(df).withColumn("s", F.expr("p_Still + p_Walk + p_Car + p_Bus")).agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-9
    assert model.predict(df, "hard").where("predicted <> label").count() == 0 and model.predict(df, forced_moving=True).where("predicted = 'Still'").count() == 0
    assert evaluation.permutation_importance(model, df, "label", ["B_a", "B_b"])["B_a"] > 0.3
    with pytest.raises(ValueError, match="forests"):
        models.save(model, spark, str(tmp_path), "m")


def test_a_class_without_rows(spark):
    rows = [(float(i), 0.0, float(i % 2), 1.0) for i in range(20)]
    data = frame(spark, rows)
    out = boost(data, 3, rounds=1, maxDepth=1).transform(data)
    assert out.where("prediction = 2").count() == 0 and out.agg(F.max(F.get(vector_to_array("probability"), F.lit(2)))).first()[0] < 1e-3
