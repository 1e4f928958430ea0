"""The commands end to end on the trajectory view, configuration and evaluation loops."""

import json

import pytest
from pyspark.sql import functions as F

from modeflow import schemas
from modeflow.config import City
from modeflow.operators import evaluation, models, quality, selection, splits
from modeflow.plans import labels, workflows


@pytest.fixture(scope="module")
def table(spark, sf):
    return labels.feature_table(spark, sf).checkpoint()


def test_feature_table(table, spark, sf):
    assert table.columns[:230] == schemas.FEATURES and {"gps_frac", "n_imu", "label", "label_source", "city", "imu_hz", "sess_type"} <= set(table.columns)
    assert table.count() == table.select("userId", "session_id", "ts_start").distinct().count() > 50
    # the kinematic columns are those of the operator on its own
    assert table.where("B_n_gps = 0 and B_speed_mean is not null").count() == 0
    assert table.where("C_osm_subway_prop <> 0").count() == 0 and table.where("B_n_gps = 0 and C_osm_subway_prop is not null").count() == 0
    assert table.where("B_n_gps > 0 and C_bus_stops_mean is null").count() == 0


def test_label_train_predict_aggregate(table):
    city = labels.city()
    silver = workflows.label(table, city).checkpoint()
    assert not {"C_bus_route_align", "C_rail_align"} & set(silver.columns)
    columns = workflows.training_columns(silver)
    assert not set(columns) & set(schemas.DROPPED) and set(columns) <= set(schemas.FEATURES)
    done = workflows.train(silver, city, numTrees=5, maxDepth=4)
    out = workflows.predict(silver, done.model, city).checkpoint()
    assert out.count() == table.count() and {"smooth", "coherent", "B_dist_total_m"} <= set(out.columns)
    got = workflows.aggregate(out, calibration=out.where("label is not null"))
    assert sum(r["share"] for r in got["modal_split"].collect()) == pytest.approx(1.0)
    assert sum(r["corrected"] for r in got["corrected"].collect()) == pytest.approx(1.0)
    assert got["co2"].where("co2_g < 0").count() == 0


def test_evaluation_loops(spark):
    rows = [(f"u{i % 4}", f"s{i // 5}", i * 60_000, float(i % 3) * 5 + (i % 7) / 10, ("Still", "Walk", "Car")[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "userId string, session_id string, ts_start bigint, B_a double, label string")
    classes = ["Still", "Walk", "Car"]
    scores, oof = evaluation.rolling_training(df, ["B_a"], classes, "label", 2, numTrees=3, maxDepth=3)
    assert scores["accuracy_mean"] == pytest.approx(1.0) and scores["accuracy_std"] == pytest.approx(0.0) and oof.select("fold").distinct().count() == 2
    model = models.Hierarchical(["B_a"], classes).fit(df, "label", numTrees=3, maxDepth=3)
    other = df.where("label <> 'Walk'").withColumn("B_extra", F.lit(1.0))
    assert evaluation.transfer(model, other, "label")["accuracy"] == pytest.approx(1.0)
    assert evaluation.permutation_importance(model, df, "label", ["B_a"])["B_a"] > 0.3
    t = evaluation.tagged(model.predict(df).withColumn("label", F.when(F.col("ts_start") > 0, F.col("label"))), splits.temporal(df).where("split = 'test'"))
    assert {r["split"] for r in t.select("split").distinct().collect()} == {"train", "test", "unlabeled"} and t.where("split = 'unlabeled' and correct is not null").count() == 0
    rules = evaluation.rule_based(df.withColumns({"B_speed_mean": F.col("B_a"), "B_speed_max": F.col("B_a"), "B_n_gps": F.lit(9.0), "B_stop_frac": F.lit(0.1), "B_path_efficiency": F.lit(0.9)}), "label", classes)
    assert 0 <= rules["abstain_rate"] < 1 and 0 < rules["accuracy"] <= 1
    curve = evaluation.learning_curve(df, df, lambda: models.Hierarchical(["B_a"], classes), "label", [1.0])
    assert curve[1.0] > 0.9
    hashed = splits.hashed_folds(df)
    assert hashed.groupBy("session_id").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0


def test_configuration(tmp_path):
    city = City.of({"name": "x", "exclude_users": ["a"], "post_processing": {"smooth_min": 6, "min_segment_min": {"Bus": 3}}})
    assert city.smooth_windows() == 3 and city.min_windows()["Bus"] == 2 and city.exclude_users == ("a",)
    with pytest.raises(ValueError, match="unknown sections: sesion"):
        City.of({"name": "x", "sesion": {}})
    (tmp_path / "c.json").write_text(json.dumps({"name": "y"}))
    assert City.read(str(tmp_path / "c.json")).name == "y"


def test_small_helpers(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.51,)], "f double")
    assert [r[0] for r in df.select(quality.stratum(F.col("f"))).collect()] == ["absent", "sparse", "present"]
    masked = quality.mask_positions(spark.createDataFrame([(i, 1.0, 2.0) for i in range(1000)], "k bigint, gps_frac double, B_x double"), 0.7, 1, ["k"])
    assert 600 < masked.where("B_x is null").count() < 800
    edges = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.1,)], "x double").select(quality.binned(F.col("x"), [0.0, 1.0, 2.0], ["a", "b"]).alias("b"))
    assert [r["b"] for r in edges.collect()] == [None, "a", "b", None]


def test_curves_and_permuted_labels(spark):
    """Masking more positions costs accuracy, down to guessing; labels dealt to other rows are worth as little."""
    rows = [(f"u{i % 4}", f"s{i // 5}", i * 60_000, 1.0, float(i % 3) * 5 + (i % 7) / 10, ("Still", "Walk", "Car")[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "userId string, session_id string, ts_start bigint, gps_frac double, B_a double, label string")
    make = lambda: FewTrees(["B_a"], ["Still", "Walk", "Car"])
    curve = evaluation.degradation_curve({"plain": make().fit(df, "label")}, df, "label", [0.0, 0.5, 1.0])
    assert curve[0.0]["plain"] == pytest.approx(1.0) and curve[0.0]["plain"] > curve[0.5]["plain"] > curve[1.0]["plain"]
    worth = evaluation.label_permutation(df, df, make, "label", "label", (0, 1))
    assert worth["labels"] == pytest.approx(1.0) and worth["permuted_mean"] < 0.7 and worth["majority"] == pytest.approx(0.5 / 3)


class FewTrees(models.Hierarchical):
    def fit(self, df, label):
        return super().fit(df, label, numTrees=3, maxDepth=3)


def test_columns_too_close_go_within_the_fold(spark):
    rows = [(float(i), float(i) ** 3 if i % 4 else None, float((i * 37) % 50)) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, cubed double, other double")
    assert selection.apart(df, ["x", "cubed", "other"], 0.7) == ["x", "other"]
    assert selection.apart(df, ["cubed", "x", "other"], 0.7) == ["cubed", "other"]
    assert selection.apart(df, ["x", "cubed", "other"], 1.1) == ["x", "cubed", "other"]


def test_ranks_of_whole_and_of_broken_columns_agree(spark):
    """Columns without nulls go together, pairs with one apart: the same numbers as ranking each pair by itself."""
    import pandas as pd

    rows = [(float(i % 7), float((i * 13) % 11), float(i % 3) if i % 5 else None, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, one double")
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in selection.spearman_pairs(df, ["a", "b", "c", "one"]).collect()}
    each = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in selection.spearman_each(df, list(got)).collect()}
    assert len(got) == 6 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in each.items()}
    assert all(got[k][1] == pytest.approx(each[k][1]) for k in got) and got[("a", "one")][1] == 0
    known = pd.DataFrame(rows, columns=["a", "b", "c", "one"])
    assert got[("a", "b")][1] == pytest.approx(known["a"].rank().corr(known["b"].rank()))
    assert selection.spearman_pairs(df.limit(0), ["a", "b"]).count() == 0


def test_stratified_folds(spark):
    """No session is split; each kind of session is spread evenly; null labels count as a kind, null sessions have no fold."""
    rows = [(f"s{i}", ("Walk", "Car", None)[i % 3] if j else "Bus") for i in range(60) for j in range(3 + i % 4)] + [(None, "Walk")]
    df = splits.stratified_folds(spark.createDataFrame(rows, "session_id string, label string"), "label")
    assert df.where("session_id is not null").groupBy("session_id").agg(F.count_distinct("fold").alias("k"), F.count("fold").alias("f")).where("k <> 1 or f < 3").count() == 0
    assert df.count() == len(rows) and df.where("fold is null").count() == 1
    kinds = spark.createDataFrame([(f"s{i}", i % 3) for i in range(60)], "session_id string, kind int")
    n = df.select("session_id", "fold").distinct().join(kinds, "session_id").groupBy("fold", "kind").count().collect()
    assert len(n) == 15 and {r["count"] for r in n} == {4}


def test_left_joins_keep_their_rows(spark):
    from modeflow.operators.joins import left_kept

    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    once = spark.createDataFrame([(1, 10), (3, 30), (None, 40), (None, 50)], "k int, w int")
    assert sorted(map(str, left_kept(left, once, ["k"]).collect())) == sorted(map(str, left.join(once, "k", "left").collect()))
    with pytest.raises(Exception, match="more than one row on the right"):
        left_kept(left, once.union(once), ["k"]).collect()


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    """A hundred rows in forty partitions are one task of a stage, or four of at most thirty rows on average; none is lost."""
    seen = []
    monkeypatch.setattr(models, "stage", lambda df, *_: seen.append((df.rdd.getNumPartitions(), df.count())))
    rows = spark.range(100).selectExpr("cast(id as double) as a", "if(id % 4 = 0, 'Still', 'Walk') as label").repartition(40)
    models.Hierarchical(["a"], ["Still", "Walk"]).fit(rows, "label")
    monkeypatch.setattr(models, "TASK_ROWS", 30)
    models.Hierarchical(["a"], ["Still", "Walk"]).fit(rows, "label")
    models.Hierarchical(["a"], ["Still", "Walk"]).fit(rows.limit(0), "label")
    assert seen == [(1, 100), (1, 75), (4, 100), (4, 75), (1, 0), (1, 0)]
