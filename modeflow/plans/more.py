"""Further scans, tags, weights and samples of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schemas
from ..functions.order import drawn, drawn_sql
from ..operators import evaluation, models, selection, splits
from ..sources import tables
from . import trajectory as T
from .labels import CLASSES, PAIRS, pairs
from .registry import query, rounded
from .timeline import KINEMATICS, LABELLED, kinematic, labelled


@query(T.SQL + """ SELECT event_id, "timestamp", acc_x FROM samples WHERE "userId" = '7' AND "timestamp" BETWEEN 1705000000 - 3600000 AND 1705500000 + 3600000""")
def imu_user_scan(spark, sf):
    rows = T.samples(spark, sf).where("userId = '7'")
    return rows.where(F.col("timestamp").between(1_705_000_000 - 3_600_000, 1_705_500_000 + 3_600_000)).select("event_id", "timestamp", "acc_x")


@query(T.SQL + """ SELECT DISTINCT "userId" FROM samples""")
def user_enumeration(spark, sf):
    return tables.users(T.samples(spark, sf))


@query(T.SQL + """ SELECT "userId", seq, mode FROM intervals WHERE finished_at >= 1705000000 AND started_at <= 1705800000""")
def label_scan(spark, sf):
    return tables.meeting(T.intervals(spark, sf), 1_705_000_000, 1_705_800_000).select("userId", "seq", "mode")


@query(T.SQL + """ SELECT "userId", "timestamp", CAST(CAST(latitude AS FLOAT) AS DOUBLE) > 46.075::DOUBLE AS north, accuracy IS NULL AS unknown, NULL::FLOAT AS bearing FROM fixes""")
def schema_conform(spark, sf):
    c = tables.conformed(T.fixes(spark, sf), schemas.GPS)
    return c.select("userId", "timestamp", (F.col("latitude").cast("double") > F.lit(46.075)).alias("north"), F.col("accuracy").isNull().alias("unknown"), "bearing")


@query(KINEMATICS + """ SELECT 'B_alt_mean' AS feature, FALSE AS present UNION ALL SELECT 'B_speed_mean', count(speed_mean) > 0 FROM kin UNION ALL SELECT 'B_n_gps', count(n_gps) > 0 FROM kin""")
def features_present(spark, sf):
    k = kinematic(spark, sf)
    found = selection.feature_columns(k)
    return spark.createDataFrame([(c, c in found) for c in ("B_alt_mean", "B_speed_mean", "B_n_gps")], "feature string, present boolean")


@query(KINEMATICS + """ SELECT round(stop_frac, 4) AS "B_stop_frac", NULL::DOUBLE AS "C_osm_rail_prop", n_gps AS "B_n_gps", "userId", session_id, ts_start FROM kin""")
def feature_alignment(spark, sf):
    return rounded(selection.align(kinematic(spark, sf), ["B_stop_frac", "C_osm_rail_prop", "B_n_gps"]))


@query(LABELLED + """, starts AS (SELECT session_id, row_number() OVER (ORDER BY min(ts_start), session_id) - 1 AS i, count(*) OVER () AS n FROM labelled GROUP BY session_id),
tagged AS (SELECT l.label, ['Still', 'Walk', 'Car', 'Bus', 'Train'][ts_start % 5 + 1] AS p, i >= n - greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS test FROM labelled l JOIN starts USING (session_id))
SELECT CASE WHEN label IS NULL THEN 'unlabeled' WHEN test THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (WHERE label = p) AS correct FROM tagged GROUP BY ALL""")
def split_tags(spark, sf):
    modes = F.array(*[F.lit(m) for m in T.MODES])
    rows = labelled(spark, sf).withColumn("predicted", F.element_at(modes, (F.col("ts_start") % 5 + 1).cast("int")))
    tags = evaluation.tagged(rows, splits.temporal(rows).where("split = 'test'"))
    return tags.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"))


@query(CLASSES + """, r AS (SELECT class, f1, rank() OVER (ORDER BY f1 DESC) AS place, sum(f1) OVER (ORDER BY f1 DESC, class) / sum(f1) OVER () AS running FROM f) SELECT class, place, round(running, 4) AS running FROM r""")
def cumulative_importance(spark, sf):
    from ..operators import metrics

    each = metrics.by_class(pairs(spark, sf), "t", "p")
    by_worth = W.orderBy(F.desc("f1"), "class").rowsBetween(W.unboundedPreceding, 0)
    return rounded(each.select("class", F.rank().over(W.orderBy(F.desc("f1"))).cast("bigint").alias("place"), (F.sum("f1").over(by_worth) / F.sum("f1").over(W.partitionBy())).alias("running")))


@query("""SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem""")
def distinct_keys(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").dropDuplicates(["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag")


@query(f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY {drawn_sql('o_orderkey', seed=42)}, o_orderkey LIMIT 100""")
def seeded_sample(spark, sf):
    """100 orders without replacement, by a seeded draw: the same on every run, and a top-k rather than a full sort."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(drawn("o_orderkey", seed=42), "o_orderkey").limit(100)


@query(PAIRS + """, k AS (SELECT t, CASE WHEN t = p THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS own, count(*) AS n FROM pairs GROUP BY ALL),
bars AS (SELECT t, sum(own * n) / sum(n) AS bar FROM k GROUP BY ALL), rest AS (SELECT t, p FROM pairs)
SELECT r.t AS label, count(*) AS n, count(*) FILTER (WHERE r.t <> r.p AND r.p <> 'Still' AND 0.8 >= b.bar) AS suspect FROM rest r LEFT JOIN bars b ON b.t = r.p GROUP BY ALL""")
def noisy_labels(spark, sf):
    """Labels that confident learning doubts, from constructed probabilities: 0.8 for the predicted class, 0.1 for others."""
    classes = ["Walk", "Bus", "Car", "Train"]
    rows = pairs(spark, sf).select(F.col("t").alias("label"), *[F.when(F.col("p") == c, 0.8).otherwise(0.1).alias(f"p_{c}") for c in classes])
    w = models.confident_weights(rows, "label", classes)
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") < 1).alias("suspect"))


@query(LABELLED + f""" SELECT CAST(floor({drawn_sql('session_id', seed=42)} * 5) AS INT) AS fold, count(DISTINCT session_id) AS sessions, count(*) AS n FROM labelled GROUP BY ALL""")
def hashed_fold_counts(spark, sf):
    rows = splits.hashed_folds(labelled(spark, sf))
    return rows.groupBy("fold").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("n"))


@query(LABELLED + f""", c AS (SELECT session_id, coalesce(label, '') AS l, count(*) AS n FROM labelled GROUP BY ALL), g AS (SELECT session_id, arg_min(l, (-n, l)) AS kind, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY session_id),
d AS (SELECT *, (row_number() OVER (ORDER BY kind, -size, {drawn_sql('session_id', seed=42)}, session_id) - 1) % 10 AS turn FROM g)
SELECT CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INT) AS fold, l AS label, count(DISTINCT session_id) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM d JOIN c USING (session_id) GROUP BY ALL""")
def stratified_fold_counts(spark, sf):
    """Sessions and windows of each label in each of five folds that are alike in labels and split no session."""
    rows = splits.stratified_folds(labelled(spark, sf), "label")
    return rows.groupBy("fold", F.coalesce("label", F.lit("")).alias("label")).agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("n"))
