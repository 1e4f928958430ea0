"""Labels, smoothing, shares, measures, splits, selection and models over the window table."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import drawn_sql
from ..functions.quantiles import quantiles
from ..operators import aggregate, intervals, labeling, metrics, models, quality, selection, smoothing, splits, windows
from ..session import cut
from . import trajectory as T
from .registry import query, rounded
from .timeline import ASOF, KEYS, KINEMATICS, LABELLED, View, built, kinematic, labelled

#: The cascade in SQL over kinematic features, with a constructed rail and bus share.
CASCADE = (
    KINEMATICS
    + """, feat AS (SELECT w."userId", w.session_id, w.ts_start, w.ts_end, coalesce(k.n_gps, 0) AS n, coalesce(speed_mean, 0) AS s, coalesce(speed_max, 0) AS mx, coalesce(stop_frac, 0.5) AS st, coalesce(path_efficiency, 0.5) AS pe,
  (ts_start // 60000 % 10) / 10.0::DOUBLE AS rail, (ts_start // 60000 % 7) / 7.0::DOUBLE AS bus FROM windows w LEFT JOIN kin k USING ("userId", session_id, ts_start)),
casc AS (SELECT *, CASE WHEN (n > 0 AND (s < 0.2 OR (s < 0.5 AND st > 0.85))) OR (n = 0 AND 0 < 0.015) THEN 'Still' WHEN n > 0 AND s > 0.5 AND s < 2.5 AND mx < 5 AND st < 0.5 THEN 'Walk'
  WHEN n > 0 AND rail > 0.35 AND s > 8 THEN 'Train' WHEN n > 0 AND bus > 0.2 AND s > 1.5 AND s < 14 AND st > 0.1 THEN 'Bus' WHEN n > 0 AND s > 5 AND rail < 0.15 AND pe > 0.4 THEN 'Car' END AS silver FROM feat)"""
)


def feature_windows(spark, sf) -> DataFrame:
    """All windows of the view with kinematic features and constructed infrastructure shares."""
    view = View(spark, sf)
    w = view.windows.join(view.kinematics(), KEYS, "left").withColumn("B_n_gps", F.coalesce("B_n_gps", F.lit(0)))
    return w.withColumn("C_osm_rail_prop", F.expr("ts_start div 60000 % 10") / F.lit(10.0)).withColumn("C_bus_stops_prop", F.expr("ts_start div 60000 % 7") / F.lit(7.0))


def silver(spark, sf) -> DataFrame:
    return labeling.cascade(feature_windows(spark, sf))


@query(CASCADE + """ SELECT "userId", session_id, ts_start, silver AS silver_label, CASE WHEN silver IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS silver_weight FROM casc""")
def label_cascade(spark, sf):
    return silver(spark, sf).select(*KEYS, "silver_label", "silver_weight")


@query(CASCADE + """, t AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS value),
l AS (SELECT value, CASE WHEN (n > 0 AND (s < value OR (s < 0.5 AND st > 0.85))) OR n = 0 THEN 'Still' WHEN n > 0 AND s > 0.5 AND s < 2.5 AND mx < 5 AND st < 0.5 THEN 'Walk' WHEN n > 0 AND rail > 0.35 AND s > 8 THEN 'Train' WHEN n > 0 AND bus > 0.2 AND s > 1.5 AND s < 14 AND st > 0.1 THEN 'Bus' WHEN n > 0 AND s > 5 AND rail < 0.15 AND pe > 0.4 THEN 'Car' ELSE 'abstain' END AS label FROM feat, t)
SELECT value, label, count(*) AS n FROM l GROUP BY ALL""")
def threshold_sweep(spark, sf):
    return labeling.sweep(feature_windows(spark, sf), "still_spd_strict", [0.1, 0.2, 0.5, 1.0])


@query(CASCADE + """ SELECT round(avg(CASE WHEN silver IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS abstain_rate, count(*) AS n FROM casc""")
def abstain_rate(spark, sf):
    return rounded(silver(spark, sf).agg(F.avg(F.col("silver_label").isNull().cast("double")).alias("abstain_rate"), F.count(F.lit(1)).alias("n")))


@query(CASCADE + """, n AS (SELECT mode, count(silver) AS n FROM (SELECT unnest(['Walk', 'Bus', 'Car', 'Train']) AS mode) m LEFT JOIN casc ON silver = mode GROUP BY ALL) SELECT mode, n, round(CASE WHEN sum(n) OVER () = 0 THEN 0 ELSE n / CAST(sum(n) OVER () AS DOUBLE) END, 4) AS share FROM n""")
def modal_split(spark, sf):
    return rounded(aggregate.modal_split(silver(spark, sf), "silver_label"))


@query(KINEMATICS + """ SELECT "userId", session_id, ts_start, round(avg(stop_frac) OVER (PARTITION BY "userId", session_id ORDER BY ts_start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS "B_stop_rate_5win" FROM kin""")
def rolling_context(spark, sf):
    return rounded(windows.rolling_stop_rate(kinematic(spark, sf)).select(*KEYS, "B_stop_rate_5win"))


#: Predicted modes of all windows by arithmetic, so that smoothing has something to smooth.
PREDICTED = LABELLED + """, pred AS (SELECT *, ['Bus', 'Car', 'Bus', 'Walk', 'Train', 'Still', 'Car', 'Bike'][(ts_start // 60000 * 7 + ts_start // 1000) % 8 + 1] AS predicted FROM labelled)"""


def predictions(spark, sf) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in ("Bus", "Car", "Bus", "Walk", "Train", "Still", "Car", "Bike")])
    return labelled(spark, sf).withColumn("predicted", F.element_at(modes, F.expr("(ts_start div 60000 * 7 + ts_start div 1000) % 8 + 1").cast("int")))


@query(PREDICTED + """, nb AS (SELECT *, row_number() OVER w AS i, lag(predicted) OVER w AS b, lead(predicted) OVER w AS a FROM pred WINDOW w AS (PARTITION BY "userId", session_id ORDER BY ts_start)),
votes AS (SELECT x."userId", x.session_id, x.ts_start, y.predicted AS m, count(*) AS n, min(y.i) AS first FROM nb x JOIN nb y ON y."userId" = x."userId" AND y.session_id = x.session_id AND y.i BETWEEN x.i - 2 AND x.i + 2 WHERE y.predicted IN ('Car', 'Bus', 'Train', 'Subway') GROUP BY ALL),
winner AS (SELECT "userId", session_id, ts_start, sum(n) AS total, arg_min(m, (-n, first)) AS m FROM votes GROUP BY ALL)
SELECT x."userId", x.session_id, x.ts_start, CASE WHEN predicted IN ('Car', 'Bus', 'Train', 'Subway') AND total >= 3 THEN v.m WHEN predicted IN ('Walk', 'Run', 'Bike') AND a = b AND a IN ('Car', 'Bus', 'Train', 'Subway') THEN a WHEN predicted = 'Still' AND a = b AND a IN ('Bus', 'Train', 'Subway') THEN a ELSE predicted END AS smooth
FROM nb x LEFT JOIN winner v USING ("userId", session_id, ts_start)""")
def smooth_majority(spark, sf):
    return smoothing.majority(predictions(spark, sf), ["userId", "session_id"]).select(*KEYS, "smooth")


@query(PREDICTED + """, r AS (SELECT *, row_number() OVER (PARTITION BY "userId", session_id ORDER BY ts_start) - row_number() OVER (PARTITION BY "userId", session_id, predicted ORDER BY ts_start) AS g FROM pred)
SELECT "userId", session_id, predicted, min(ts_start) AS run_start, max(ts_start) AS run_end, count(*) AS n FROM r GROUP BY "userId", session_id, predicted, g""")
def run_length(spark, sf):
    return smoothing.run_lengths(predictions(spark, sf), ["userId", "session_id"]).drop("run")


@query()
def segment_coherence(spark, sf):
    smooth = smoothing.majority(predictions(spark, sf), ["userId", "session_id"])
    return smoothing.coherence(smooth, ["userId", "session_id"]).select(*KEYS, "predicted", "smooth", "coherent")


@query(CASCADE + """ SELECT "userId", session_id, ts_start, CASE silver WHEN 'Still' THEN s <= 0.8 WHEN 'Walk' THEN s >= 0.2 AND s <= 3.5 WHEN 'Bus' THEN s <= 30 WHEN 'Car' THEN s <= 55 ELSE TRUE END AS plausible FROM casc""")
def speed_plausibility(spark, sf):
    bounds = {"Still": (None, 0.8), "Walk": (0.2, 3.5), "Bus": (None, 30.0), "Car": (None, 55.0)}
    rows = silver(spark, sf)
    return rows.select(*KEYS, smoothing.plausible(F.col("silver_label"), F.coalesce("B_speed_mean", F.lit(0.0)), bounds).alias("plausible"))


#: (true, predicted, weight) rows from the star schema, for measures.
PAIRS = """WITH pairs AS (SELECT ['Walk', 'Bus', 'Car', 'Train'][l_orderkey % 4 + 1] AS t, ['Walk', 'Bus', 'Car', 'Train', 'Still'][CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 5 ELSE l_orderkey % 4 END + 1] AS p, l_quantity AS w, l_discount AS d, l_tax, l_orderkey, l_extendedprice AS x, l_returnflag, l_linestatus FROM lineitem)"""


def pairs(spark, sf) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    k = F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey") % 5).otherwise(F.col("l_orderkey") % 4)
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        pick(["Walk", "Bus", "Car", "Train"], F.col("l_orderkey") % 4).alias("t"), pick(["Walk", "Bus", "Car", "Train", "Still"], k).alias("p"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("d"), "l_tax", "l_orderkey", F.col("l_extendedprice").alias("x"), "l_returnflag", "l_linestatus"
    )


@query(PAIRS + """, c AS (SELECT t, p, sum(w) AS w FROM pairs GROUP BY ALL), s AS (SELECT t, sum(w) AS total FROM c GROUP BY ALL), m AS (SELECT unnest(['Walk', 'Bus', 'Car', 'Train']) AS mode)
SELECT a.mode AS "true", b.mode AS pred, round(CASE WHEN total > 0 THEN coalesce(w, 0) / total WHEN a.mode = b.mode THEN 1 ELSE 0 END, 4) AS p FROM m a CROSS JOIN m b LEFT JOIN c ON c.t = a.mode AND c.p = b.mode LEFT JOIN s ON s.t = a.mode""")
def confusion_weighted(spark, sf):
    return rounded(aggregate.confusion(pairs(spark, sf), "t", "p", weight=F.col("w")))


@query(PAIRS + """, c AS (SELECT t, p, count(*) AS n FROM pairs WHERE l_orderkey % 2 = 1 GROUP BY ALL), k AS (SELECT unnest([1, 2, 3, 4]) AS k, unnest(['Walk', 'Bus', 'Car', 'Train']) AS mode),
m AS (SELECT a.k AS i, b.k AS j, coalesce(coalesce(n, 0) / (SELECT sum(n) FROM c WHERE t = a.mode)::DOUBLE, CASE WHEN a.k = b.k THEN 1 ELSE 0 END) AS v FROM k a CROSS JOIN k b LEFT JOIN c ON c.t = a.mode AND c.p = b.mode),
s AS (SELECT k AS j, count(p) / sum(count(p)) OVER ()::DOUBLE AS v FROM k LEFT JOIN pairs ON p = mode AND l_orderkey % 2 = 0 GROUP BY k),
orders AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, sign((b.k - a.k) * (c.k - a.k) * (d.k - a.k) * (c.k - b.k) * (d.k - b.k) * (d.k - c.k)) AS sign FROM k a, k b, k c, k d),
system AS (SELECT x.x, m.j, m.i, CASE WHEN m.i = x.x THEN s.v ELSE m.v END AS v FROM m JOIN s USING (j), (SELECT unnest([0, 1, 2, 3, 4]) AS x) x),
det AS (SELECT w.x, sum(sign * w.v * x.v * y.v * z.v) AS det FROM orders JOIN system w ON w.j = 1 AND w.i = a JOIN system x ON x.x = w.x AND x.j = 2 AND x.i = b JOIN system y ON y.x = w.x AND y.j = 3 AND y.i = c JOIN system z ON z.x = w.x AND z.j = 4 AND z.i = d WHERE sign <> 0 GROUP BY w.x),
solved AS (SELECT x AS k, greatest(0, det / (SELECT det FROM det WHERE x = 0)) AS v FROM det WHERE x > 0)
SELECT mode, round(s.v, 6) AS share, round(solved.v / (SELECT sum(v) FROM solved), 6) AS corrected FROM k JOIN s ON s.j = k.k JOIN solved ON solved.k = k.k""")
def quantify(spark, sf):
    """Shares freed from confusion; the SQL solves the same four equations by determinants."""
    rows = pairs(spark, sf)
    return rounded(aggregate.corrected_split(rows.where("l_orderkey % 2 = 0"), "p", rows.where("l_orderkey % 2 = 1"), "t", "p"), 6)


@query(PAIRS + """ SELECT p AS mode, round(sum(w / 10.0::DOUBLE), 2) AS km, round(sum(w / 10.0::DOUBLE) * CASE p WHEN 'Bus' THEN 100 WHEN 'Car' THEN 170 WHEN 'Train' THEN 40 ELSE 0 END, 1) AS co2_g FROM pairs GROUP BY p""")
def co2_by_mode(spark, sf):
    e = aggregate.emissions(pairs(spark, sf), "p", F.col("w") / F.lit(10.0))
    return e.select("mode", (F.round("km", 2) + 0.0).alias("km"), (F.round("co2_g", 1) + 0.0).alias("co2_g"))


CLASSES = PAIRS + """, k AS (SELECT DISTINCT t AS class FROM pairs UNION SELECT DISTINCT p FROM pairs), s AS (SELECT class, (SELECT count(*) FROM pairs WHERE t = class AND p = class) AS tp, (SELECT count(*) FROM pairs WHERE p = class) AS pp, (SELECT count(*) FROM pairs WHERE t = class) AS tt FROM k),
f AS (SELECT class, tt AS support, CASE WHEN pp = 0 THEN 0 ELSE tp / CAST(pp AS DOUBLE) END AS precision, CASE WHEN tt = 0 THEN 0 ELSE tp / CAST(tt AS DOUBLE) END AS recall, CASE WHEN pp + tt = 0 THEN 0 ELSE 2 * tp / CAST(pp + tt AS DOUBLE) END AS f1 FROM s)"""


@query(CLASSES + """ SELECT class, support, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM f""")
def class_metrics(spark, sf):
    return rounded(metrics.by_class(pairs(spark, sf), "t", "p"))


@query(CLASSES + """ SELECT (SELECT round(avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) FROM pairs) AS accuracy, round(sum(f1) FILTER (WHERE support > 0) / count(*) FILTER (WHERE support > 0), 4) AS macro_seen, round(sum(f1) / 6, 4) AS macro_all FROM f""")
def f1_macro(spark, sf):
    return rounded(metrics.macro_f1(pairs(spark, sf), "t", "p", ["Walk", "Bus", "Car", "Train", "Still", "Bike"]))


@query(PAIRS + """, n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE t = p) AS same FROM pairs), e AS (SELECT sum(CAST(a.n AS DOUBLE) * b.n) AS e FROM (SELECT t AS c, count(*) AS n FROM pairs GROUP BY ALL) a JOIN (SELECT p AS c, count(*) AS n FROM pairs GROUP BY ALL) b USING (c))
SELECT round(same / n, 4) AS observed, round(e / n / n, 4) AS expected, round((same / n - e / n / n) / (1 - e / n / n), 4) AS kappa FROM n, e""")
def kappa(spark, sf):
    return rounded(metrics.kappa(pairs(spark, sf), "t", "p"))


@query(PAIRS + """, a AS (SELECT t AS c, count(*) / CAST((SELECT count(*) FROM pairs) AS DOUBLE) AS s FROM pairs GROUP BY ALL), b AS (SELECT p AS c, count(*) / CAST((SELECT count(*) FROM pairs) AS DOUBLE) AS s FROM pairs GROUP BY ALL) SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2, 4) AS tvd FROM a FULL JOIN b USING (c)""")
def tvd(spark, sf):
    rows = pairs(spark, sf)
    n = rows.count()
    share = lambda c, name: rows.groupBy(F.col(c).alias("c")).agg((F.count(F.lit(1)) / F.lit(float(n))).alias(name))
    both = share("t", "a").join(share("p", "b"), "c", "full")
    return rounded(metrics.tvd(both, F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))))


@query("""WITH h AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY ALL), r AS (SELECT x, row_number() OVER (ORDER BY x, o_custkey) AS i, row_number() OVER (ORDER BY x DESC, o_custkey) AS d, count(*) OVER () AS n, sum(x) OVER () AS s FROM h)
SELECT round((2 * sum(i * x) - (max(n) + 1) * max(s)) / (max(n) * max(s)), 4) AS gini, round(sum(x) FILTER (WHERE d <= 5) / max(s), 4) AS top_share FROM r""")
def gini(spark, sf):
    held = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("x"))
    return rounded(metrics.gini(held, "x"))


@query("""WITH v AS (SELECT l_extendedprice AS x, l_returnflag = 'R' AS b FROM lineitem), c AS (SELECT x, count(*) FILTER (WHERE NOT b) AS a, count(*) FILTER (WHERE b) AS b FROM v GROUP BY ALL), s AS (SELECT sum(a) OVER (ORDER BY x) / CAST(sum(a) OVER () AS DOUBLE) AS fa, sum(b) OVER (ORDER BY x) / CAST(sum(b) OVER () AS DOUBLE) AS fb FROM c)
SELECT round(max(abs(fa - fb)), 5) AS ks, (SELECT count(*) FROM v WHERE NOT b) AS n_a, (SELECT count(*) FROM v WHERE b) AS n_b FROM s""")
def ks_two_sample(spark, sf):
    return rounded(metrics.ks(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice", F.col("l_returnflag") == "R"), 5)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT round(corr(a, b), 4) AS rho, count(*) AS n FROM r""")
def spearman(spark, sf):
    return rounded(metrics.spearman(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_quantity", "l_extendedprice"))


@query("""WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM c) SELECT round(sum(n / total * ln(n * total / nx / ny)), 6) AS mi FROM m""")
def mutual_information(spark, sf):
    return rounded(metrics.mutual_information(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", "l_linestatus"), 6)


KNN = """{start}
s{i} AS (SELECT y, x, least(3, count(*) OVER (PARTITION BY y) - 1) AS k, count(*) OVER (PARTITION BY y) AS ny, list_sort(list_filter([x - lag(x, 1) OVER o, x - lag(x, 2) OVER o, x - lag(x, 3) OVER o, lead(x, 1) OVER o - x, lead(x, 2) OVER o - x, lead(x, 3) OVER o - x], lambda d: d IS NOT NULL)) AS near FROM v{i} WINDOW o AS (PARTITION BY y ORDER BY x)),
r{i} AS (SELECT x, k, ny, greatest(near[k] - 1, 0) AS r FROM s{i} WHERE ny > 1),
m{i} AS (SELECT k, ny, count(*) OVER (ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m, count(*) OVER () AS n FROM r{i}),
e{i} AS (SELECT '{name}' AS feature, max(n) AS n, max(a.h) + avg(b.h - c.h - d.h) AS estimate FROM m{i} JOIN psi a ON a.i = n JOIN psi b ON b.i = k JOIN psi c ON c.i = ny JOIN psi d ON d.i = m)"""


@query(
    """WITH psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329::DOUBLE AS h FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM lineitem))) AS i)),
v1 AS (SELECT l_linestatus AS y, CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem), v2 AS (SELECT l_linestatus AS y, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS x FROM lineitem),
v3 AS (SELECT l_returnflag AS y, CAST(l_orderkey AS BIGINT) AS x FROM lineitem),"""
    + ",".join(KNN.format(start="", i=i, name=n) for i, n in ((1, "price"), (2, "date"), (3, "order")))
    + """ SELECT feature, n, round(estimate, 6) AS estimate, round(greatest(estimate, 0), 6) AS mi FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) t"""
)
def knn_information(spark, sf):
    """What numbers tell of a class, by nearest neighbours: prices (few ties), days and order numbers (many)."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    of = {"price": (F.round(F.col("l_extendedprice") * 100), "l_linestatus"), "date": (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01")), "l_linestatus"), "order": (F.col("l_orderkey"), "l_returnflag")}
    out = None
    for name, (x, y) in of.items():
        got = metrics.knn_information(li.select(x.cast("double").alias("x"), y), "x", y).select(F.lit(name).alias("feature"), "n", "estimate", "mi")
        out = got if out is None else out.union(got)
    return rounded(out, 6)


@query(PAIRS + """, q AS (SELECT (l_orderkey % 997) / 997.0::DOUBLE AS prob, CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM pairs), b AS (SELECT greatest(0, least(14, CAST(ceil(prob * 15) AS BIGINT) - 1)) AS bin, count(*) AS n, avg(prob) AS p, avg(ok) AS a, sum((prob - ok) ** 2) AS s FROM q GROUP BY ALL)
SELECT round(sum(n * abs(p - a)) / sum(n), 4) AS ece, round(max(abs(p - a)), 4) AS mce, round(sum(s) / sum(n), 4) AS brier FROM b""")
def ece(spark, sf):
    rows = pairs(spark, sf).withColumn("prob", (F.col("l_orderkey") % 997) / F.lit(997.0))
    return rounded(metrics.calibration(rows, "prob", F.col("t") == F.col("p")))


@query("""WITH s AS (SELECT user_id, list_distinct(list(event_type) FILTER (WHERE value > 30)) AS a, list_distinct(list(event_type) FILTER (WHERE value < 10)) AS b FROM events GROUP BY ALL)
SELECT user_id, round(CASE WHEN len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) = 0 THEN 0 ELSE len(list_intersect(coalesce(a, []), coalesce(b, []))) / CAST(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS DOUBLE) END, 4) AS jaccard FROM s""")
def jaccard(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    sets = ev.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 30, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 10, F.col("event_type"))).alias("b"))
    return rounded(sets.select("user_id", metrics.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@query(PAIRS + """ SELECT t AS class, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share FROM pairs GROUP BY ALL""")
def prior_shares(spark, sf):
    from pyspark.sql.window import Window as W

    n = pairs(spark, sf).groupBy(F.col("t").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()).cast("double")))


@query(PAIRS + """ SELECT t, count(*) FILTER (WHERE p = 'Walk') AS "Walk", count(*) FILTER (WHERE p = 'Bus') AS "Bus", count(*) FILTER (WHERE p = 'Car') AS "Car", count(*) FILTER (WHERE p = 'Train') AS "Train", count(*) FILTER (WHERE p = 'Bike') AS "Bike" FROM pairs GROUP BY ALL""")
def crosstab(spark, sf):
    wide = pairs(spark, sf).groupBy("t").pivot("p", ["Walk", "Bus", "Car", "Train", "Bike"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("""WITH h AS (SELECT event_type, hour(ts) AS h, dayofweek(ts) IN (0, 6) AS weekend FROM events) SELECT event_type, h, weekend, count(*) AS n FROM h GROUP BY ALL""")
def temporal_pattern(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.groupBy("event_type", F.hour("ts").cast("bigint").alias("h"), F.dayofweek("ts").isin(1, 7).alias("weekend")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-n, event_type)) AS label FROM c GROUP BY ALL""")
def majority_label(spark, sf):
    c = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("label"))


@query("""WITH q AS (SELECT l_returnflag AS c, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY ALL)
SELECT x.c AS c1, y.c AS c2, round(greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / (greatest(x.b, y.b) - least(x.a, y.a)), 4) AS overlap FROM q x JOIN q y ON x.c < y.c""")
def iqr_overlap(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnRenamed("l_returnflag", "c")
    q = quantiles(li, ["c"], {"q": F.col("l_extendedprice")}, [0.25, 0.75]).select("c", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    x, y = (q.select(F.col("c").alias(f"c{i}"), F.col("a").alias(f"a{i}"), F.col("b").alias(f"b{i}")) for i in (1, 2))
    met = F.greatest(F.lit(0.0), F.least("b1", "b2") - F.greatest("a1", "a2")) / (F.greatest("b1", "b2") - F.least("a1", "a2"))
    return rounded(x.join(y, F.col("c1") < F.col("c2")).select("c1", "c2", met.alias("overlap")))


@query("""SELECT l_returnflag AS class, round(avg(CASE WHEN l_quantity > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS rate, round(stddev_samp(l_quantity), 4) AS sd, round(covar_samp(l_quantity, l_discount), 5) AS cov, min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def class_rates(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = li.groupBy(F.col("l_returnflag").alias("class")).agg(
        F.avg((F.col("l_quantity") > 30).cast("double")).alias("rate"), F.stddev_samp("l_quantity").alias("sd"), F.covar_samp("l_quantity", "l_discount").alias("cov"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count_distinct("l_suppkey").alias("suppliers")
    )
    return out.select("class", F.round("rate", 4).alias("rate"), F.round("sd", 4).alias("sd"), (F.round("cov", 5) + 0.0).alias("cov"), "low", "high", "suppliers")


@query(CASCADE + """, st AS (SELECT CASE WHEN n / 120.0::DOUBLE = 0 THEN 'absent' WHEN n / 120.0::DOUBLE <= 0.02 THEN 'sparse' ELSE 'present' END AS stratum, silver FROM casc) SELECT coalesce(stratum, 'ALL') AS stratum, count(*) AS n, count(silver) AS labelled FROM st GROUP BY ROLLUP (stratum)""")
def gps_strata_rollup(spark, sf):
    frac = F.col("B_n_gps") / F.lit(120.0)
    rows = silver(spark, sf).withColumn("stratum", F.when(frac == 0, "absent").when(frac <= 0.02, "sparse").otherwise("present"))
    return rows.rollup("stratum").agg(F.count(F.lit(1)).alias("n"), F.count("silver_label").alias("labelled")).select(F.coalesce("stratum", F.lit("ALL")).alias("stratum"), "n", "labelled")


@query(ASOF + """, j AS (SELECT "userId", event_id, label, ['Still', 'Walk', 'Car', 'Bus', 'Train'][event_id % 5 + 1] AS pred FROM last_iv) SELECT label AS class, count(*) AS n, round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS recall FROM j WHERE label IS NOT NULL GROUP BY ALL""")
def frame_metrics(spark, sf):
    frames = T.fixes(spark, sf).select("userId", "event_id", F.col("timestamp").alias("ts_ms"))
    rows = intervals.as_of(frames, T.intervals(spark, sf), ["userId"]).where("label is not null")
    pred = F.element_at(F.array(*[F.lit(m) for m in T.MODES]), (F.col("event_id") % 5 + 1).cast("int"))
    return rounded(rows.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == pred).cast("double")).alias("recall")))


RUNS = PREDICTED + """, r AS (SELECT *, row_number() OVER (PARTITION BY "userId", session_id ORDER BY ts_start) - row_number() OVER (PARTITION BY "userId", session_id, predicted ORDER BY ts_start) AS g FROM pred),
runs AS (SELECT "userId", min(ts_start) AS started_at, max(ts_start) + 60000 AS finished_at, predicted AS mode FROM r GROUP BY "userId", session_id, predicted, g)"""
EVALUATED = """, evaluated AS (SELECT CASE WHEN ts_ms <= i.finished_at THEN i.mode END AS t, CASE WHEN ts_ms <= x.finished_at THEN x.mode END AS p FROM frames f
  LEFT JOIN LATERAL (SELECT * FROM intervals i WHERE i."userId" = f."userId" AND i.started_at <= f.ts_ms ORDER BY i.started_at DESC, i.seq DESC LIMIT 1) i ON TRUE
  LEFT JOIN LATERAL (SELECT * FROM runs x WHERE x."userId" = f."userId" AND x.started_at <= f.ts_ms ORDER BY x.started_at DESC LIMIT 1) x ON TRUE)"""
FRAMES = RUNS + """, frames AS (SELECT DISTINCT "userId", unnest(range(t0_ms, t1_ms + 1, 1000)) AS ts_ms FROM sessions)""" + EVALUATED + """, pairs AS (SELECT * FROM evaluated WHERE t IS NOT NULL AND p IS NOT NULL)"""


@query(FRAMES + CLASSES[len(PAIRS) :] + """ SELECT class, support, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM f""")
def frame_evaluation(spark, sf):
    """Frames, one a second, of all sessions with the reference mode and the run of predicted windows that holds each."""
    both = intervals.frame_cells(T.intervals(spark, sf), predicted_runs(spark, sf), ["userId"], spans=built(spark, sf).select("userId", "t0_ms", "t1_ms"))
    return rounded(metrics.by_class(both.where("t is not null and p is not null"), "t", "p", "n"))


def predicted_runs(spark, sf) -> DataFrame:
    """Runs of equal predictions as intervals."""
    runs = smoothing.run_lengths(predictions(spark, sf), ["userId", "session_id"])
    return runs.select("userId", F.col("run_start").alias("started_at"), (F.col("run_end") + T.STEP_MS).alias("finished_at"), F.col("predicted").alias("mode"), F.col("run").alias("seq"))


@query(
    RUNS
    + """, ends AS (SELECT "userId", started_at, finished_at FROM intervals UNION ALL SELECT "userId", started_at, finished_at FROM runs),
frames AS (SELECT "userId", unnest(range(min(started_at), max(finished_at) + 1, 1000)) AS ts_ms FROM ends GROUP BY "userId")"""
    + EVALUATED
    + """, k AS (SELECT t, p, count(*) AS n FROM evaluated WHERE t IS NOT NULL OR p IS NOT NULL GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS frames, CAST(sum(n) FILTER (WHERE t IS NOT NULL AND p IS NOT NULL) AS BIGINT) AS comparable, CAST(sum(n) FILTER (WHERE p IS NULL) AS BIGINT) AS no_prediction,
  CAST(sum(n) FILTER (WHERE t IS NULL) AS BIGINT) AS no_truth, round(sum(n) FILTER (WHERE t = p) / sum(n) FILTER (WHERE t IS NOT NULL AND p IS NOT NULL), 4) AS accuracy FROM k"""
)
def frame_index(spark, sf):
    """All frames between the first start and the last end of a user: how many can be compared, and how many agree."""
    c = intervals.frame_cells(T.intervals(spark, sf), predicted_runs(spark, sf), ["userId"])
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    s = c.agg(n(F.lit(True)).alias("frames"), n(both).alias("comparable"), n(F.col("p").isNull()).alias("no_prediction"), n(F.col("t").isNull()).alias("no_truth"), n(F.col("t") == F.col("p")).alias("same"))
    return rounded(s.select("frames", "comparable", "no_prediction", "no_truth", F.try_divide("same", "comparable").alias("accuracy")))


SESSION_STARTS = LABELLED + """, starts AS (SELECT session_id, min(ts_start) AS start, count(*) AS w FROM labelled GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (ORDER BY start, session_id) - 1 AS i, count(*) OVER () AS n FROM starts)"""


@query(SESSION_STARTS + """, edges AS (SELECT k AS fold, CAST(floor((SELECT max(n) FROM numbered) * (0.5::DOUBLE + 0.1::DOUBLE * (k - 1))) AS BIGINT) AS lo, CAST(floor((SELECT max(n) FROM numbered) * (0.5::DOUBLE + 0.1::DOUBLE * k)) AS BIGINT) AS hi FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
blocks AS (SELECT fold, lo, hi, start AS block_start FROM edges JOIN numbered ON i = lo)
SELECT fold, block_start, CAST(sum(CASE WHEN NOT i BETWEEN lo AND hi - 1 AND start < block_start THEN w ELSE 0 END) AS BIGINT) AS n_train, CAST(sum(CASE WHEN i BETWEEN lo AND hi - 1 THEN w ELSE 0 END) AS BIGINT) AS n_test FROM blocks, numbered GROUP BY ALL HAVING n_test >= 10 AND n_train > 0""")
def splits_rolling(spark, sf):
    return splits.rolling(cut(labelled(spark, sf)))


@query(LABELLED + """, n AS (SELECT "userId" AS fold, count(*) AS n_test FROM labelled GROUP BY ALL) SELECT fold, n_test, CAST(sum(n_test) OVER () - n_test AS BIGINT) AS n_train FROM n""")
def split_louo(spark, sf):
    return splits.leave_one_user_out(labelled(spark, sf))


@query(SESSION_STARTS + """ SELECT CASE WHEN i >= n - greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) THEN 'test' ELSE 'train' END AS split, count(*) AS sessions, CAST(sum(w) AS BIGINT) AS windows FROM numbered GROUP BY ALL""")
def split_temporal(spark, sf):
    return splits.temporal(labelled(spark, sf)).groupBy("split").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("windows"))


@query(SESSION_STARTS + f""", drawn AS (SELECT w, row_number() OVER (ORDER BY {drawn_sql('session_id', seed=42)}, session_id) - 1 AS i, count(*) OVER () AS n FROM starts)
SELECT CASE WHEN i < greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) THEN 'test' ELSE 'train' END AS split, count(*) AS sessions, CAST(sum(w) AS BIGINT) AS windows FROM drawn GROUP BY ALL""")
def split_random(spark, sf):
    return splits.random_sessions(labelled(spark, sf)).groupBy("split").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("windows"))


@query(KINEMATICS + """, u AS (SELECT unnest(['B_speed_mean', 'B_stop_frac', 'B_path_efficiency', 'B_n_gps']) AS feature), c AS (SELECT feature, n_gps >= 3 AS present, CASE feature WHEN 'B_speed_mean' THEN speed_mean WHEN 'B_stop_frac' THEN stop_frac WHEN 'B_path_efficiency' THEN path_efficiency ELSE CAST(n_gps AS DOUBLE) END AS v FROM kin, u)
SELECT feature, round(100 * avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS pct_null, round(100 * coalesce(avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE present), 0), 3) AS pct_null_present FROM c GROUP BY ALL""")
def feature_audit(spark, sf):
    cols = ["B_speed_mean", "B_stop_frac", "B_path_efficiency", "B_n_gps"]
    a = selection.audit(kinematic(spark, sf), cols, F.col("B_n_gps") >= 3)
    return rounded(a.select("feature", "pct_null", "pct_null_present"), 3)


CORRELATED = ["x1", "x2", "x3", "x4"]
CORRELATED_SQL = """WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x1, l_quantity * 2 + l_linenumber AS x2, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS x3, l_tax AS x4 FROM lineitem)"""


def correlated(spark, sf) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(F.col("l_quantity").alias("x1"), (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("x2"), F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("x3"), F.col("l_tax").alias("x4"))


def _rho(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(ra, rb), 4) AS rho FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(CORRELATED_SQL + " " + " UNION ALL ".join(_rho(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]))
def spearman_matrix(spark, sf):
    return rounded(selection.spearman_pairs(correlated(spark, sf), CORRELATED))


@query(
    CORRELATED_SQL.replace("WITH t AS", "WITH RECURSIVE t AS") + ", rho AS (" + " UNION ALL ".join(_rho(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]) + """),
linked AS (SELECT a, b FROM rho WHERE abs(rho) >= 0.95 UNION SELECT b, a FROM rho WHERE abs(rho) >= 0.95),
reached AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON l.a = r.b),
nulls AS (SELECT unnest(['x1', 'x2', 'x3', 'x4']) AS c, unnest([count(*) - count(x1), count(*) - count(x2), count(*) - count(x3), count(*) - count(x4)]) AS n FROM t)
SELECT a AS feature, arg_min(b, (n, length(b), b)) AS representative FROM reached JOIN nulls ON c = b GROUP BY a HAVING representative <> a"""
)
def redundancy_clusters(spark, sf):
    return selection.redundancy(correlated(spark, sf), CORRELATED, 0.95)


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 <> 0 THEN l_discount END AS d, CASE WHEN l_linenumber > 2 THEN l_quantity END AS q, CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice END AS x FROM lineitem),
m AS (SELECT quantile_cont(d, 0.5) AS d, quantile_cont(q, 0.5) AS q, quantile_cont(x, 0.5) AS x FROM v)
SELECT l_orderkey, l_linenumber, round(coalesce(v.d, m.d), 4) AS d, round(coalesce(v.q, m.q), 4) AS q, round(coalesce(v.x, m.x), 4) AS x FROM v, m""")
def impute_median(spark, sf):
    """All rows, with the missing values of three columns filled by the columns' medians."""
    known = lambda c, test: F.when(test, F.col(c).cast("double"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", known("l_discount", F.col("l_orderkey") % 3 != 0).alias("d"), known("l_quantity", F.col("l_linenumber") > 2).alias("q"), known("l_extendedprice", F.col("l_suppkey") % 5 != 0).alias("x"))
    return rounded(models.impute(li, models.medians(li, ["d", "q", "x"])))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / (l_quantity + l_discount * 100 + l_tax * 100 + 1) AS a, l_discount * 100 / (l_quantity + l_discount * 100 + l_tax * 100 + 1) AS b, (l_tax * 100 + 1) / (l_quantity + l_discount * 100 + l_tax * 100 + 1) AS c FROM lineitem),
s AS (SELECT *, list_reverse_sort([a, b, c]) AS o FROM p)
SELECT l_orderkey, l_linenumber, round(1 - o[1], 4) AS least_confidence, round(-(a * ln(a) + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + c * ln(c)), 4) AS entropy, round(1 - (o[1] - o[2]), 4) AS margin FROM s""")
def active_scores(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    total = F.col("l_quantity") + F.col("l_discount") * 100 + F.col("l_tax") * 100 + 1
    p = [F.col("l_quantity") / total, F.col("l_discount") * 100 / total, (F.col("l_tax") * 100 + 1) / total]
    return rounded(li.select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in models.uncertainty(p).items()]))


@query(PAIRS + """ SELECT CASE WHEN l_orderkey % 3 = 0 THEN t ELSE p END AS mode, count(*) AS n FROM pairs GROUP BY ALL""")
def router(spark, sf):
    rows = pairs(spark, sf).withColumn("frac", F.col("l_orderkey") % 3)
    return rows.groupBy(models.routed(F.col("p"), F.col("t"), F.col("frac")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def training_rows(spark, sf) -> DataFrame:
    """Windows with silver labels and a few features."""
    return silver(spark, sf).where("silver_label is not null and B_speed_mean is not null")


@query()
def hier_rf(spark, sf):
    cols = ["B_speed_mean", "B_speed_max", "B_stop_frac", "C_osm_rail_prop", "C_bus_stops_prop"]
    rows = cut(training_rows(spark, sf).select(*KEYS, *cols, "silver_label"))
    classes = ["Still", "Walk", "Bus", "Car", "Train"]
    train = splits.temporal(rows)
    model = models.Hierarchical(cols, classes).fit(train.where("split = 'train'"), "silver_label")
    return model.predict(train.where("split = 'test'")).select(*KEYS, "silver_label", "predicted", "max_prob")


@query()
def hier_boosted(spark, sf):
    """The hierarchy with boosted stages, trained and tested as hier_rf is."""
    cols = ["B_speed_mean", "B_speed_max", "B_stop_frac", "C_osm_rail_prop", "C_bus_stops_prop"]
    rows = cut(training_rows(spark, sf).select(*KEYS, *cols, "silver_label"))
    train = splits.temporal(rows)
    model = models.Hierarchical(cols, ["Still", "Walk", "Bus", "Car", "Train"], learner="boosted").fit(train.where("split = 'train'"), "silver_label", rounds=6)
    return model.predict(train.where("split = 'test'")).select(*KEYS, "silver_label", "predicted", "max_prob")


REPLICATES = 40


@query(
    PAIRS
    + f""", c AS (SELECT l_orderkey AS k, t, p, count(*) AS n FROM pairs GROUP BY ALL), keys AS (SELECT DISTINCT k FROM c),
d AS (SELECT k, r, CAST('0x' || substr(md5(CAST(k AS VARCHAR) || '/' || CAST((r - 1) // 4 AS VARCHAR) || '/7'), 1 + 8 * ((r - 1) % 4), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM keys, (SELECT unnest(range(1, {REPLICATES + 1})) AS r)),
w AS (SELECT k, r, {" + ".join(f"CASE WHEN u > {x!r}::DOUBLE THEN 1 ELSE 0 END" for x in metrics.WEIGHTS)} AS w FROM d),
b AS (SELECT r, t, p, sum(n * w) AS w FROM c JOIN w USING (k) GROUP BY ALL),
s AS (SELECT r, t, p, w, sum(w) OVER (PARTITION BY r, t) AS tt, sum(w) OVER (PARTITION BY r, p) AS pp FROM b)
SELECT CAST(r AS INTEGER) AS replicate, round(coalesce(sum(CASE WHEN t = p AND tt + pp > 0 THEN 2 * w / CAST(tt + pp AS DOUBLE) END), 0) / count(DISTINCT CASE WHEN tt > 0 THEN t END), 4) AS macro_f1 FROM s GROUP BY r"""
)
def bootstrap_replicates(spark, sf):
    """Macro F1 of a few replicates, whose draws SQL repeats."""
    return rounded(metrics.bootstrap_f1(pairs(spark, sf), "l_orderkey", "t", "p", REPLICATES))


@query()
def bootstrap_ci(spark, sf):
    f = metrics.bootstrap_f1(pairs(spark, sf), "l_orderkey", "t", "p", 3000)
    return f.agg(F.percentile("macro_f1", F.lit(0.025)).alias("low"), F.avg("macro_f1").alias("mean"), F.percentile("macro_f1", F.lit(0.975)).alias("high"))


@query(PAIRS + """, g AS (SELECT l_orderkey % 997 AS k, count(*) AS n, count(*) FILTER (WHERE t = p) AS s FROM pairs GROUP BY ALL), r AS (SELECT k, row_number() OVER o AS i, sum(n) OVER o AS n, sum(s) OVER o AS s FROM g WINDOW o AS (ORDER BY k)),
f AS (SELECT i AS first, n, s FROM r UNION ALL SELECT 0, 0, 0), spans AS (SELECT f.first, r.i, (r.s - f.s) / (r.n - f.n)::DOUBLE AS mean FROM f JOIN r ON r.i > f.first), lows AS (SELECT first, i, min(mean) OVER (PARTITION BY first ORDER BY i DESC) AS low FROM spans)
SELECT k / 997.0::DOUBLE AS prob, round(max(low), 6) AS calibrated FROM lows JOIN r USING (i) GROUP BY k""")
def isotonic_calibration(spark, sf):
    """The fitted map at each probability; the SQL takes, of all runs that begin at or before it, the largest of the least means."""
    rows = pairs(spark, sf).withColumn("prob", (F.col("l_orderkey") % 997) / F.lit(997.0))
    fitted = metrics.isotonic(rows, "prob", F.col("t") == F.col("p"))
    points = rows.select("prob").distinct().select("prob", array_to_vector(F.array("prob")).alias("__f"))
    return fitted.transform(points).select("prob", (F.round("prediction", 6) + 0.0).alias("calibrated"))


_MASKED = f"""n > 0 AND {drawn_sql('"userId"', 'session_id', 'ts_start', seed=42)} < 0.7"""


@query(CASCADE + f""" SELECT f."userId", f.session_id, f.ts_start, CASE WHEN {_MASKED} THEN NULL ELSE n END AS "B_n_gps", round(CASE WHEN {_MASKED} THEN NULL ELSE k.speed_mean END, 4) AS "B_speed_mean", round(CASE WHEN {_MASKED} THEN NULL ELSE rail END, 4) AS "C_osm_rail_prop" FROM feat f LEFT JOIN kin k USING ("userId", session_id, ts_start)""")
def masked_positions(spark, sf):
    """All windows, a share of which lost their positions."""
    rows = feature_windows(spark, sf).withColumn("gps_frac", F.col("B_n_gps") / F.lit(120.0))
    return rounded(quality.mask_positions(rows, 0.7, 42, KEYS).select(*KEYS, "B_n_gps", "B_speed_mean", "C_osm_rail_prop"))


def city():
    from ..config import City

    return City("view", session={"gap_s": T.GAP_S, "min_duration_s": T.MIN_S}, window={"win_s": 120.0, "step_s": 60.0})


@query()
def feature_table(spark, sf):
    """The window table with all 230 features, from the processing workflow."""
    from . import workflows

    places = T.layer(spark, sf)
    return workflows.process(T.fixes(spark, sf), T.samples(spark, sf), city(), {"bus_stops": places, "osm_rail": T.layer(spark, sf, "customer")}, T.intervals(spark, sf))


@query()
def workflow_predictions(spark, sf):
    """Process, label, train and predict in one go, with small forests."""
    from . import workflows

    table = cut(workflows.label(feature_table(spark, sf), city()))
    done = workflows.train(table, city(), numTrees=10, maxDepth=6)
    return workflows.predict(table, done.model, city())


@query(CASCADE + """ SELECT w.label, count(*) AS n, round(avg(CASE WHEN w.label = c.silver THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS agreement, round(avg(CASE WHEN c.silver IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS abstained FROM casc c JOIN (SELECT * FROM (""" + LABELLED.replace("WITH points", "WITH points", 1) + """ SELECT "userId", session_id, ts_start, label FROM labelled) x) w USING ("userId", session_id, ts_start) WHERE w.label IS NOT NULL GROUP BY ALL""")
def rule_agreement(spark, sf):
    """How often the cascade agrees with the reference label, and abstains."""
    both = silver(spark, sf).join(labelled(spark, sf).select(*KEYS, "label"), KEYS).where("label is not null")
    agree = F.coalesce((F.col("label") == F.col("silver_label")).cast("double"), F.lit(0.0))
    return rounded(both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(agree).alias("agreement"), F.avg(F.col("silver_label").isNull().cast("double")).alias("abstained")))


@query(CASCADE + """ SELECT silver, count(*) AS n, count(*) FILTER (WHERE s > CASE silver WHEN 'Still' THEN 0.1 WHEN 'Walk' THEN 2.0 WHEN 'Bus' THEN 10 WHEN 'Car' THEN 18 ELSE 1000 END) AS impossible FROM casc WHERE silver IS NOT NULL GROUP BY ALL""")
def physics_bounds(spark, sf):
    from ..operators.evaluation import physics_flags

    rows = silver(spark, sf).where("silver_label is not null")
    flagged = physics_flags(rows, "silver_label", F.coalesce("B_speed_mean", F.lit(0.0)), {"Still": 0.1, "Walk": 2.0, "Bus": 10.0, "Car": 18.0})
    return flagged.groupBy(F.col("silver_label").alias("silver")).agg(F.count(F.lit(1)).alias("n"), F.count_if("impossible").alias("impossible"))
