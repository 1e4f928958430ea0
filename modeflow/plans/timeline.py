"""Sessions, windows, features, interval joins and places over the trajectory view."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.quantiles import quantiles
from ..operators import gps, imu, intervals, quality, sessions, spatial, windows
from ..session import cut
from . import trajectory as T
from .registry import query, rounded

KEYS = ["userId", "session_id", "ts_start"]
SESSIONS = T.SESSIONS_SQL


def built(spark, sf) -> DataFrame:
    return sessions.build(T.fixes(spark, sf), T.samples(spark, sf), T.GAP_S, T.MIN_S)


class View:
    """Sessions and anchors of the view, computed once for all that a query builds on them: one row for each session."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def spans(self) -> DataFrame:
        """Sessions with samples."""
        return cut(sessions.processable(built(self.spark, self.sf)).select("userId", "session_id", "t0_ms", "t1_ms"))

    @cached_property
    def anchors(self) -> DataFrame:
        """Those sessions, anchored at their first and last sample."""
        return cut(windows.anchors(self.inside(T.samples(self.spark, self.sf)), ["userId", "session_id"]))

    @cached_property
    def windows(self) -> DataFrame:
        return windows.sliding(self.anchors, T.WIN_MS, T.STEP_MS)

    def inside(self, points: DataFrame) -> DataFrame:
        return sessions.within(points, self.spans, ["userId"]).drop("t0_ms", "t1_ms")

    def assigned(self, points: DataFrame) -> DataFrame:
        return windows.assign(self.inside(points), self.anchors, ["userId", "session_id"], T.WIN_MS, T.STEP_MS)

    def kinematics(self) -> DataFrame:
        return gps.kinematics(self.assigned(quality.accuracy_filter(T.fixes(self.spark, self.sf))), KEYS)

    def labelled(self, least: float = 0.8) -> DataFrame:
        return intervals.overlap_labels(self.windows, T.intervals(self.spark, self.sf), ["userId"], ["session_id"], least)


#: Windows of the view in SQL, and the accurate fixes of each.
WINDOWS = (
    SESSIONS
    + """,
work AS (SELECT * FROM sessions WHERE type <> 'gps_only'),
anchored AS (SELECT w."userId", w.session_id, min(p."timestamp") AS anchor, max(p."timestamp") AS last FROM work w JOIN samples p ON p."userId" = w."userId" AND p."timestamp" BETWEEN w.t0_ms AND w.t1_ms GROUP BY ALL),
windows AS (SELECT "userId", session_id, anchor + 60000 * k AS ts_start, anchor + 60000 * k + 120000 AS ts_end FROM anchored, LATERAL (SELECT unnest(range(0, (last + 60000 - 120000 - anchor) // 60000 + 1)) AS k) WHERE last - 60000 >= anchor),
wfix AS (SELECT w."userId", w.session_id, w.ts_start, f.event_id, f."timestamp", latitude, longitude, speed, accuracy
  FROM windows w JOIN work s USING ("userId", session_id) JOIN fixes f ON f."userId" = w."userId" AND f."timestamp" BETWEEN w.ts_start AND w.ts_end AND f."timestamp" BETWEEN s.t0_ms AND s.t1_ms)"""
)
OK_FIX = WINDOWS + """, ok AS (SELECT * FROM wfix WHERE accuracy IS NULL OR accuracy <= 50)"""


@query(SESSIONS + """ SELECT session_id, "userId", t0_ms, t1_ms, dur_s, n_gps, n_imu, type FROM sessions""")
def sessionize_union(spark, sf):
    return built(spark, sf).drop("imu_hz")


@query(SESSIONS + """ SELECT session_id, "userId", round(imu_hz, 4) AS imu_hz FROM sessions""")
def session_rate(spark, sf):
    return rounded(built(spark, sf).select("session_id", "userId", "imu_hz"))


@query(SESSIONS + """ SELECT type, count(*) AS n FROM sessions WHERE type <> 'gps_only' GROUP BY ALL""")
def session_filter(spark, sf):
    return sessions.processable(built(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(T.SQL + """, g AS (SELECT "userId", "timestamp" - lag("timestamp") OVER (PARTITION BY "userId" ORDER BY "timestamp", event_id) AS d, "timestamp" // 86400 AS day FROM fixes)
SELECT "userId", quantile_cont(d, 0.5) AS gap, count(DISTINCT day) AS days FROM g GROUP BY ALL""")
def fix_intervals(spark, sf):
    w = W.partitionBy("userId").orderBy("timestamp", "event_id")
    g = T.fixes(spark, sf).withColumn("d", F.col("timestamp") - F.lag("timestamp").over(w))
    middle = quantiles(g, ["userId"], {"gap": F.col("d")}, [0.5]).select("userId", F.col("gap")[0].alias("gap"))
    return middle.join(g.groupBy("userId").agg(F.count_distinct(F.expr("timestamp div 86400")).alias("days")), "userId").select("userId", "gap", "days")


@query(WINDOWS + """ SELECT * FROM windows""")
def sliding_windows(spark, sf):
    return View(spark, sf).windows


@query(T.SQL + """, t AS (SELECT i."userId", i.seq, i.mode, i.started_at + ((f."timestamp" - i.started_at) // 120000) * 120000 AS ts_start, f.event_id FROM intervals i JOIN fixes f ON f."userId" = i."userId" AND f."timestamp" BETWEEN i.started_at AND i.finished_at)
SELECT "userId", seq, mode, ts_start, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 3""")
def tumbling_segments(spark, sf):
    seg = T.intervals(spark, sf).withColumnsRenamed({"started_at": "t0_ms", "finished_at": "t1_ms"})
    rows = windows.tumbling(T.fixes(spark, sf), seg, ["userId"])
    return rows.groupBy("userId", "seq", "mode", "ts_start").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(WINDOWS + """ SELECT "userId", session_id, ts_start, event_id FROM wfix""")
def window_assign(spark, sf):
    return View(spark, sf).assigned(T.fixes(spark, sf)).select(*KEYS, "event_id")


PAIRS = (
    OK_FIX
    + """, lagged AS (SELECT *, lag("timestamp") OVER w AS pt, radians(lag(latitude) OVER w) AS a, radians(latitude) AS b, radians(lag(longitude) OVER w) AS c, radians(longitude) AS d,
  (lag(CASE WHEN speed BETWEEN 0 AND 60 THEN speed END) OVER w + CASE WHEN speed BETWEEN 0 AND 60 THEN speed END) / 2 AS chip FROM ok WINDOW w AS (PARTITION BY "userId", session_id, ts_start ORDER BY "timestamp", event_id)),
pairs AS (SELECT *, ("timestamp" - pt) / 1000.0::DOUBLE AS dt, ("timestamp" + pt) / 2000.0::DOUBLE AS mid, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin((d - c) / 2) ** 2))) AS dist,
  degrees(atan2(sin(d - c) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d - c))) AS direction FROM lagged WHERE pt IS NOT NULL),
speeds AS (SELECT *, coalesce(chip, CASE WHEN dt > 0 AND dt < 60 AND dist / dt <= 60 THEN dist / dt END) AS sv FROM pairs),
valid AS (SELECT *, abs(sv - lag(sv) OVER w) AS acc, abs(direction - lag(direction) OVER w) AS bc, row_number() OVER w AS i, count(*) OVER (PARTITION BY "userId", session_id, ts_start) AS n FROM speeds WHERE sv IS NOT NULL
  WINDOW w AS (PARTITION BY "userId", session_id, ts_start ORDER BY "timestamp", event_id)),
counts AS (SELECT "userId", session_id, ts_start, count(*) AS n_gps, arg_min(struct_pack(la := radians(latitude), lo := radians(longitude)), ("timestamp", event_id)) AS f, arg_max(struct_pack(la := radians(latitude), lo := radians(longitude)), ("timestamp", event_id)) AS l FROM ok GROUP BY ALL),
moving AS (SELECT "userId", session_id, ts_start, count(*) AS nv, avg(sv) AS speed_mean, stddev_pop(sv) AS speed_std, max(sv) AS speed_max, quantile_cont(sv, 0.25) AS p25, quantile_cont(sv, 0.5) AS p50, quantile_cont(sv, 0.95) AS p95, sum(dist) AS dist_total,
  avg(acc) AS acc_mean, stddev_pop(acc) AS acc_std, count(*) FILTER (WHERE sv < 1) AS n_stops, avg(CASE WHEN sv < 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS stop_frac, avg(CASE WHEN bc > 180 THEN 360 - bc ELSE bc END) AS bearing_change,
  avg(CASE WHEN acc IS NULL THEN NULL WHEN acc > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS speed_change_rate, CASE WHEN count(*) >= 5 THEN regr_slope(sv, (i - 1) / CAST(n - 1 AS DOUBLE)) END AS trend FROM valid GROUP BY ALL HAVING count(*) >= 2),
close AS (SELECT "userId", session_id, ts_start, count(*) FILTER (WHERE dt <= 30) AS n_close FROM pairs GROUP BY ALL)"""
)
#: The B features of accurate fixes in SQL, with missing values where fixes or valid pairs are too few.
KINEMATICS = (
    PAIRS
    + """, kin AS (SELECT c."userId", c.session_id, c.ts_start, n_gps, CASE WHEN n_gps >= 3 THEN n_close END AS n_valid_pairs, m.* EXCLUDE ("userId", session_id, ts_start),
  CASE WHEN dist_total > 1 THEN least(1.0::DOUBLE, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin((l.la - f.la) / 2) ** 2 + cos(f.la) * cos(l.la) * sin((l.lo - f.lo) / 2) ** 2))) / dist_total) END AS path_efficiency
FROM counts c LEFT JOIN close p USING ("userId", session_id, ts_start) LEFT JOIN moving m ON m."userId" = c."userId" AND m.session_id = c.session_id AND m.ts_start = c.ts_start AND n_gps >= 3)"""
)


def kinematic(spark, sf) -> DataFrame:
    return View(spark, sf).kinematics()


@query(KINEMATICS + """ SELECT "userId", session_id, ts_start, n_gps AS "B_n_gps", n_valid_pairs AS "B_n_valid_pairs", round(speed_mean, 4) AS "B_speed_mean", round(speed_std, 4) AS "B_speed_std", round(speed_max, 4) AS "B_speed_max",
  round(p25, 4) AS "B_speed_p25", round(p50, 4) AS "B_speed_p50", round(p95, 4) AS "B_speed_p95", round(dist_total, 2) AS "B_dist_total_m", round(acc_mean, 4) AS "B_acc_mean", round(acc_std, 4) AS "B_acc_std", n_stops AS "B_n_stops", round(stop_frac, 4) AS "B_stop_frac",
  round(bearing_change, 4) AS "B_bearing_change_mean", round(speed_change_rate, 4) AS "B_speed_change_rate" FROM kin""")
def gps_kinematics(spark, sf):
    k = kinematic(spark, sf)
    names = ["B_speed_mean", "B_speed_std", "B_speed_max", "B_speed_p25", "B_speed_p50", "B_speed_p95", "B_acc_mean", "B_acc_std", "B_stop_frac", "B_bearing_change_mean", "B_speed_change_rate"]
    return k.select(*KEYS, "B_n_gps", "B_n_valid_pairs", F.round("B_dist_total_m", 2).alias("B_dist_total_m"), "B_n_stops", *[(F.round(c, 4) + 0.0).alias(c) for c in names])


@query(KINEMATICS + """, high AS (SELECT "userId", session_id, ts_start, CASE WHEN event_id % 10 > 0 THEN 180 + CAST(event_id * 43 % 211 AS DOUBLE) / 2 END AS altitude FROM ok), alt AS (SELECT "userId", session_id, ts_start, avg(altitude) AS m, stddev_pop(altitude) AS s, max(altitude) - min(altitude) AS r FROM high GROUP BY ALL HAVING count(altitude) >= 3)
SELECT "userId", session_id, ts_start, round(m, 4) AS "B_alt_mean", round(s, 4) AS "B_alt_std", round(r, 4) AS "B_alt_range" FROM kin JOIN alt USING ("userId", session_id, ts_start) WHERE speed_mean IS NOT NULL""")
def gps_altitude(spark, sf):
    """Altitudes of the windows: the view's fixes with a made-up height, a tenth of them without a valid one."""
    height = F.when(F.col("event_id") % 10 > 0, F.lit(180.0) + (F.col("event_id") * 43 % 211).cast("double") / 2).otherwise(-9999.0)
    fixes = quality.accuracy_filter(T.fixes(spark, sf)).withColumn("altitude", height)
    k = gps.kinematics(View(spark, sf).assigned(fixes), KEYS)
    return rounded(k.where("B_alt_mean is not null").select(*KEYS, "B_alt_mean", "B_alt_std", "B_alt_range"))


@query(KINEMATICS + """ SELECT "userId", session_id, ts_start, round(path_efficiency, 4) AS "B_path_efficiency" FROM kin WHERE path_efficiency IS NOT NULL""")
def path_efficiency(spark, sf):
    return rounded(kinematic(spark, sf).where("B_path_efficiency is not null").select(*KEYS, "B_path_efficiency"))


@query(KINEMATICS + """ SELECT "userId", session_id, ts_start, round(trend, 4) AS "B_speed_trend" FROM kin WHERE trend IS NOT NULL""")
def speed_trend(spark, sf):
    return rounded(kinematic(spark, sf).where("B_speed_trend is not null").select(*KEYS, "B_speed_trend"))


@query(PAIRS + """, runs AS (SELECT *, sum(change) OVER w AS run FROM (SELECT *, CASE WHEN (sv < 1) <> lag(sv < 1) OVER w THEN 1 ELSE 0 END AS change FROM valid WINDOW w AS (PARTITION BY "userId", session_id, ts_start ORDER BY "timestamp", event_id)) WINDOW w AS (PARTITION BY "userId", session_id, ts_start ORDER BY "timestamp", event_id)),
grouped AS (SELECT "userId", session_id, ts_start, run, bool_and(sv < 1) AS slow, min(mid) AS start, max(mid) AS last FROM runs GROUP BY ALL),
ends AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY "userId", session_id, ts_start ORDER BY run), last) - start AS dwell FROM grouped)
SELECT "userId", session_id, ts_start, round(start, 3) AS start, round(dwell, 3) AS dwell FROM ends WHERE slow AND dwell >= 3""")
def stop_detection(spark, sf):
    fixes = View(spark, sf).assigned(quality.accuracy_filter(T.fixes(spark, sf)))
    valid = gps.pairs(fixes, KEYS).where("sv is not null")
    return rounded(gps.stops(valid, KEYS), 3)


@query(WINDOWS + """, g AS (SELECT *, ("timestamp" - lag("timestamp") OVER (PARTITION BY "userId", session_id, ts_start ORDER BY "timestamp", event_id)) / 1000.0::DOUBLE AS gap FROM wfix)
SELECT "userId", session_id, ts_start, round(CASE WHEN count(accuracy) = count(*) THEN avg(accuracy) END, 4) AS "D_acc_mean", CASE WHEN count(accuracy) = count(*) THEN max(accuracy) END AS "D_acc_max",
  CASE WHEN count(accuracy) = count(*) AND quantile_cont(accuracy, 0.5) <= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "D_has_reliable_gps", count(*) FILTER (WHERE gap > 30) AS "D_n_gaps", round(least(1.0::DOUBLE, coalesce(sum(gap) FILTER (WHERE gap > 30), 0) / 120.0::DOUBLE), 6) AS "D_gap_fraction" FROM g GROUP BY ALL""")
def gps_gaps(spark, sf):
    q = gps.quality(View(spark, sf).assigned(T.fixes(spark, sf)), KEYS)
    return q.withColumns({"D_acc_mean": F.round("D_acc_mean", 4) + 0.0, "D_gap_fraction": F.round("D_gap_fraction", 6) + 0.0})


@query(WINDOWS + """ SELECT w."userId", w.session_id, w.ts_start, round(count(f.event_id) / 120.0::DOUBLE, 4) AS gps_frac, count(f.event_id) / 120.0::DOUBLE <= 0.025::DOUBLE AS used FROM windows w LEFT JOIN wfix f USING ("userId", session_id, ts_start) GROUP BY ALL""")
def gps_density(spark, sf):
    view = View(spark, sf)
    n = view.assigned(T.fixes(spark, sf)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_gps"))
    frac, used = gps.density("n_gps", 120.0, 0.025)
    return rounded(view.windows.join(n, KEYS, "left").withColumn("n_gps", F.coalesce("n_gps", F.lit(0))).select(*KEYS, frac.alias("gps_frac"), used.alias("used")))


Z = T.SQL + """, z AS (SELECT "userId", event_id, "timestamp", gyr_x, gyr_y, gyr_z, sqrt(gyr_x * gyr_x + gyr_y * gyr_y + gyr_z * gyr_z) AS gyr_mag,
  CASE WHEN stddev_pop(acc_x) OVER u > 1e-6 THEN (acc_x - avg(acc_x) OVER u) / stddev_pop(acc_x) OVER u ELSE acc_x END AS ax, CASE WHEN stddev_pop(acc_y) OVER u > 1e-6 THEN (acc_y - avg(acc_y) OVER u) / stddev_pop(acc_y) OVER u ELSE acc_y END AS ay,
  CASE WHEN stddev_pop(acc_z) OVER u > 1e-6 THEN (acc_z - avg(acc_z) OVER u) / stddev_pop(acc_z) OVER u ELSE acc_z END AS az FROM samples WINDOW u AS (PARTITION BY "userId")),
m AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS acc_mag FROM z)"""


def _moments(x: str, name: str) -> str:
    mu, sd = f"avg({x}) OVER u", f"stddev_pop({x}) OVER u"
    return f"({x} - {mu}) / nullif({sd}, 0) AS {name}"


@query(Z + f""", s AS (SELECT *, {_moments('acc_mag', 'zm')}, {_moments('gyr_x', 'zg')}, sign(gyr_x) <> sign(lag(gyr_x) OVER w) AS crossed FROM m WINDOW u AS (PARTITION BY "userId"), w AS (PARTITION BY "userId" ORDER BY "timestamp", event_id))
SELECT "userId", round(coalesce(avg(zm ** 3), 0), 3) AS "A_acc_mag_skew", round(coalesce(avg(zm ** 4) - 3, 0), 3) AS "A_acc_mag_kurt", round(quantile_cont(acc_mag, 0.75) - quantile_cont(acc_mag, 0.25), 4) AS "A_acc_mag_iqr", round(avg(acc_mag), 4) AS "A_acc_mag_mean", round(sqrt(avg(acc_mag * acc_mag)), 4) AS "A_acc_mag_rms",
  round(max(acc_mag) - min(acc_mag), 4) AS "A_acc_mag_ptp", round(avg(abs(ax) + abs(ay) + abs(az)), 4) AS "A_acc_sma", round(coalesce(avg(zg ** 3), 0), 3) AS "A_gyr_x_skew", round(count(*) FILTER (WHERE crossed) / CAST(count(*) AS DOUBLE), 4) AS "A_gyr_x_zcr", round(stddev_pop(gyr_x), 4) AS "A_gyr_x_std", round(avg(gyr_mag) / (avg(acc_mag) + 1e-6), 4) AS "A_gyr_acc_ratio"
FROM s GROUP BY ALL""")
def imu_stats(spark, sf):
    s = imu.statistics(T.samples(spark, sf), ["userId"])
    three = {"A_acc_mag_skew", "A_acc_mag_kurt", "A_gyr_x_skew"}
    names = ["A_acc_mag_skew", "A_acc_mag_kurt", "A_acc_mag_iqr", "A_acc_mag_mean", "A_acc_mag_rms", "A_acc_mag_ptp", "A_acc_sma", "A_gyr_x_skew", "A_gyr_x_zcr", "A_gyr_x_std", "A_gyr_acc_ratio"]
    return s.select("userId", *[(F.round(c, 3 if c in three else 4) + 0.0).alias(c) for c in names])


@query(Z + """, c AS (SELECT "userId", ax - avg(ax) OVER u AS x, ay - avg(ay) OVER u AS y, az - avg(az) OVER u AS z FROM m WINDOW u AS (PARTITION BY "userId"))
SELECT "userId", round(CASE WHEN sqrt(sum(x * x) * sum(y * y)) < 1e-10 THEN 0 ELSE sum(x * y) / sqrt(sum(x * x) * sum(y * y)) END, 4) AS "A_acc_corr_xy", round(CASE WHEN sqrt(sum(x * x) * sum(z * z)) < 1e-10 THEN 0 ELSE sum(x * z) / sqrt(sum(x * x) * sum(z * z)) END, 4) AS "A_acc_corr_xz",
  round(CASE WHEN sqrt(sum(y * y) * sum(z * z)) < 1e-10 THEN 0 ELSE sum(y * z) / sqrt(sum(y * y) * sum(z * z)) END, 4) AS "A_acc_corr_yz" FROM c GROUP BY ALL""")
def imu_corr(spark, sf):
    return rounded(imu.statistics(T.samples(spark, sf), ["userId"]).select("userId", *[f"A_acc_corr_{p}" for p in ("xy", "xz", "yz")]))


@query(Z + """, j AS (SELECT "userId", sqrt((ax - lag(ax) OVER w) ** 2 + (ay - lag(ay) OVER w) ** 2 + (az - lag(az) OVER w) ** 2) * 50 AS jerk FROM m WINDOW w AS (PARTITION BY "userId" ORDER BY "timestamp", event_id))
SELECT "userId", round(avg(jerk), 4) AS "A_jerk_mean", round(stddev_pop(jerk), 4) AS "A_jerk_std", round(quantile_cont(jerk, 0.75) - quantile_cont(jerk, 0.25), 4) AS "A_jerk_iqr" FROM j WHERE jerk IS NOT NULL GROUP BY ALL""")
def imu_jerk(spark, sf):
    return rounded(imu.jerk(T.samples(spark, sf), ["userId"]).select("userId", "A_jerk_mean", "A_jerk_std", "A_jerk_iqr"))


@query(Z + """, c AS (SELECT *, acc_mag - avg(acc_mag) OVER (PARTITION BY "userId") AS x FROM m), l AS (SELECT "userId", x, lead(x, 2) OVER w AS x2, lead(x, 5) OVER w AS x5 FROM c WINDOW w AS (PARTITION BY "userId" ORDER BY "timestamp", event_id))
SELECT "userId", round(CASE WHEN count(*) > 10 THEN CASE WHEN sum(x * x) > 1e-12 THEN sum(x * x2) / sum(x * x) ELSE 0 END END, 4) AS "A_acc_autocorr_2", round(CASE WHEN count(*) > 10 THEN CASE WHEN sum(x * x) > 1e-12 THEN sum(x * x5) / sum(x * x) ELSE 0 END END, 4) AS "A_acc_autocorr_5" FROM l GROUP BY ALL""")
def imu_autocorr(spark, sf):
    return rounded(imu.autocorrelation(T.samples(spark, sf), ["userId"], {"2": 2, "5": 5}, least=10))


@query(T.SQL + """, b AS (SELECT "userId", CASE WHEN lo = hi THEN 5 ELSE least(9, CAST(floor((gyr_x - lo) * 10 / (hi - lo)) AS BIGINT)) END AS bin FROM (SELECT "userId", gyr_x, min(gyr_x) OVER (PARTITION BY "userId") AS lo, max(gyr_x) OVER (PARTITION BY "userId") AS hi FROM samples)),
c AS (SELECT "userId", bin, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY "userId") AS DOUBLE) AS p, sum(n) OVER (PARTITION BY "userId") AS total FROM c)
SELECT "userId", round(CASE WHEN max(total) < 2 THEN 0 ELSE -sum(p * log2(p + 1e-12)) / log2(10) END, 4) + 0 AS value_entropy FROM p GROUP BY ALL""")
def value_entropy(spark, sf):
    return rounded(imu.value_entropy(T.samples(spark, sf), ["userId"], "gyr_x"))


@query(T.SQL + """, t AS (SELECT "userId", gyr_x, ntile(10) OVER (PARTITION BY "userId" ORDER BY "timestamp", event_id) AS part FROM samples), m AS (SELECT "userId", part, abs(avg(gyr_x)) + 1e-12 AS m FROM t GROUP BY ALL), p AS (SELECT "userId", m / sum(m) OVER (PARTITION BY "userId") AS p FROM m)
SELECT "userId", round(CASE WHEN count(*) < 10 THEN 0 ELSE -sum(p * log2(p)) / log2(10) END, 4) AS time_entropy FROM p GROUP BY ALL""")
def time_entropy(spark, sf):
    return rounded(imu.time_entropy(T.samples(spark, sf), ["userId"], "gyr_x"))


@query(T.SQL + """, d AS (SELECT "userId", sqrt((gyr_x - 2 * lag(gyr_x, 1) OVER w + lag(gyr_x, 2) OVER w) ** 2 + (gyr_y - 2 * lag(gyr_y, 1) OVER w + lag(gyr_y, 2) OVER w) ** 2 + (gyr_z - 2 * lag(gyr_z, 1) OVER w + lag(gyr_z, 2) OVER w) ** 2) AS d2v, gyr_x, gyr_y, gyr_z, CASE WHEN lag(gyr_x) OVER w IS NOT NULL THEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (gyr_x * lag(gyr_x) OVER w + gyr_y * lag(gyr_y) OVER w + gyr_z * lag(gyr_z) OVER w) / (sqrt(gyr_x ** 2 + gyr_y ** 2 + gyr_z ** 2) * sqrt(lag(gyr_x) OVER w ** 2 + lag(gyr_y) OVER w ** 2 + lag(gyr_z) OVER w ** 2) + 1e-9)))) END AS angle FROM samples WINDOW w AS (PARTITION BY "userId" ORDER BY "timestamp", event_id))
SELECT "userId", round(CASE WHEN count(*) >= 4 THEN avg(d2v) END, 4) AS "A_gyr_d2v_mean", round(CASE WHEN count(*) >= 4 THEN quantile_cont(d2v, 0.95) END, 4) AS "A_gyr_d2v_p95", round(CASE WHEN count(*) >= 3 THEN var_samp(gyr_x) + var_samp(gyr_y) + var_samp(gyr_z) END, 4) AS eig_sum,
  round(CASE WHEN count(*) >= 3 THEN var_samp(gyr_x) ** 2 + var_samp(gyr_y) ** 2 + var_samp(gyr_z) ** 2 + 2 * (covar_samp(gyr_x, gyr_y) ** 2 + covar_samp(gyr_x, gyr_z) ** 2 + covar_samp(gyr_y, gyr_z) ** 2) END, 5) AS eig_squares,
  round(CASE WHEN count(*) >= 3 THEN var_samp(gyr_x) * (var_samp(gyr_y) * var_samp(gyr_z) - covar_samp(gyr_y, gyr_z) ** 2) - covar_samp(gyr_x, gyr_y) * (covar_samp(gyr_x, gyr_y) * var_samp(gyr_z) - covar_samp(gyr_y, gyr_z) * covar_samp(gyr_x, gyr_z)) + covar_samp(gyr_x, gyr_z) * (covar_samp(gyr_x, gyr_y) * covar_samp(gyr_y, gyr_z) - var_samp(gyr_y) * covar_samp(gyr_x, gyr_z)) END, 6) AS eig_product,
  round(CASE WHEN count(*) >= 4 THEN stddev_pop(d2v) END, 4) AS "A_gyr_d2v_std", round(CASE WHEN count(*) >= 4 THEN quantile_cont(d2v, 0.75) - quantile_cont(d2v, 0.25) END, 4) AS "A_gyr_d2v_iqr", round(CASE WHEN count(*) >= 3 THEN avg(angle) END, 4) AS "A_gyr_angle_mean", round(CASE WHEN count(*) >= 3 THEN stddev_pop(angle) END, 4) AS "A_gyr_angle_std" FROM d GROUP BY ALL""")
def imu_eigen(spark, sf):
    e = imu.rotation_invariant(T.samples(spark, sf), ["userId"], ("gyr_x", "gyr_y", "gyr_z"), "A_gyr")
    e1, e2, e3 = (F.col(f"A_gyr_eig{i}") for i in (1, 2, 3))  # which their sum, squares and product determine
    made = [F.round(e1 + e2 + e3, 4).alias("eig_sum"), F.round(e1 * e1 + e2 * e2 + e3 * e3, 5).alias("eig_squares"), F.round(e1 * e2 * e3, 6).alias("eig_product")]
    return e.select("userId", *[(F.round(c, 4) + 0.0).alias(c) for c in ("A_gyr_d2v_mean", "A_gyr_d2v_p95", "A_gyr_d2v_std", "A_gyr_d2v_iqr", "A_gyr_angle_mean", "A_gyr_angle_std")], *made)


#: Signals of the inertial features that SQL repeats: column of `sig`, prefix, with mean and so on, with crossings of zero.
_PACKS = [("acc_mag", "A_acc_mag", True, True), *[(f"a{a}", f"A_acc_{a}", False, False) for a in "xyz"], ("gyr_mag", "A_gyr_mag", True, True), *[(f"gyr_{a}", f"A_gyr_{a}", True, True) for a in "xyz"], ("jerk", "A_jerk", True, True)]
_CROSSED = [x for x, _, _, zcr in _PACKS if zcr]  # a z-scored axis may differ from 0 by rounding alone
_SPREADS = [(f"{n}_{q}", f"A_{n}_{q}", least) for n in ("acc", "gyr") for q, least in (("angle", 3), ("d2v", 4))]


def _packs() -> dict[str, str]:
    """Features by name, as SQL over a session's rows: columns are the signals, <signal>_z standardised and <signal>_c crossed."""
    out = {}
    for x, name, full, zcr in _PACKS:
        of = lambda sql, x=x: f"round(CASE WHEN count({x}) > 0 THEN {sql} END, 5) + 0"
        out |= {f"{name}_skew": of(f"coalesce(avg({x}_z ** 3), 0)"), f"{name}_kurt": of(f"coalesce(avg({x}_z ** 4) - 3, 0)"), f"{name}_iqr": of(f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)")}
        if zcr:
            out[f"{name}_zcr"] = of(f"count(*) FILTER (WHERE {x}_c) / count({x})::DOUBLE")
        if full:
            out |= {f"{name}_mean": of(f"avg({x})"), f"{name}_std": of(f"stddev_pop({x})"), f"{name}_rms": of(f"sqrt(avg({x} * {x}))")}
    for x, name, least in _SPREADS:
        of = lambda sql, least=least: f"round(CASE WHEN count(*) >= {least} THEN {sql} END, 5) + 0"
        out |= {f"{name}_mean": of(f"avg({x})"), f"{name}_std": of(f"stddev_pop({x})"), f"{name}_iqr": of(f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"), f"{name}_p95": of(f"quantile_cont({x}, 0.95)")}
    for n, axes in (("acc", ("ax", "ay", "az")), ("gyr", ("gyr_x", "gyr_y", "gyr_z"))):
        out[f"A_{n}_sma"] = f"round(avg({' + '.join(f'abs({a})' for a in axes)}), 5)"
        for a, b in ((0, 1), (0, 2), (1, 2)):
            x, y = axes[a], axes[b]
            norm = f"(count(*) * stddev_pop({x}) * stddev_pop({y}))"
            out[f"A_{n}_corr_{'xyz'[a]}{'xyz'[b]}"] = f"round(CASE WHEN {norm} < 1e-10 THEN 0 ELSE count(*) * covar_pop({x}, {y}) / {norm} END, 5) + 0"
    out |= {f"A_acc_mag_p{k}": f"round(quantile_cont(acc_mag, 0.{k}), 5)" for k in (25, 75)}
    out |= {"A_acc_mag_ptp": "round(max(acc_mag) - min(acc_mag), 5) + 0", "A_gyr_acc_ratio": "round(avg(gyr_mag) / (avg(acc_mag) + 1e-6), 5)"}
    return out


def _turned(axes: tuple[str, ...]) -> str:
    """The angle between a row's vector and the one before, in SQL."""
    dot = " + ".join(f"{a} * lag({a}) OVER w" for a in axes)
    norms = [f"sqrt({' + '.join(f'{v} * {v}' for v in vs)})" for vs in (axes, [f"lag({a}) OVER w" for a in axes])]
    return f"acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({dot}) / nullif({norms[0]} * {norms[1]} + 1e-9, 0))))"


def _bent(axes: tuple[str, ...]) -> str:
    return "sqrt(" + " + ".join(f"({a} - 2 * lag({a}) OVER w + lag({a}, 2) OVER w) ** 2" for a in axes) + ")"


_ACC, _GYR = ("ax", "ay", "az"), ("gyr_x", "gyr_y", "gyr_z")
_ORDER = """w AS (PARTITION BY "userId", session_id ORDER BY "timestamp", event_id), u AS (PARTITION BY "userId", session_id)"""
PACKS = (
    WINDOWS
    + f""", mine AS (SELECT s.session_id, p.* FROM work s JOIN samples p ON p."userId" = s."userId" AND p."timestamp" BETWEEN s.t0_ms AND s.t1_ms),
zed AS (SELECT "userId", session_id, event_id, "timestamp", gyr_x, gyr_y, gyr_z, {", ".join(f"CASE WHEN stddev_pop(acc_{a}) OVER u > 1e-6 THEN (acc_{a} - avg(acc_{a}) OVER u) / stddev_pop(acc_{a}) OVER u ELSE acc_{a} END AS a{a}" for a in "xyz")} FROM mine WINDOW {_ORDER}),
sig AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS acc_mag, sqrt(gyr_x * gyr_x + gyr_y * gyr_y + gyr_z * gyr_z) AS gyr_mag, 50.0::DOUBLE * sqrt({" + ".join(f"({a} - lag({a}) OVER w) ** 2" for a in _ACC)}) AS jerk, CASE WHEN lag(ax) OVER w IS NOT NULL THEN {_turned(_ACC)} END AS acc_angle, CASE WHEN lag(ax) OVER w IS NOT NULL THEN {_turned(_GYR)} END AS gyr_angle, {_bent(_ACC)} AS acc_d2v, {_bent(_GYR)} AS gyr_d2v FROM zed WINDOW {_ORDER}),
std AS (SELECT *, {", ".join(f"CASE WHEN stddev_pop({x}) OVER u >= 1e-10 THEN ({x} - avg({x}) OVER u) / stddev_pop({x}) OVER u END AS {x}_z" for x, *_ in _PACKS)}, {", ".join(f"sign({x}) <> lag(sign({x})) OVER w AS {x}_c" for x in _CROSSED)} FROM sig WINDOW {_ORDER})"""
)


@query(PACKS + f""" SELECT "userId", session_id, {", ".join(f'{sql} AS "{name}"' for name, sql in _packs().items())} FROM std GROUP BY ALL""")
def imu_packs(spark, sf):
    """Those inertial features of each session that SQL can repeat, by the operator behind `imu_full`."""
    from ..operators.spectral import features

    names = list(_packs())
    return rounded(features(View(spark, sf).inside(T.samples(spark, sf)), ["userId", "session_id"], columns=names), 5)


_FIELD = {"mag_x": ("gyr_x", 40.0, 21.0), "mag_y": ("gyr_y", 35.0, -7.0), "mag_z": ("gyr_z", 30.0, -40.0)}


@query(PACKS + f""", field AS (SELECT "userId", session_id, event_id, {", ".join(f"{x} * {by}::DOUBLE + {to}::DOUBLE AS {m}" for m, (x, by, to) in _FIELD.items())} FROM mine)
SELECT "userId", session_id, round(avg(sqrt(mag_x * mag_x + mag_y * mag_y + mag_z * mag_z)), 5) AS "A_mag_mag_mean", round(stddev_pop(sqrt(mag_x * mag_x + mag_y * mag_y + mag_z * mag_z)), 5) AS "A_mag_mag_std",
  {", ".join(f'round(CASE WHEN count(*) * stddev_pop(mag_{a}) * stddev_pop(mag_{b}) < 1e-10 THEN 0 ELSE covar_pop(mag_{a}, mag_{b}) / (stddev_pop(mag_{a}) * stddev_pop(mag_{b})) END, 5) + 0 AS "A_mag_corr_{a}{b}"' for a, b in ("xy", "xz", "yz"))} FROM field GROUP BY ALL""")
def imu_magnetometer(spark, sf):
    """Magnetometer features of each session: the view's samples with a field made of their rotations."""
    from ..operators.spectral import features

    samples = T.samples(spark, sf).withColumns({m: F.col(x) * by + to for m, (x, by, to) in _FIELD.items()})
    names = ["A_mag_mag_mean", "A_mag_mag_std", "A_mag_corr_xy", "A_mag_corr_xz", "A_mag_corr_yz"]
    return rounded(features(View(spark, sf).inside(samples), ["userId", "session_id"], columns=names), 5)


@query()
def imu_full(spark, sf):
    """All 188 inertial features of each session: filters and spectra in grouped Arrow batches."""
    from ..operators.spectral import features

    rows = View(spark, sf).inside(T.samples(spark, sf))
    return features(rows, ["userId", "session_id"])


@query()
def imu_spectrum(spark, sf):
    from ..operators.spectral import features

    return features(View(spark, sf).assigned(T.samples(spark, sf)), KEYS, columns=[f"A_acc_mag_{p}" for p in ("dom_freq", "spec_entropy", "psd_0_2", "psd_2_4", "psd_4_8", "psd_8_20")])


@query()
def imu_gravity(spark, sf):
    from ..operators.spectral import features

    return features(View(spark, sf).assigned(T.samples(spark, sf)), KEYS, columns=[f"A_grav_{a}_{s}" for a in ("x", "y", "z", "mag") for s in ("mean", "std")])


def labelled(spark, sf) -> DataFrame:
    return View(spark, sf).labelled()


LABELLED = WINDOWS + """, met AS (SELECT w."userId", w.session_id, w.ts_start, w.ts_end, i.mode, least(w.ts_end, i.finished_at) - greatest(w.ts_start, i.started_at) AS c, i.started_at, i.seq FROM windows w JOIN intervals i ON i."userId" = w."userId" AND i.started_at < w.ts_end AND i.finished_at > w.ts_start),
best AS (SELECT "userId", session_id, ts_start, arg_min(CASE WHEN c >= 0.8 * (ts_end - ts_start) THEN mode ELSE '' END, (-c, started_at, seq)) AS label FROM met GROUP BY ALL),
labelled AS (SELECT w.*, nullif(label, '') AS label FROM windows w LEFT JOIN best b USING ("userId", session_id, ts_start))"""


@query(LABELLED + """ SELECT "userId", session_id, ts_start, label FROM labelled""")
def interval_overlap_label(spark, sf):
    return labelled(spark, sf).select(*KEYS, "label")


ASOF = T.SQL + """, last_iv AS (SELECT f."userId", f.event_id, f."timestamp" AS ts_ms, CASE WHEN f."timestamp" <= i.finished_at THEN i.mode END AS label
FROM fixes f LEFT JOIN LATERAL (SELECT * FROM intervals i WHERE i."userId" = f."userId" AND i.started_at <= f."timestamp" ORDER BY i.started_at DESC, i.seq DESC LIMIT 1) i ON TRUE)"""


@query(ASOF + """ SELECT "userId", event_id, label FROM last_iv""")
def asof_segment(spark, sf):
    frames = T.fixes(spark, sf).select("userId", "event_id", F.col("timestamp").alias("ts_ms"))
    return intervals.as_of(frames, T.intervals(spark, sf), ["userId"]).select("userId", "event_id", "label")


TIMELINE = SESSIONS + """, frames AS (SELECT DISTINCT "userId", unnest(range(t0_ms, t1_ms + 1, 1000)) AS ts_ms FROM sessions)"""


@query(TIMELINE + """ SELECT "userId", count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM frames GROUP BY ALL""")
def frame_timeline(spark, sf):
    """How many frames of a second there are, without making one: sessions are disjoint."""
    more = F.floor((F.col("t1_ms") - F.col("t0_ms")) / 1000)
    return built(spark, sf).groupBy("userId").agg(F.sum(more + 1).alias("n"), F.min("t0_ms").alias("first_ms"), F.max(F.col("t0_ms") + 1000 * more).alias("last_ms"))


NEAREST = T.SQL + """, nearest AS (SELECT f."userId", f.event_id, f."timestamp", min(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(p.lat - f.latitude) / 2) ** 2 + cos(radians(f.latitude)) * cos(radians(p.lat)) * sin(radians(p.lon - f.longitude) / 2) ** 2)))) AS d FROM fixes f, places p GROUP BY ALL)"""


@query(NEAREST + """ SELECT "userId", event_id, round(d, 2) AS dist_m FROM nearest""")
def nearest_layer(spark, sf):
    points = T.fixes(spark, sf).select("userId", "event_id", "latitude", "longitude")
    return spatial.nearest(points, T.layer(spark, sf)).select("userId", "event_id", (F.round("dist_m", 2) + 0.0).alias("dist_m"))


@query(NEAREST + """, others AS (SELECT 46.07::DOUBLE + CAST((c_custkey * 7919) % 2003 AS DOUBLE) / 2003.0::DOUBLE * 0.01::DOUBLE AS lat, 11.12::DOUBLE + CAST((c_custkey * 104729) % 1999 AS DOUBLE) / 1999.0::DOUBLE * 0.01::DOUBLE AS lon FROM customer),
other AS (SELECT f."userId", f.event_id, min(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(p.lat - f.latitude) / 2) ** 2 + cos(radians(f.latitude)) * cos(radians(p.lat)) * sin(radians(p.lon - f.longitude) / 2) ** 2)))) AS o FROM fixes f, others p GROUP BY ALL)
SELECT "userId", round(avg(CASE WHEN d < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS "C_bus_stops_prop", round(avg(d), 2) AS "C_bus_stops_mean", CASE WHEN min(d) < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "C_bus_stops_flag", round(quantile_cont(d, 0.1), 2) AS "C_osm_rail_p10",
  round(avg(CASE WHEN d < 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS "C_osm_rail_prop", 0.0::DOUBLE AS "C_osm_subway_prop", round(min(o), 2) AS "C_osm_motorway_min", CASE WHEN min(o) < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "C_osm_motorway_flag",
  round(min(o), 2) AS "C_rail_stations_min", CASE WHEN min(o) < 500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "C_rail_stations_flag", round(avg(o), 2) AS "C_subway_stations_mean", CASE WHEN min(o) < 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "C_subway_stations_flag",
  CASE WHEN min(d) < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "C_osm_cycleway_flag", round(avg(d), 2) AS "C_osm_cycleway_mean", round(min(d), 2) AS "C_osm_cycleway_min" FROM nearest JOIN other USING ("userId", event_id) GROUP BY ALL""")
def proximity_features(spark, sf):
    points = T.fixes(spark, sf).select("userId", "event_id", "latitude", "longitude")
    near = spatial.nearest(points, T.layer(spark, sf), "d")
    near = spatial.nearest(near, T.layer(spark, sf, "customer"), "o")
    c = spatial.proximity(near, ["userId"], {"bus_stops": "d", "osm_rail": "d", "osm_cycleway": "d", "osm_motorway": "o", "rail_stations": "o", "subway_stations": "o"})
    return c.select("userId", *[(F.round(x, 2 if x.endswith(("mean", "min", "p10")) else 4) + 0.0).alias(x) for x in c.columns if x != "userId"])


@query(T.SQL + """, hit AS (SELECT DISTINCT f."userId", f.event_id, p.place_id % 7 AS shape FROM fixes f, places p WHERE 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(p.lat - f.latitude) / 2) ** 2 + cos(radians(f.latitude)) * cos(radians(p.lat)) * sin(radians(p.lon - f.longitude) / 2) ** 2))) < 50),
k AS (SELECT "userId", max(k) AS k FROM (SELECT "userId", shape, count(*) AS k FROM hit GROUP BY ALL) GROUP BY ALL), n AS (SELECT "userId", count(*) AS n FROM fixes GROUP BY ALL)
SELECT n."userId", round(CASE WHEN n.n >= 2 THEN coalesce(k.k, 0) / CAST(n.n AS DOUBLE) END, 4) AS align FROM n LEFT JOIN k USING ("userId")""")
def route_alignment(spark, sf):
    vertices = T.layer(spark, sf).select((F.col("place_id") % 7).alias("shape_id"), "lat", "lon")
    return rounded(spatial.aligned_share(T.fixes(spark, sf), vertices, ["userId"]))


@query(NEAREST + """ SELECT "userId", round(avg(CASE WHEN d < 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS rail_align FROM nearest GROUP BY ALL""")
def rail_alignment(spark, sf):
    points = T.fixes(spark, sf).select("userId", "event_id", "latitude", "longitude")
    return rounded(spatial.rail_align(spatial.nearest(points, T.layer(spark, sf), "d"), ["userId"], "d"))


@query(T.SQL + """, others AS (SELECT c_custkey AS id, 46.07::DOUBLE + CAST((c_custkey * 7919) % 2003 AS DOUBLE) / 2003.0::DOUBLE * 0.01::DOUBLE AS lat, 11.12::DOUBLE + CAST((c_custkey * 104729) % 1999 AS DOUBLE) / 1999.0::DOUBLE * 0.01::DOUBLE AS lon FROM customer)
SELECT id AS place_id FROM others o WHERE NOT EXISTS (SELECT 1 FROM places p WHERE 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(p.lat - o.lat) / 2) ** 2 + cos(radians(o.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - o.lon) / 2) ** 2))) <= 30)""")
def stop_merge_anti(spark, sf):
    return spatial.away_from(T.layer(spark, sf, "customer"), T.layer(spark, sf), 30.0).select("place_id")


@query(T.SQL + """, c AS (SELECT place_id, CAST(floor(lat * (6371000.0::DOUBLE * pi() / 180) / 100) AS BIGINT) AS r, CAST(floor(lon * (6371000.0::DOUBLE * pi() / 180) * cos(radians(46.0::DOUBLE)) / 100) AS BIGINT) AS k FROM places) SELECT min(place_id) AS place_id FROM c GROUP BY r, k""")
def grid_thin(spark, sf):
    return spatial.thin(T.layer(spark, sf), 100.0, "place_id", 46.0).select("place_id")


@query(T.SQL + """, s AS (SELECT place_id % 5 AS shape_id, place_id AS seq, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM places WINDOW w AS (PARTITION BY place_id % 5 ORDER BY place_id))
SELECT shape_id, round(sum(CASE WHEN la IS NULL THEN 0 ELSE 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(lat - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lat)) * sin(radians(lon - lo) / 2) ** 2))) END), 1) AS length_m FROM s GROUP BY ALL""")
def arc_length(spark, sf):
    v = T.layer(spark, sf).select((F.col("place_id") % 5).alias("shape_id"), F.col("place_id").alias("seq"), "lat", "lon")
    return rounded(spatial.arc_length(v).groupBy("shape_id").agg(F.max("along_m").alias("length_m")), 1)


@query(T.SQL + """, s AS (SELECT place_id % 5 AS shape_id, place_id AS seq, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM places WINDOW w AS (PARTITION BY place_id % 5 ORDER BY place_id)),
d AS (SELECT *, sum(CASE WHEN la IS NULL THEN 0 ELSE 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(lat - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lat)) * sin(radians(lon - lo) / 2) ** 2))) END) OVER (PARTITION BY shape_id ORDER BY seq) AS m FROM s),
e AS (SELECT *, lead(lat) OVER w AS la2, lead(lon) OVER w AS lo2, lead(m) OVER w AS m2 FROM d WINDOW w AS (PARTITION BY shape_id ORDER BY seq)),
k AS (SELECT *, unnest(range(CAST(ceil(m / 100) AS BIGINT), CAST(ceil(m2 / 100) AS BIGINT))) AS k FROM e WHERE m2 > m)
SELECT shape_id, k * 100.0::DOUBLE AS along_m, round(lat + (k * 100 - m) / (m2 - m) * (la2 - lat), 6) AS lat, round(lon + (k * 100 - m) / (m2 - m) * (lo2 - lon), 6) AS lon FROM k""")
def line_points(spark, sf):
    v = T.layer(spark, sf).select((F.col("place_id") % 5).alias("shape_id"), F.col("place_id").alias("seq"), "lat", "lon")
    return rounded(spatial.points_along(v, 100.0), 6)
