"""Kinematic and quality features of position fixes, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geo import bearing, haversine, turn
from ..functions.stats import pct, share, slope

CAP, CHANGE, STOP, STOP_S, PAIR_S, HAVERSINE_S = 60.0, 2.0, 1.0, 3.0, 30.0, 60.0


def pairs(fixes: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """Consecutive fixes of each group: dt (s), dist (m), direction, sv (m/s, null if none is valid), mid (s).

    sv is the mean of both fixes' own speeds where both are within 0 and CAP, else distance over time where that is valid.
    """
    w = W.partitionBy(*keys).orderBy("timestamp", tie)
    lat, lon = F.lag("latitude").over(w), F.lag("longitude").over(w)
    chip = F.when((F.col("speed") >= 0) & (F.col("speed") <= CAP), F.col("speed"))
    rows = fixes.withColumn("__chip", chip).select(
        *keys, "timestamp", tie, "latitude", "longitude", *[c for c in ("altitude",) if c in fixes.columns], F.lag("timestamp").over(w).alias("__t"), lat.alias("__lat"), lon.alias("__lon"), ((F.lag("__chip").over(w) + F.col("__chip")) / 2).alias("__mid")
    )
    here = [F.col(c) for c in ("__lat", "__lon", "latitude", "longitude")]
    dt = (F.col("timestamp") - F.col("__t")) / F.lit(1000.0)
    rows = rows.withColumn("dt", dt).withColumn("dist", haversine(*here)).withColumn("direction", bearing(*here))
    slow = F.when((F.col("dt") > 0) & (F.col("dt") < HAVERSINE_S), F.try_divide("dist", "dt"))
    sv = F.coalesce("__mid", F.when(slow <= CAP, slow))
    return rows.withColumn("sv", sv).withColumn("mid", (F.col("timestamp") + F.col("__t")) / F.lit(2000.0)).drop("__t", "__lat", "__lon", "__mid")


def stops(valid: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """keys, start and dwell (s) of the runs below STOP: from the first slow midpoint to the first fast one after it, or to
    the last midpoint, of at least STOP_S."""
    w = W.partitionBy(*keys).orderBy("timestamp", tie)
    slow = F.col("sv") < STOP
    change = F.coalesce((F.lag(slow).over(w) != slow).cast("int"), F.lit(0))
    runs = valid.withColumn("__slow", slow).withColumn("__change", change).withColumn("__run", F.sum("__change").over(w))
    runs = runs.groupBy(*keys, "__run", "__slow").agg(F.min("mid").alias("start"), F.max("mid").alias("__last"))
    dwell = F.coalesce(F.lead("start").over(W.partitionBy(*keys).orderBy("__run")), F.col("__last")) - F.col("start")
    return runs.withColumn("dwell", dwell).where(F.col("__slow") & (F.col("dwell") >= STOP_S)).select(*keys, "start", "dwell")


def kinematics(fixes: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """The 22 B features of each group; below 3 fixes only B_n_gps, below 2 valid pairs also B_n_valid_pairs.

    One exchange by the keys serves all windows, one aggregation and the runs of stops, which are joined where they are.
    """
    p = pairs(fixes, keys, tie)
    w = W.partitionBy(*keys).orderBy("timestamp", tie)
    ok = F.col("sv").isNotNull()
    last = F.last(F.when(ok, F.struct("sv", "direction")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = p.withColumn("__last", last).withColumns({
        "__acc": F.when(ok, F.abs(F.col("sv") - F.col("__last.sv"))), "__turn": F.when(ok, turn(F.col("__last.direction"), F.col("direction"))),
        "__i": F.when(ok, F.count("sv").over(w.rowsBetween(W.unboundedPreceding, 0))), "__n": F.count("sv").over(W.partitionBy(*keys)),
    })
    altitude = F.when(F.col("altitude") > -500, F.col("altitude")) if "altitude" in fixes.columns else F.lit(None).cast("double")
    enough = lambda x: F.when(F.count(altitude) >= 3, x)
    order = F.struct("timestamp", tie)
    moving = [
        F.avg("sv").alias("B_speed_mean"), F.stddev_pop("sv").alias("B_speed_std"), F.max("sv").alias("B_speed_max"), pct("sv", 0.25).alias("B_speed_p25"), pct("sv", 0.5).alias("B_speed_p50"), pct("sv", 0.95).alias("B_speed_p95"),
        F.sum(F.when(ok, F.col("dist"))).alias("B_dist_total_m"), F.avg("__acc").alias("B_acc_mean"), F.stddev_pop("__acc").alias("B_acc_std"), F.count_if(F.col("sv") < STOP).alias("B_n_stops"), share(F.col("sv") < STOP).alias("B_stop_frac"),
        F.avg("__turn").alias("B_bearing_change_mean"), share(F.col("__acc") > CHANGE).alias("B_speed_change_rate"),
        F.when(F.count("sv") >= 5, slope(F.when(ok, F.col("sv")), F.col("__i"), F.col("__n"))).alias("B_speed_trend"),
    ]
    whole = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("B_n_gps"), F.count("sv").alias("__valid"), F.count_if(F.col("dt") <= PAIR_S).alias("__pairs"), *moving,
        *[f(c, order).alias(f"__{n}_{c}") for n, f in (("a", F.min_by), ("z", F.max_by)) for c in ("latitude", "longitude")],
        enough(F.avg(altitude)).alias("__am"), enough(F.stddev_pop(altitude)).alias("__as"), enough(F.max(altitude) - F.min(altitude)).alias("__ar"),
    )
    halts = stops(p.where(ok), keys, tie)
    o = W.partitionBy(*keys).orderBy("start")
    halts = halts.withColumn("__gap", F.col("start") - F.lag("start").over(o)).groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.stddev_pop("__gap")).alias("B_stop_regularity"), F.avg("dwell").alias("B_dwell_mean"))
    joined = whole.join(halts, keys, "left")
    three = F.col("B_n_gps") >= 3
    has = (F.col("__valid") >= 2) & three
    displacement = haversine(F.col("__a_latitude"), F.col("__a_longitude"), F.col("__z_latitude"), F.col("__z_longitude"))
    made = [c for c in whole.columns if c.startswith("B_") and c != "B_n_gps"] + ["B_stop_regularity", "B_dwell_mean"]
    return joined.select(
        *keys, "B_n_gps", F.when(three, F.col("__pairs")).alias("B_n_valid_pairs"), *[F.when(has, F.col(c)).alias(c) for c in made],
        F.when(has & (F.col("B_dist_total_m") > 1), F.least(F.lit(1.0), displacement / F.col("B_dist_total_m"))).alias("B_path_efficiency"),
        F.when(has, F.col("__am")).alias("B_alt_mean"), F.when(has, F.col("__as")).alias("B_alt_std"), F.when(has, F.col("__ar")).alias("B_alt_range"),
    )


def quality(fixes: DataFrame, keys: list[str], win_s: float = 120.0, gap_s: float = 30.0, tie: str = "event_id") -> DataFrame:
    """The 5 D features; any fix without accuracy leaves the accuracy unknown and the group unreliable."""
    w = W.partitionBy(*keys).orderBy("timestamp", tie)
    gap = (F.col("timestamp") - F.lag("timestamp").over(w)) / F.lit(1000.0)
    whole = F.count("accuracy") == F.count(F.lit(1))
    return fixes.withColumn("__gap", gap).groupBy(*keys).agg(
        F.when(whole, F.avg("accuracy")).alias("D_acc_mean"), F.when(whole, F.max("accuracy")).alias("D_acc_max"), F.when(whole & (pct("accuracy", 0.5) <= 20), 1.0).otherwise(0.0).alias("D_has_reliable_gps"),
        F.count_if(F.col("__gap") > gap_s).alias("D_n_gaps"), F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("__gap") > gap_s, F.col("__gap"))), F.lit(0.0)) / F.lit(win_s)).alias("D_gap_fraction"),
    )


def density(n_gps: str = "n_gps", win_s: float = 120.0, most: float = 1.5):
    """(gps_frac, whether the fixes count): above `most` a second the share is kept but the fixes are not used."""
    frac = F.col(n_gps) / F.lit(win_s)
    return frac, frac <= most
