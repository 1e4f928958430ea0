"""The commands of the engine: process, label, train, predict, aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import City
from ..operators import aggregate as shares
from ..operators import evaluation, gps, intervals, labeling, models, quality, sessions, smoothing, spatial, spectral, windows
from ..session import cut

KEYS = ["userId", "session_id", "ts_start"]


def process(fixes: DataFrame, samples: DataFrame, city: City, layers: dict[str, DataFrame] | None = None, labels: DataFrame | None = None, majority: bool = False) -> DataFrame:
    """The window table: all 230 features with ts_start, ts_end, gps_frac, n_imu, userId, session_id, sess_type, imu_hz, city,
    label and label_source.

    fixes: userId, event_id, timestamp, latitude, longitude, speed, accuracy; samples: userId, event_id, timestamp and axes;
    layers: places by layer name; labels: userId, seq, started_at, finished_at, mode. Distances are found once for each fix,
    before fixes are dealt to the windows that overlap on them.
    """
    win, step = int(city.window["win_s"] * 1000), int(city.window["step_s"] * 1000)
    good = quality.accuracy_filter(fixes, city.quality["max_accuracy_m"])
    if city.exclude_users:
        good, samples = (x.where(~F.col("userId").isin(*city.exclude_users)) for x in (good, samples))
    built = cut(sessions.processable(sessions.build(good, samples, city.session["gap_s"], city.session["min_duration_s"])))
    spans = built.select("userId", "session_id", "t0_ms", "t1_ms")
    inside = lambda p: sessions.within(p, spans, ["userId"]).drop("t0_ms", "t1_ms")
    near = inside(good)
    for name, places in (layers or {}).items():
        near = spatial.nearest(near, places, f"__{name}")
    unit = quality.spike_filter(quality.to_g(inside(samples), ["userId", "session_id"]), city.quality["max_acc_g"])
    anchors = cut(windows.anchors(unit, ["userId", "session_id"]))
    base = windows.sliding(anchors, win, step).join(built.select("userId", "session_id", "imu_hz", F.col("type").alias("sess_type")), ["userId", "session_id"])
    wfix = cut(windows.assign(near, anchors, ["userId", "session_id"], win, step))
    wimu = windows.assign(unit, anchors, ["userId", "session_id"], win, step).join(built.select("userId", "session_id", "imu_hz"), ["userId", "session_id"])
    n_gps = wfix.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n"))
    frac, used = gps.density("__n", city.window["win_s"])
    dense = wfix.join(n_gps.where(used).select(*KEYS), KEYS, "left_semi")
    parts = [
        n_gps.select(*KEYS, frac.alias("gps_frac")), wimu.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_imu")), spectral.features(wimu, KEYS, "imu_hz"), gps.kinematics(dense, KEYS),
        gps.quality(dense, KEYS, city.window["win_s"]), spatial.proximity(dense, KEYS, {n: f"__{n}" for n in layers or {}}),
    ]
    out = base
    for p in parts:
        out = out.join(p, KEYS, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_imu", "B_n_gps", "D_n_gaps")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("gps_frac", "D_has_reliable_gps", "D_gap_fraction")})
    if labels is not None:
        out = intervals.overlap_labels(out, labels, ["userId"], ["session_id"], 0.5 if majority else 0.8)
    else:
        out = out.withColumn("label", F.lit(None).cast("string"))
    source = F.when(F.col("label").isNotNull(), "reference")
    return out.select(*schemas.FEATURES, "ts_start", "ts_end", "gps_frac", "n_imu", "session_id", "userId", "sess_type", "imu_hz", F.lit(city.name).alias("city"), "label", source.alias("label_source"))


def label(table: DataFrame, city: City, fixes: DataFrame | None = None, shapes: DataFrame | None = None, rail: str | None = None) -> DataFrame:
    """Silver labels of the full table (before any column is dropped); session alignment joins in where shapes or rail
    distances (a column of fixes with session_id) are given, and leaves again before training."""
    for found, name in ((spatial.aligned_share(fixes, shapes, ["session_id"]).withColumnRenamed("align", "C_bus_route_align") if shapes is not None else None, "C_bus_route_align"), (spatial.rail_align(fixes, ["session_id"], rail).withColumnRenamed("rail_align", "C_rail_align") if rail else None, "C_rail_align")):
        if found is not None:
            table = table.join(found.select("session_id", name), "session_id", "left")
    return labeling.silver(table, thresholds=city.window_labeler)


@dataclass
class Trained:
    model: models.Hierarchical
    scores: dict[str, float]
    predictions: DataFrame | None


def training_columns(table: DataFrame) -> list[str]:
    """Feature columns less those that are left out of training, and those without any value."""
    from ..operators.selection import feature_columns

    gone = set(schemas.DROPPED) | set(labeling.ALIGN)
    return [c for c in feature_columns(table) if c not in gone]


def train(table: DataFrame, city: City, target: str = "silver_label", folds: int = 0, **options) -> Trained:
    """A model fitted on all labelled windows, with rolling-origin scores before it if folds are asked for."""
    rows = table.where(F.col(target).isin(*city.classes))
    columns = training_columns(rows)
    scores, oof = evaluation.rolling_training(rows, columns, list(city.classes), target, folds, **options) if folds else ({}, None)
    return Trained(models.Hierarchical(columns, list(city.classes)).fit(rows, target, city.specialists, **options), scores, oof)


def predict(table: DataFrame, model: models.Hierarchical, city: City, names: dict[str, str] | None = None) -> DataFrame:
    """predicted, max_prob, smooth and coherent modes of all windows; distance stays for emissions."""
    got = model.predict(table)
    got = got.withColumn("predicted", models.remapped(F.col("predicted"), names or {}))
    keep = [c for c in ("label", "silver_label", "gps_frac", "B_speed_mean", "B_dist_total_m", "D_has_reliable_gps") if c in got.columns]
    rows = got.select("userId", "session_id", "ts_start", "ts_end", "predicted", "max_prob", *keep)
    smooth = smoothing.majority(rows, ["userId", "session_id"], city.smooth_windows())
    return smoothing.coherence(smooth, ["userId", "session_id"], least=city.min_windows())


def aggregate(predictions: DataFrame, mode: str = "coherent", calibration: DataFrame | None = None) -> dict[str, DataFrame]:
    """modal_split, co2 and, with calibration windows (label and predicted mode), the corrected split."""
    out = {"modal_split": shares.modal_split(predictions, mode)}
    if "B_dist_total_m" in predictions.columns:
        out["co2"] = shares.emissions(predictions, mode, F.coalesce(F.col("B_dist_total_m"), F.lit(0.0)) / 1000)
    if calibration is not None:
        out["corrected"] = shares.corrected_split(predictions, mode, calibration, "label", mode)
    return out
