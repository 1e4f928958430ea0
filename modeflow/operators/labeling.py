"""The rule cascade for silver labels, and its sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the cascade (m/s, shares), and values of missing features.
THRESHOLDS = {
    "still_spd_strict": 0.20, "still_spd_max": 0.50, "still_stop_min": 0.85, "still_lin_nogps": 0.015, "walk_spd_lo": 0.5, "walk_spd_hi": 2.5, "walk_max_spd": 5.0, "walk_stop_max": 0.50,
    "walk_nogps_lin_min": 999.0, "walk_nogps_psd_min": 999.0, "walk_nogps_weight": 0.89, "train_rail_min": 0.35, "train_spd_min": 8.0, "train_rail_align_min": 0.15,
    "bus_prop_min": 0.20, "bus_spd_lo": 1.5, "bus_spd_hi": 14.0, "bus_stop_min": 0.10, "bus_route_align_min": 0.40, "car_spd_lo": 5.0, "car_rail_max": 0.15, "car_path_min": 0.40,
}
MISSING = {
    "B_speed_mean": 0.0, "B_speed_max": 0.0, "B_stop_frac": 0.5, "B_path_efficiency": 0.5, "B_n_gps": 0.0, "C_osm_rail_prop": 0.0, "C_bus_stops_prop": 0.0,
    "C_bus_route_align": 1.0, "C_rail_align": 1.0, "A_lin_mag_mean": 0.0, "A_acc_x_psd_2_4": 0.0,
}
ALIGN = ("C_bus_route_align", "C_rail_align")


def rules(columns: list[str], t: dict[str, Column | float]) -> list[tuple[str, Column]]:
    """(label, condition) in order; the first that holds gives the label."""
    has = set(columns)
    v = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(x)) if c in has else F.lit(x) for c, x in MISSING.items()}
    speed, top, stop = v["B_speed_mean"], v["B_speed_max"], v["B_stop_frac"]
    gps = v["B_n_gps"] > 0
    return [
        ("Still", (gps & ((speed < t["still_spd_strict"]) | ((speed < t["still_spd_max"]) & (stop > t["still_stop_min"])))) | (~gps & (v["A_lin_mag_mean"] < t["still_lin_nogps"]))),
        ("Walk", gps & (speed > t["walk_spd_lo"]) & (speed < t["walk_spd_hi"]) & (top < t["walk_max_spd"]) & (stop < t["walk_stop_max"])),
        ("Walk_imu", ~gps & (v["A_lin_mag_mean"] > t["walk_nogps_lin_min"]) & (v["A_acc_x_psd_2_4"] > t["walk_nogps_psd_min"])),
        ("Train", gps & (v["C_osm_rail_prop"] > t["train_rail_min"]) & (speed > t["train_spd_min"]) & (v["C_rail_align"] > t["train_rail_align_min"])),
        ("Bus", gps & (v["C_bus_stops_prop"] > t["bus_prop_min"]) & (speed > t["bus_spd_lo"]) & (speed < t["bus_spd_hi"]) & (stop > t["bus_stop_min"]) & (v["C_bus_route_align"] > t["bus_route_align_min"])),
        ("Car", gps & (speed > t["car_spd_lo"]) & (v["C_osm_rail_prop"] < t["car_rail_max"]) & (v["B_path_efficiency"] > t["car_path_min"])),
    ]


def cascade(windows: DataFrame, thresholds: dict[str, float] | None = None, weights: dict[str, float] | None = None, label: str = "silver_label", weight: str = "silver_weight") -> DataFrame:
    """Adds the label (null: abstained) and its weight (0 where abstained)."""
    t = THRESHOLDS | (thresholds or {})
    w = {"Still": 1.0, "Walk": 1.0, "Train": 1.0, "Bus": 1.0, "Car": 1.0} | (weights or {}) | {"Walk_imu": t["walk_nogps_weight"]}
    name = value = None
    for rule, holds in rules(windows.columns, t):
        text, number = F.lit(rule.split("_")[0]), F.lit(w[rule])
        name, value = (F.when(holds, text), F.when(holds, number)) if name is None else (name.when(holds, text), value.when(holds, number))
    return windows.withColumn(label, name).withColumn(weight, value.otherwise(0.0))


def silver(windows: DataFrame, **options) -> DataFrame:
    """The cascade, without the alignment columns afterwards, so that they never reach training."""
    return cascade(windows, **options).drop(*ALIGN)


def sweep(windows: DataFrame, threshold: str, values: list[float]) -> DataFrame:
    """value and the number of windows of each label, as one threshold takes several values; one pass over the windows."""
    rows = windows.withColumn("value", F.explode(F.array(*[F.lit(float(v)) for v in values])))
    name = None
    for rule, holds in rules(windows.columns, THRESHOLDS | {threshold: F.col("value")}):
        text = F.lit(rule.split("_")[0])
        name = F.when(holds, text) if name is None else name.when(holds, text)
    return rows.withColumn("label", F.coalesce(name, F.lit("abstain"))).groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"))
