"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T



_F, _D, _L, _S = T.FloatType(), T.DoubleType(), T.LongType(), T.StringType()


def _of(pairs: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


GPS = _of([("userId", _S), ("timestamp", _L), ("latitude", _F), ("longitude", _F), ("accuracy", _F), ("speed", _F), ("bearing", _F)])
IMU = _of([("timestamp", _L), *[(f"{s}_{a}", _F) for s in ("acc", "gyr") for a in "xyz"]])
LABELS = _of([("userId", _S), ("started_at", _L), ("finished_at", _L), ("mode", _S)])
SESSIONS = _of([("session_id", _S), ("userId", _S), ("t0_ms", _L), ("t1_ms", _L), ("dur_s", _D), ("n_gps", _L), ("n_imu", _L), ("imu_hz", _D), ("type", _S)])
GTFS = {
    "stops": _of([("stop_id", _S), ("stop_lat", _S), ("stop_lon", _S)]),
    "stop_times": _of([("trip_id", _S), ("stop_id", _S)]),
    "trips": _of([("trip_id", _S), ("route_id", _S)]),
    "routes": _of([("route_id", _S), ("route_type", _S)]),
    "shapes": _of([("shape_id", _S), ("shape_pt_lat", _S), ("shape_pt_lon", _S), ("shape_pt_sequence", _S)]),
}

#: Source columns to engine columns; a source without a column gives null.
SOURCES = {
    "phone": {"timestamp": "timestamp", "lat": "latitude", "lon": "longitude", "accuracy": "accuracy", "speed": "speed", **{f"{s}_{a}": f"{s}_{a}" for s in ("acc", "gyr") for a in "xyz"}},
    "shl": {"timestamp": "ts", "lat": "lat", "lon": "lon", "accuracy": "accuracy", **{f"acc_{a}": f"a{a}" for a in "xyz"}, **{f"gyr_{a}": f"g{a}" for a in "xyz"}, **{f"lin_acc_{a}": f"lin_{a}" for a in "xyz"}, **{f"grav_{a}": f"grav_{a}" for a in "xyz"}, **{f"mag_{a}": f"m{a}" for a in "xyz"}},
}

_S4, _S7 = ("skew", "kurt", "zcr", "iqr"), ("skew", "kurt", "zcr", "iqr", "mean", "std", "rms")
_P6 = ("dom_freq", "spec_entropy", "psd_0_2", "psd_2_4", "psd_4_8", "psd_8_20")
_R15 = ("eig1", "eig2", "eig3", "eig_ratio", "eig_planar", "eig_spheric", "eig_entropy", *[f"{q}_{s}" for q in ("d2v", "angle") for s in ("mean", "std", "iqr", "p95")])
_CORR, _ENT = ("corr_xy", "corr_xz", "corr_yz"), ("val_ent", "time_ent")


def _names(prefix: str, *packs: tuple[str, ...]) -> list[str]:
    return [f"{prefix}_{s}" for pack in packs for s in pack]


#: The 230 feature columns: A inertial, B kinematic, C infrastructure, D positioning quality.
FEATURES_A = [
    *_names("A_acc_mag", _S7, _P6, ("p25", "p75", "ptp"), _ENT), *_names("A_acc", ("sma",), _CORR), *[n for a in "xyz" for n in _names(f"A_acc_{a}", _S4, _P6)],
    *_names("A_gyr_mag", _S7, _P6, _ENT), *_names("A_gyr", ("sma",), _CORR), *[n for a in "xyz" for n in _names(f"A_gyr_{a}", _S7, _P6)],
    *_names("A_lin_mag", _S7, _P6, _ENT), *[n for a in ("x", "y", "z", "mag") for n in _names(f"A_grav_{a}", ("mean", "std"))], "A_gyr_acc_ratio",
    *_names("A_jerk", _S7, _P6), "A_acc_autocorr_05s", "A_acc_autocorr_1s", *_names("A_acc", _R15), *_names("A_gyr", _R15),
    *_names("A_mag_mag", ("mean", "std", "val_ent", "psd_0_2", "psd_2_4", "psd_4_8")), *_names("A_mag", _CORR),
]
FEATURES_B = _names("B", ("n_gps", "speed_mean", "speed_std", "speed_max", "speed_p25", "speed_p50", "speed_p95", "dist_total_m", "acc_mean", "acc_std", "n_stops", "stop_frac", "bearing_change_mean", "speed_change_rate", "path_efficiency", "stop_regularity", "dwell_mean", "speed_trend", "alt_mean", "alt_std", "alt_range", "n_valid_pairs"))
FEATURES_C = _names("C", ("bus_stops_prop", "bus_stops_mean", "bus_stops_flag", "rail_stations_min", "rail_stations_flag", "subway_stations_mean", "subway_stations_flag", "osm_rail_prop", "osm_rail_p10", "osm_subway_prop", "osm_motorway_flag", "osm_motorway_min", "osm_cycleway_flag", "osm_cycleway_mean", "osm_cycleway_min"))
FEATURES_D = _names("D", ("acc_mean", "acc_max", "has_reliable_gps", "n_gaps", "gap_fraction"))
FEATURES = [*FEATURES_A, *FEATURES_B, *FEATURES_C, *FEATURES_D]

#: The 67 columns left out of the training matrix.
DROPPED = """
A_acc_angle_iqr A_acc_angle_mean A_acc_angle_p95 A_acc_angle_std A_acc_d2v_iqr A_acc_d2v_mean A_acc_eig3 A_acc_eig_entropy
A_acc_eig_ratio A_acc_eig_spheric A_acc_mag_kurt A_acc_mag_mean A_acc_mag_p25 A_acc_mag_std A_acc_mag_zcr A_gyr_acc_ratio
A_gyr_d2v_mean A_gyr_d2v_std A_gyr_eig1 A_gyr_eig2 A_gyr_eig3 A_gyr_eig_entropy A_gyr_mag_kurt A_gyr_mag_mean A_gyr_mag_rms
A_gyr_mag_std A_gyr_x_rms A_gyr_x_std A_gyr_y_iqr A_gyr_y_rms A_gyr_y_std A_gyr_z_iqr A_gyr_z_rms A_gyr_z_std A_jerk_kurt
A_jerk_mean A_lin_mag_kurt A_lin_mag_mean A_lin_mag_rms A_lin_mag_std A_lin_mag_val_ent A_lin_mag_zcr A_mag_corr_xy
A_mag_corr_xz A_mag_corr_yz A_mag_mag_mean A_mag_mag_psd_0_2 A_mag_mag_psd_2_4 A_mag_mag_psd_4_8 A_mag_mag_std
A_mag_mag_val_ent B_acc_mean B_alt_mean B_alt_range B_alt_std B_dist_total_m B_n_valid_pairs B_speed_max B_speed_mean
B_speed_p25 B_speed_p50 B_stop_regularity C_bus_stops_flag C_osm_subway_prop C_subway_stations_flag C_subway_stations_mean
D_gap_fraction
""".split()
