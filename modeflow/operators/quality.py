"""Point filters, unit and schema normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.order import drawn
from ..functions.quantiles import quantiles
from ..schemas import SOURCES

G = 9.80665


def accuracy_ok(limit: float = 50.0) -> Column:
    """Kept are fixes without an accuracy and those within the limit (metres)."""
    return F.col("accuracy").isNull() | (F.col("accuracy") <= limit)


def accuracy_filter(fixes: DataFrame, limit: float = 50.0) -> DataFrame:
    return fixes.where(accuracy_ok(limit))


def epoch_filter(df: DataFrame, start_ms: int, end_ms: int, time: str = "timestamp") -> DataFrame:
    return df.where(F.col(time).between(start_ms, end_ms))


def magnitude(prefix: str = "acc") -> Column:
    x, y, z = (F.col(f"{prefix}_{a}") for a in "xyz")
    return F.sqrt(x * x + y * y + z * z)


def to_g(samples: DataFrame, keys: list[str], limit: float = 5.0) -> DataFrame:
    """Divide accelerations by G in groups whose median magnitude is above the limit (m/s2 rather than g).

    The medians are one row for each group, found by selection and joined back: no group is sorted or held as a whole.
    """
    medians = quantiles(samples, keys, {"__median": magnitude()}, [0.5]).select(*keys, F.col("__median")[0].alias("__median"))
    joined = samples.join(medians, keys)
    scale = F.when(F.col("__median") > limit, F.lit(G)).otherwise(F.lit(1.0))
    return joined.withColumns({f"acc_{a}": F.col(f"acc_{a}") / scale for a in "xyz"}).drop("__median")


def spike_filter(samples: DataFrame, limit_g: float = 4.0) -> DataFrame:
    return samples.where(magnitude() <= limit_g)


def adapt(df: DataFrame, source: str) -> DataFrame:
    """Columns of a known source under the engine's names; a column that the source lacks is null."""
    has = set(df.columns)
    mapped = [(F.col(s) if s in has else F.lit(None).cast("double")).alias(name) for name, s in SOURCES[source].items()]
    used = set(SOURCES[source].values())
    return df.select(*mapped, *[c for c in df.columns if c not in used and c not in SOURCES[source]])


def within_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    return df.where(F.col(lat_col).between(*lat) & F.col(lon_col).between(*lon))


def devices(samples: DataFrame, user: str = "userId", limit: float = 5.0) -> DataFrame:
    """The platform of each user by the unit of its accelerometer."""
    return quantiles(samples, [user], {"median_mag": magnitude()}, [0.5]).withColumn("median_mag", F.col("median_mag")[0]).withColumn("device", F.when(F.col("median_mag") < limit, "iOS").otherwise("Android"))


def stratum(frac: Column) -> Column:
    """How much positioning a window has."""
    return F.when(frac == 0, "absent").when(frac <= 0.5, "sparse").when(frac > 0.5, "present")


def binned(x: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed bins between edges; null outside."""
    out = None
    for low, high, name in zip(edges[:-1], edges[1:], names, strict=True):
        test = (x > low) & (x <= high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def mask_positions(windows: DataFrame, share: float, seed: int, keys: list[str]) -> DataFrame:
    """Null the B and C columns of a share of the windows with positioning, chosen by a seeded draw for their keys."""
    chosen = (F.col("gps_frac") > 0) & (drawn(*keys, seed=seed) < share)
    columns = [c for c in windows.columns if c[:2] in ("B_", "C_")]
    return windows.withColumns({c: F.when(chosen, None).otherwise(F.col(c)) for c in columns})


def previous_sorted(keys: list[str], time: str = "timestamp", tie: str = "event_id") -> W:
    return W.partitionBy(*keys).orderBy(time, tie)
