"""Smoothing of predicted modes over a session's windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Kinds of modes.
MOTORIZED, ISOLATED, RIDES = ("Car", "Bus", "Train", "Subway"), ("Walk", "Run", "Bike"), ("Bus", "Train", "Subway")
#: Shortest runs in minutes; pairs of modes that cannot follow one another.
MIN_MINUTES = {"Train": 10.0, "Bus": 8.0, "Bike": 4.0, "Car": 2.0, "Walk": 2.0, "Still": 0.0}
IMPOSSIBLE = (frozenset(("Train", "Car")), frozenset(("Train", "Bus")), frozenset(("Train", "Bike")))


def majority(windows: DataFrame, keys: list[str], k: int = 5, mode: str = "predicted", name: str = "smooth", order: str = "ts_start") -> DataFrame:
    """Adds the smoothed mode.

    A motorized window takes the most frequent motorized mode among the k around it, if at least k // 2 + 1 of them are
    motorized; ties go to the mode met first. Walk, Run or Bike between two windows of one motorized mode, and Still between
    two of one ride, take that mode. All comparisons use the modes before smoothing.
    """
    w = W.partitionBy(*keys).orderBy(order)
    m = F.col(mode)
    around = F.collect_list(F.coalesce(m, F.lit(""))).over(w.rowsBetween(-(k // 2), k // 2))
    rows = windows.withColumn("__around", F.filter(around, lambda x: x.isin(*MOTORIZED))).withColumn("__before", F.lag(m).over(w)).withColumn("__after", F.lead(m).over(w))
    times = lambda x: F.size(F.filter("__around", lambda y: y == x))
    best = F.array_max(F.transform(F.array_distinct("__around"), lambda x: F.struct(times(x).alias("n"), (-F.array_position("__around", x)).alias("p"), x.alias("m"))))["m"]
    same = F.col("__before") == F.col("__after")
    smooth = F.when(m.isin(*MOTORIZED) & (F.size("__around") >= k // 2 + 1), best)
    smooth = smooth.when(m.isin(*ISOLATED) & same & F.col("__before").isin(*MOTORIZED), F.col("__before"))
    smooth = smooth.when((m == "Still") & same & F.col("__before").isin(*RIDES), F.col("__before"))
    return rows.withColumn(name, smooth.otherwise(m)).drop("__around", "__before", "__after")


def run_lengths(windows: DataFrame, keys: list[str], mode: str = "predicted", order: str = "ts_start") -> DataFrame:
    """keys, mode, first and last order value and n of each maximal run of equal modes."""
    w = W.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(mode).over(w).eqNullSafe(F.col(mode)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = windows.withColumn("__change", change).withColumn("run", F.sum("__change").over(w))
    return rows.groupBy(*keys, "run", mode).agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("n"))


def min_windows(minutes: dict[str, float] | None = None, win_s: float = 120.0) -> dict[str, int]:
    """Shortest runs in windows; halves round to even."""
    return {m: max(0, round(v * 60 / win_s)) for m, v in (MIN_MINUTES | (minutes or {})).items()}


def coherent(modes: list, least: dict[str, int], impossible: tuple[frozenset, ...] = IMPOSSIBLE, passes: int = 10) -> list:
    """One session's modes, healed: short runs join their longer neighbour, impossible successions join the longer run.

    Runs are edited in place from left to right; equal neighbours are only merged when the next pass builds runs anew.
    """
    for _ in range(passes):
        runs: list[list] = []  # [mode, windows]
        for m in modes:
            if runs and runs[-1][0] == m:
                runs[-1][1] += 1
            else:
                runs.append([m, 1])
        changed = False
        kept: list[list] = []
        lead_in = 0  # windows handed to the next run
        for i, (m, n) in enumerate(runs):
            grown = n + lead_in
            before = runs[i - 1][1] if i else 0
            after = runs[i + 1][1] if i + 1 < len(runs) else 0
            if grown < least.get(m, 0) and (before or after):
                if before >= after and kept:
                    kept[-1][1] += grown
                    lead_in, changed = 0, True
                    runs[i][1] = grown
                    continue
                if after:
                    runs[i][1] = grown
                    lead_in, changed = grown, True
                    continue
            runs[i][1] = grown
            kept.append([m, grown])
            lead_in = 0
        healed: list[list] = []
        for m, n in kept:
            if healed and frozenset((m, healed[-1][0])) in impossible:
                changed = True
                if n <= healed[-1][1]:
                    healed[-1][1] += n
                    continue
                healed[-1][0] = m
            healed.append([m, n])
        modes = [m for m, n in healed for _ in range(n)]
        if not changed:
            break
    return modes


def coherence(windows: DataFrame, keys: list[str], mode: str = "smooth", name: str = "coherent", order: str = "ts_start", least: dict[str, int] | None = None) -> DataFrame:
    """Adds the healed mode. Only a session's modes, in order, meet in one array (one a minute), many arrays in an Arrow batch;
    the windows themselves are sorted where they are and take their place of the healed array. Windows without a session
    keep their mode."""
    limits = least or min_windows()

    @F.pandas_udf("array<string>")
    def heal(modes: pd.Series) -> pd.Series:
        return modes.map(lambda m: coherent(list(m), limits))

    rest = [c for c in windows.columns if c not in (*keys, order)]
    rows = windows.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(order, *rest)) - 1)
    modes = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", F.col(mode).alias("__m")))).alias("__w"))
    healed = modes.select(*keys, heal(F.col("__w.__m")).alias("__h"))
    found = F.when(F.col("__h").isNull(), F.col(mode)).otherwise(F.get("__h", F.col("__i")))
    return rows.join(healed, keys, "left").select(*windows.columns, found.alias(name))


def plausible(mode: Column, speed: Column, bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether a mean speed lies within its mode's bounds."""
    out = None
    for m, (low, high) in bounds.items():
        ok = (F.lit(True) if low is None else speed >= low) & (F.lit(True) if high is None else speed <= high)
        out = F.when(mode == m, ok) if out is None else out.when(mode == m, ok)
    return F.coalesce(out, F.lit(True))
