"""Inertial features that SQL expresses: statistics, entropies, correlations, jerk, autocorrelation, covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import quantiles
from ..functions.order import equal_keys, numbered, shifted, with_totals
from ..functions.stats import excess_kurtosis, pct, pearson, rms, skew
from .quality import magnitude

#: Rows of a group meet within buckets of time, so that a group of any length is spread over tasks.
BUCKET_MS = 6 * 3_600_000


def bucket() -> Column:
    return F.floor(F.col("timestamp") / BUCKET_MS)


def aggregated(rows: DataFrame, keys: list[str], aggs: list[Column], of: dict[str, tuple[Column, float | tuple[float, float]]], sized: DataFrame) -> DataFrame:
    """One row for each of the keys: aggregates, and quantiles of the rows: name -> (expression, share), or a pair of shares
    whose quantiles are subtracted. `sized` has at least as many rows of each key; where none has more than quantiles.MOST, all
    come from one aggregation, else the quantiles are found by selection."""
    largest = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    if largest <= quantiles.MOST:
        direct = [(pct(x, ps[1]) - pct(x, ps[0]) if isinstance(ps, tuple) else pct(x, ps)).alias(n) for n, (x, ps) in of.items()]
        return rows.groupBy(*keys).agg(*aggs, *direct)
    named = {f"__x{i}": x for i, (x, _) in enumerate(of.values())}
    shares = sorted({p for _, ps in of.values() for p in (ps if isinstance(ps, tuple) else (ps,))})
    at = lambda i, p: F.get(F.col(f"q.__x{i}"), F.lit(shares.index(p)))
    made = [(at(i, ps[1]) - at(i, ps[0]) if isinstance(ps, tuple) else at(i, ps)).alias(n) for i, (n, (_, ps)) in enumerate(of.items())]
    found = quantiles.quantiles(rows, keys, named, shares)
    return rows.groupBy(*keys).agg(*aggs).alias("t").join(found.alias("q"), equal_keys("t", "q", keys), "left").select("t.*", *made)


IQR = (0.25, 0.75)


def signals(samples: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """Adds z-scored axes ax, ay, az (an axis of no spread stays raw), acc_mag of them, and gyr_mag."""
    totals = {f"__{k}_{a}": f(f"acc_{a}") for a in "xyz" for k, f in (("m", F.avg), ("s", F.stddev_pop))}
    z = {f"a{a}": F.when(F.col(f"__s_{a}") > 1e-6, (F.col(f"acc_{a}") - F.col(f"__m_{a}")) / F.col(f"__s_{a}")).otherwise(F.col(f"acc_{a}")) for a in "xyz"}
    rows = with_totals(samples, keys, totals).withColumns(z).drop(*totals)
    return rows.withColumn("acc_mag", F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)).withColumn("gyr_mag", magnitude("gyr"))


def pack(signal: str, prefix: str, previous: str, full: bool = True) -> list[Column]:
    """skew, kurt, zcr and, if full, mean, std, rms of a signal; `previous` is its lagged column. The iqr comes apart."""
    x = F.col(signal)
    zcr = F.count_if(F.signum(x) != F.signum(previous)) / F.count(x)
    out = [skew(x).alias(f"{prefix}_skew"), excess_kurtosis(x).alias(f"{prefix}_kurt"), zcr.alias(f"{prefix}_zcr")]
    if full:
        out += [F.avg(x).alias(f"{prefix}_mean"), F.stddev_pop(x).alias(f"{prefix}_std"), rms(x).alias(f"{prefix}_rms")]
    return out


def statistics(samples: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """Statistics packs, sums of magnitudes and correlations of accelerometer and gyroscope."""
    names = {"acc_mag": ("A_acc_mag", True), **{f"a{a}": (f"A_acc_{a}", False) for a in "xyz"}, "gyr_mag": ("A_gyr_mag", True), **{f"gyr_{a}": (f"A_gyr_{a}", True) for a in "xyz"}}
    rows = shifted(signals(samples, keys, tie), keys, ["timestamp", tie], {f"__p_{s}": (s, -1) for s in names}, bucket())
    corr = [pearson(F.col(f"{c}{a}"), F.col(f"{c}{b}")).alias(f"A_{n}_corr_{a}{b}") for c, n in (("a", "acc"), ("gyr_", "gyr")) for a, b in ("xy", "xz", "yz")]
    sma = [F.avg(sum((F.abs(F.col(f"{c}{a}")) for a in "yz"), F.abs(F.col(f"{c}x")))).alias(f"A_{n}_sma") for c, n in (("a", "acc"), ("gyr_", "gyr"))]
    more = [(F.max("acc_mag") - F.min("acc_mag")).alias("A_acc_mag_ptp"), (F.avg("gyr_mag") / (F.avg("acc_mag") + 1e-6)).alias("A_gyr_acc_ratio")]
    aggs = [*[c for s, (p, full) in names.items() for c in pack(s, p, f"__p_{s}", full)], *sma, *corr, *more]
    ranks = {f"{p}_iqr": (F.col(s), IQR) for s, (p, _) in names.items()} | {"A_acc_mag_p25": (F.col("acc_mag"), 0.25), "A_acc_mag_p75": (F.col("acc_mag"), 0.75)}
    return aggregated(rows, keys, aggs, ranks, samples)


def jerk(samples: DataFrame, keys: list[str], fs: float = 50.0, tie: str = "event_id") -> DataFrame:
    """Statistics of the length of the change of the z-scored acceleration, times the rate."""
    rows = shifted(signals(samples, keys, tie), keys, ["timestamp", tie], {f"__p{a}": (f"a{a}", -1) for a in "xyz"}, bucket())
    length = F.sqrt(sum(((F.col(f"a{a}") - F.col(f"__p{a}")) ** 2 for a in "yz"), (F.col("ax") - F.col("__px")) ** 2)) * fs
    rows = rows.withColumn("jerk", length).where("jerk is not null").select(*keys, "timestamp", tie, "jerk")
    rows = shifted(rows, keys, ["timestamp", tie], {"__p": ("jerk", -1)}, bucket())
    return aggregated(rows, keys, pack("jerk", "A_jerk", "__p"), {"A_jerk_iqr": (F.col("jerk"), IQR)}, samples)


def autocorrelation(samples: DataFrame, keys: list[str], lags: dict[str, int], least: int = 100, tie: str = "event_id") -> DataFrame:
    """A_acc_autocorr_<name> at given lags in samples: null up to `least` samples, 0 without variance."""
    rows = with_totals(signals(samples, keys, tie), keys, {"__m": F.avg("acc_mag")})
    rows = rows.select(*keys, "timestamp", tie, (F.col("acc_mag") - F.col("__m")).alias("__x"))
    rows = shifted(rows, keys, ["timestamp", tie], {f"__{n}": ("__x", k) for n, k in lags.items()}, bucket())
    var = F.sum(F.col("__x") * F.col("__x"))
    at = lambda n, k: F.when((F.count(F.lit(1)) > least) & (F.count(F.lit(1)) > k), F.when(var > 1e-12, F.sum(F.col("__x") * F.col(f"__{n}")) / var).otherwise(0.0))
    return rows.groupBy(*keys).agg(*[at(n, k).alias(f"A_acc_autocorr_{n}") for n, k in lags.items()])


def value_entropy(rows: DataFrame, keys: list[str], signal: str, bins: int = 10) -> DataFrame:
    """Entropy of a histogram of equal bins between minimum and maximum, over log2(bins); below 2 values 0."""
    whole = W.partitionBy(*keys)  # of counts: a few rows
    x = with_totals(rows.where(F.col(signal).isNotNull()).select(*keys, F.col(signal).alias("__x")), keys, {"__lo": F.min("__x"), "__hi": F.max("__x")})
    bin_ = F.when(F.col("__lo") == F.col("__hi"), bins // 2).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo")))))
    counts = x.withColumn("__bin", bin_).groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    p = counts.withColumn("__total", F.sum("__n").over(whole)).withColumn("__p", F.col("__n") / F.col("__total"))
    # each empty bin adds 0 * log2(1e-12), so only the others count
    entropy = -F.sum(F.col("__p") * F.log2(F.col("__p") + 1e-12)) / F.log2(F.lit(float(bins)))
    return p.groupBy(*keys).agg(F.when(F.max("__total") < 2, F.lit(0.0)).otherwise(entropy).alias("value_entropy"))


def time_entropy(rows: DataFrame, keys: list[str], signal: str, parts: int = 10, tie: str = "event_id") -> DataFrame:
    """Entropy of the absolute means of consecutive parts of nearly equal size; 0 below as many values as parts."""
    placed = numbered(rows.where(F.col(signal).isNotNull()), keys, ["timestamp", tie], bucket())
    least, more = F.expr(f"__total div {parts}"), F.col("__total") % parts  # the first parts have one row more
    part = F.when(F.col("__at") < more * (least + 1), F.floor(F.col("__at") / (least + 1))).otherwise(more + F.floor((F.col("__at") - more * (least + 1)) / F.greatest(least, F.lit(1))))
    means = placed.withColumn("__part", part).groupBy(*keys, "__part").agg((F.abs(F.avg(signal)) + 1e-12).alias("__m"))
    p = means.withColumn("__p", F.col("__m") / F.sum("__m").over(W.partitionBy(*keys)))
    entropy = -F.sum(F.col("__p") * F.log2("__p")) / F.log2(F.lit(float(parts)))
    return p.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < parts, F.lit(0.0)).otherwise(entropy).alias("time_entropy"))


def rotation_invariant(rows: DataFrame, keys: list[str], axes: tuple[str, str, str], prefix: str, tie: str = "event_id") -> DataFrame:
    """Covariances (their eigenvalues come from `eigenvalues`), lengths of the second difference, and angles between
    consecutive vectors."""
    x = shifted(rows.select(*keys, "timestamp", tie, *axes), keys, ["timestamp", tie], {f"__{a}{k}": (a, -k) for a in axes for k in (1, 2)}, bucket())
    total = lambda parts: sum(parts[1:], parts[0])
    second = F.sqrt(total([(F.col(a) - 2 * F.col(f"__{a}1") + F.col(f"__{a}2")) ** 2 for a in axes]))
    norm = lambda names: F.sqrt(total([F.col(c) ** 2 for c in names]))
    cosine = total([F.col(a) * F.col(f"__{a}1") for a in axes]) / (norm(axes) * norm([f"__{a}1" for a in axes]) + 1e-9)
    x = x.withColumn("d2v", second).withColumn("angle", F.when(cosine.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    many = {"d2v": 4, "angle": 3}
    stats = [F.when(F.count(F.lit(1)) >= many[s], f).alias(f"{prefix}_{s}_{n}") for s in many for n, f in (("mean", F.avg(s)), ("std", F.stddev_pop(s)))]
    cov = [F.covar_samp(axes[i], axes[j]).alias(f"__c{i}{j}") for i in range(3) for j in range(i, 3)]
    ranks = {f"{prefix}_{s}_{n}": (F.col(s), p) for s in many for n, p in (("iqr", IQR), ("p95", 0.95))}
    out = aggregated(x, keys, [F.count(F.lit(1)).alias("__n"), *cov, *stats], ranks, rows)
    enough = {f"{prefix}_{s}_{n}": F.when(F.col("__n") >= many[s], F.col(f"{prefix}_{s}_{n}")) for s in many for n in ("iqr", "p95")}
    return eigenvalues(out.withColumns(enough), prefix)


def eigenvalues(df: DataFrame, prefix: str) -> DataFrame:
    """The eigenvalues of the symmetric matrix __c00..__c22 in closed form (trigonometric), with ratios and entropy."""
    c = {(i, j): F.col(f"__c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    q = (c[0, 0] + c[1, 1] + c[2, 2]) / 3
    off = c[0, 1] ** 2 + c[0, 2] ** 2 + c[1, 2] ** 2
    df = df.withColumn("__q", q).withColumn("__p", F.sqrt(((c[0, 0] - q) ** 2 + (c[1, 1] - q) ** 2 + (c[2, 2] - q) ** 2 + 2 * off) / 6))
    b = {k: F.try_divide(v - (F.col("__q") if k[0] == k[1] else F.lit(0.0)), F.col("__p")) for k, v in c.items()}
    det = b[0, 0] * (b[1, 1] * b[2, 2] - b[1, 2] ** 2) - b[0, 1] * (b[0, 1] * b[2, 2] - b[1, 2] * b[0, 2]) + b[0, 2] * (b[0, 1] * b[1, 2] - b[1, 1] * b[0, 2])
    df = df.withColumn("__phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det / 2, F.lit(0.0))))) / 3)
    root = lambda shift: F.greatest(F.lit(0.0), F.col("__q") + 2 * F.col("__p") * F.cos(F.col("__phi") + shift))
    third = 2.0943951023931953
    df = df.withColumn("__e1", root(0.0)).withColumn("__e3", root(third)).withColumn("__e2", F.greatest(F.lit(0.0), 3 * F.col("__q") - (F.col("__q") + 2 * F.col("__p") * F.cos("__phi")) - (F.col("__q") + 2 * F.col("__p") * F.cos(F.col("__phi") + third))))
    e1, e2, e3 = F.col("__e1"), F.col("__e2"), F.col("__e3")
    total = e1 + e2 + e3 + 1e-12
    entropy = -sum((e / total * F.ln(e / total + 1e-12) for e in (e2, e3)), e1 / total * F.ln(e1 / total + 1e-12))
    made = {"eig1": e1, "eig2": e2, "eig3": e3, "eig_ratio": e1 / (e2 + 1e-9), "eig_planar": (e2 - e3) / (e1 + 1e-9), "eig_spheric": e3 / (e1 + 1e-9), "eig_entropy": entropy}
    enough = F.col("__n") >= 3
    kept = [c for c in df.columns if not c.startswith("__")]
    return df.select(*kept, *[F.when(enough, x).alias(f"{prefix}_{n}") for n, x in made.items()])
