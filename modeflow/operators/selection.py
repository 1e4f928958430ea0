"""Audits, redundancy and pruning of feature columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.order import cumulated
from ..session import cut
from . import models


def feature_columns(df: DataFrame, prefixes: tuple[str, ...] = ("A_", "B_", "C_", "D_")) -> list[str]:
    """Feature columns that are not null throughout, in one pass."""
    names = [c for c in df.columns if c.startswith(prefixes)]
    if not names:
        return []
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if counts[c]]


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these feature columns in this order before the others; absent ones are null, further features are left out."""
    has = set(df.columns)
    rest = [c for c in df.columns if c[:2] not in ("A_", "B_", "C_", "D_")]
    return df.select(*[(F.col(c) if c in has else F.lit(None).cast("double")).alias(c) for c in columns], *rest)


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """feature, value (and kept columns): a row for each cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("__c")
    return df.select(*(keep or []), cells).select(*(keep or []), "__c.*")


def audit(df: DataFrame, columns: list[str], present: Column, constant: float = 0.995) -> DataFrame:
    """feature, pct_null, pct_null_present, n_unique, top_freq, dropped: why a column would be left out, or null."""
    cells = unpivot(df.withColumn("__present", present), columns, ["__present"])
    values = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("__present").alias("p"))
    f = values.groupBy("feature").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.sum("p").alias("present"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("p"))), F.lit(0)).alias("present_nulls"),
        F.count(F.when(F.col("value").isNotNull(), 1)).alias("n_unique"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"),
    )
    share = lambda a, b: 100 * F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    f = f.select("feature", share(F.col("nulls"), F.col("total")).alias("pct_null"), share(F.col("present_nulls"), F.col("present")).alias("pct_null_present"), "n_unique", (100 * F.coalesce(F.try_divide(F.col("top").cast("double"), F.col("total") - F.col("nulls")), F.lit(1.0))).alias("top_freq"))
    why = F.when((F.col("n_unique") <= 1) | (F.col("top_freq") >= 100 * constant), "constant").when(F.col("pct_null") >= 99.9, "null").when(F.col("feature").rlike("^[BC]_") & (F.col("pct_null_present") > 80), "sparse")
    return f.withColumn("dropped", why)


def null_masks(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """The columns in groups that are null in the very same rows, in their order.

    Columns of equal sums of the hashes of their known rows are candidates; a count of the rows where two of a group differ, which
    must be none, confirms them.
    """
    h = F.xxhash64("__id").cast("decimal(38,0)")
    marks = df.agg(*[F.sum(F.when(F.col(c).isNotNull(), h)).alias(c) for c in columns]).first()
    groups: dict = {}
    for c in columns:
        groups.setdefault(marks[c], []).append(c)
    pairs = [(g[0], c) for g in groups.values() for c in g[1:]]
    if pairs:
        apart = df.agg(*[F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(b) for a, b in pairs]).first()
        for a, b in pairs:
            if apart[b]:
                groups[marks[a]].remove(b)
                groups[b] = [b]
    return list(groups.values())


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, rho of all pairs of columns over the n rows where both are known: ranks within the pair's complete rows.

    Rows that are equal in all columns are counted once, in one combining aggregation, and weigh as many from there on. Columns
    that are null in the same rows are ranked together: once by themselves, and once within the rows that they have in common
    with each other such group. So a row makes cells for columns x groups, not for pairs of columns. Pairs never known together
    have no row.
    """
    out: list[tuple[str, str, int, float]] = []
    masks = []
    if columns:
        counted = df.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
        rows = cut(counted.withColumn("__id", F.monotonically_increasing_id()))
        masks = null_masks(rows, columns)
    for i, one in enumerate(masks):
        for two in masks[i:]:
            if one is two and len(one) < 2:
                continue
            names = one if one is two else [*one, *two]
            met = rows.where(F.col(one[0]).isNotNull() & F.col(two[0]).isNotNull())
            n = met.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
            if n:
                out += [(a, b, n, r) for a, b, r in correlated_ranks(met, names, n) if one is two or (a in one) != (b in one)]
    place = {c: k for k, c in enumerate(columns)}
    ordered = [(a, b, n, r) if place[a] < place[b] else (b, a, n, r) for a, b, n, r in out]
    return df.sparkSession.createDataFrame(ordered, "a string, b string, n bigint, rho double")


def correlated_ranks(rows: DataFrame, columns: list[str], n: int) -> list[tuple[str, str, float]]:
    """(a, b, rho) of all pairs of columns that hold no null, of rows with __id that stand for __n rows each, n together; 0 for
    constant columns. A cell is made for each value of a row, ranks come from counts of equal values in ranges of (column,
    value), and products of ranks less their mean, which is (n + 1) / 2 with ties too, are summed in the tasks."""
    cells = unpivot(rows, columns, ["__id", "__n"])
    placed = cumulated(cells.groupBy("feature", "value").agg(F.sum("__n").alias("k")), ["feature", "value"], ["k"])
    first = placed.groupBy("feature").agg(F.min("before_k").alias("__first"))
    ranks = placed.join(F.broadcast(first), "feature").select("feature", "value", (F.col("before_k") - F.col("__first") + (F.col("k") + 1) / 2 - (n + 1) / 2).alias("rank"))
    by_row = cells.join(ranks, ["feature", "value"]).groupBy("__id").agg(F.first("__n").alias("__n"), F.map_from_entries(F.collect_list(F.struct("feature", "rank"))).alias("__m"))
    size = len(columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, size)
            total += (v * batch.column(0).to_numpy()[:, None]).T @ v
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    sums = by_row.select("__n", F.array(*[F.element_at("__m", c) for c in columns]).alias("v")).mapInArrow(products, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    m = {(r["i"], r["j"]): r["s"] for r in sums.collect()}
    spread = [math.sqrt(m[i, i]) for i in range(size)]
    return [(a, columns[j], m[i, j] / (spread[i] * spread[j]) if spread[i] and spread[j] else 0.0) for i, a in enumerate(columns) for j in range(i + 1, size)]


def spearman_each(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n, rho of these pairs, each ranked within its own complete rows: pairs are cells of arrays, no row meets another."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("c")
    rows = df.select(cells).select("c.*").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def ranks(v: str) -> DataFrame:
        counts = rows.groupBy("a", "b", v).agg(F.sum("n").alias("k"))
        return counts.select("a", "b", v, (F.sum("k").over(W.partitionBy("a", "b").orderBy(v)) - (F.col("k") - 1) / 2).alias(f"r{v}"))

    r = rows.join(ranks("x"), ["a", "b", "x"]).join(ranks("y"), ["a", "b", "y"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    s = r.groupBy("a", "b").agg(F.sum(n).alias("n"), *[F.sum(n * e).alias(k) for k, e in (("sx", rx), ("sy", ry), ("sxx", rx * rx), ("syy", ry * ry), ("sxy", rx * ry))])
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    return s.select("a", "b", "n", F.coalesce(F.try_divide(top, bottom), F.lit(0.0)).alias("rho"))


def redundant(pairs: list[tuple[str, str, float]], nulls: dict[str, float], limit: float = 0.95) -> dict[str, str]:
    """Column to the representative of its cluster, for columns to leave out: clusters are the connected components of
    |rho| >= limit, represented by the column with the fewest nulls, then the shortest name, then the first."""
    up = {c: c for c in nulls}

    def root(c: str) -> str:
        while up[c] != c:
            c = up[c]
        return c

    for a, b, rho in pairs:
        if abs(rho) >= limit and a in up and b in up:
            up[root(a)] = root(b)
    clusters: dict[str, list[str]] = {}
    for c in nulls:
        clusters.setdefault(root(c), []).append(c)
    out = {}
    for members in clusters.values():
        best = min(members, key=lambda c: (nulls[c], len(c), c))
        out |= {c: best for c in members if c != best}
    return out


def redundancy(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """feature and representative of the redundant columns; at most one row for each column."""
    pairs = [(r["a"], r["b"], r["rho"]) for r in spearman_pairs(df, columns).where(F.abs("rho") >= limit).collect()]
    total = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns]).first()
    gone = redundant(pairs, {c: total["__n"] - total[c] for c in columns}, limit)
    return df.sparkSession.createDataFrame(sorted(gone.items()), "feature string, representative string")


def apart(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """The columns, in their order, without those whose |rho| to one kept before reaches the limit in these rows, where
    missing values count as the column's median. Called with the training rows of a fold, it sees nothing of its test rows."""
    filled = models.impute(df, models.medians(df, columns))
    return prune(columns, {frozenset((r["a"], r["b"])): r["rho"] for r in spearman_pairs(filled, columns).collect()}, limit)


def prune(order: list[str], rho: dict[frozenset, float], limit: float = 0.95) -> list[str]:
    """Greedy pruning: columns in order of worth, each kept unless it is too close to one kept before."""
    kept: list[str] = []
    for c in order:
        if all(abs(rho.get(frozenset((c, k)), 0.0)) < limit for k in kept):
            kept.append(c)
    return kept
