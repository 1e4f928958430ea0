"""Places in a global order, and seeded draws, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut


def cumulated(rows: DataFrame, order: list[str], amounts: list[str]) -> DataFrame:
    """rows with before_<amount>, the sum of each amount over all rows that come before in the order (which must be strict).

    Rows are dealt to ranges of the order; each range is summed by itself and shifted by the sums of the ranges before it, a
    table of one row for each range. Only rows of one range meet in a task.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("__range").agg(*[F.sum(a).alias(f"__sum_{a}") for a in amounts])
    ahead = sums.select("__range", *[F.coalesce(F.sum(f"__sum_{a}").over(before), F.lit(0)).alias(f"__ahead_{a}") for a in amounts])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(F.broadcast(ahead), "__range")
    return out.withColumns({f"before_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"__ahead_{a}") for a in amounts}).drop("__range", *[f"__ahead_{a}" for a in amounts])


def equal_keys(a: str, b: str, keys: list[str]) -> Column:
    """Whether two aliased rows have the same keys; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def with_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """rows with aggregates of their keys: one row for each key, combined before it is shuffled and joined back, so the rows of
    a key never meet in one task as they would in a window."""
    table = rows.groupBy(*keys).agg(*[v.alias(n) for n, v in totals.items()])
    met = rows.alias("a").join(table.alias("b"), equal_keys("a", "b", keys))
    return met.select("a.*", *[F.col(f"b.`{n}`") for n in totals])


def shifted(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, int]], bucket: Column) -> DataFrame:
    """rows with columns of other rows of their keys: name -> (column, how many rows later in the order; earlier if negative).

    What lag and lead over whole keys give, but rows meet only within a bucket (an expression that does not fall in the order).
    Each bucket also gets the rows just before and after it, as many as the farthest shift: they are taken from the first and
    last rows of all buckets, which alone are numbered by key. Null where there is no such row.
    """
    back, ahead = max([0, *(-k for _, k in columns.values())]), max([0, *(k for _, k in columns.values())])
    most = max(back, ahead, 1)
    needed = list(dict.fromkeys([*keys, *order, *(c for c, _ in columns.values())]))
    placed = rows.withColumn("__bkt", bucket)
    own = W.partitionBy(*keys, "__bkt").orderBy(*order)
    last = W.partitionBy(*keys, "__bkt").orderBy(*[F.desc(o) for o in order])
    ends = placed.select(*needed, "__bkt").withColumns({"__i": F.row_number().over(own), "__j": F.row_number().over(last)}).where((F.col("__i") <= most) | (F.col("__j") <= most))
    ends = ends.withColumn("__at", F.row_number().over(W.partitionBy(*keys).orderBy("__bkt", *order)))
    spans = ends.groupBy(*keys, "__bkt").agg(F.min("__at").alias("__from"), F.max("__at").alias("__to"))
    reach = F.concat(F.sequence(F.col("__from") - back, F.col("__from") - 1) if back else F.array().cast("array<int>"), F.sequence(F.col("__to") + 1, F.col("__to") + ahead) if ahead else F.array().cast("array<int>"))
    asked = spans.select(*keys, F.col("__bkt").alias("__for"), F.explode(reach).alias("__at"))
    halo = ends.alias("a").join(asked.alias("b"), equal_keys("a", "b", [*keys, "__at"])).select(*[F.col(f"a.`{c}`") for c in needed], F.col("b.__for").alias("__bkt"), F.lit(False).alias("__own"))
    both = placed.withColumn("__own", F.lit(True)).unionByName(halo, allowMissingColumns=True)
    moved = {n: F.lead(c, k).over(own) if k > 0 else F.lag(c, -k).over(own) for n, (c, k) in columns.items()}
    return both.withColumns(moved).where("__own").drop("__own", "__bkt")


def numbered(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "__at", total: str = "__total") -> DataFrame:
    """rows with their place (from 0) in the order within their keys, and the number of rows of the keys; rows meet within buckets."""
    placed = rows.withColumn("__bkt", bucket)
    sizes = placed.groupBy(*keys, "__bkt").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__bkt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "__bkt", before.alias("__before"), F.sum("__n").over(w).alias(total))
    inside = F.row_number().over(W.partitionBy(*keys, "__bkt").orderBy(*order)) - 1
    met = placed.withColumn("__i", inside).alias("a").join(sizes.alias("b"), equal_keys("a", "b", [*keys, "__bkt"]))
    return met.select("a.*", (F.col("a.__i") + F.col("b.__before")).alias(name), F.col(f"b.{total}")).drop("__bkt", "__i")


def drawn(*keys: str | Column, seed: int) -> Column:
    """A number in [0, 1) by the keys and a seed, the same on every run and in every engine: 32 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("/", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def drawn_sql(*keys: str, seed: int) -> str:
    """The same draw in SQL."""
    spelled = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5({spelled} || '/{seed}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
