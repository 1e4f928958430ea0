"""Exact quantiles by distributed selection, for groups of any size.

Groups of at most MOST values are left to Spark's own percentile, whose buffer then has a bound. For the others a first pass
counts values by sign and binary exponent; the bucket that holds a wanted rank is refined by passes over BUCKETS equal parts of
its range, until it holds MOST values or one; only those are gathered and sorted. All groups, columns and ranks share each pass,
and a pass sends at most BUCKETS counts for each of them from a task, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .order import equal_keys

#: Values that one group may gather; parts of a range in a refining pass; wanted ranks that travel by a broadcast at most.
MOST, BUCKETS, BROADCAST_ROWS = 1 << 14, 1 << 10, 20_000
#: Passes that refine at most: a range within one exponent has 2^52 values, and each pass divides it by BUCKETS.
PASSES = 8


def exponent(x: Column) -> Column:
    """Sign and binary exponent as one number, which never falls as x grows; 0 for zero."""
    size = F.abs(x)
    e = F.when(size == float("inf"), F.lit(3000)).otherwise(F.floor(F.log2(size)).cast("int") + 1500)
    return F.when(x == 0, F.lit(0)).otherwise(F.when(x < 0, -e).otherwise(e))


def located(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, __p, __rank, ...) with the bucket of counts (keys, __b, __n, __low, __high) that holds its rank, and its
    rank there. The buckets of a key are few."""
    w = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    c = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    met = wanted.alias("a").join(c.alias("b"), equal_keys("a", "b", keys) & (F.col("a.__rank") >= F.col("b.__before")) & (F.col("a.__rank") < F.col("b.__before") + F.col("b.__n")))
    return met.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.__p", "a.__share", "a.__side", (F.col("a.__rank") - F.col("b.__before")).alias("__rank"), "b.__n", "b.__low", "b.__high")


def inside(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The values in the wanted ranges, each range once, with the range."""
    ranges = wanted.select(*keys, "__low", "__high").distinct()
    few = ranges.count() <= BROADCAST_ROWS
    ranges = F.broadcast(ranges) if few else ranges
    met = rows.alias("a").join(ranges.alias("b"), equal_keys("a", "b", keys) & F.col("a.__x").between(F.col("b.__low"), F.col("b.__high")))
    return met.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.__x", "b.__low", "b.__high")


def selected(rows: DataFrame, keys: list[str], probs: list[float], most: int) -> DataFrame:
    """keys, __p, __v: the quantiles of the values __x (keys, __x) of each key, by selection."""
    size = [F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high")]
    counts = cut(rows.groupBy(*keys, exponent(F.col("__x")).alias("__b")).agg(*size))
    at = F.col("__p") * (F.col("__all") - 1)
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__all")).withColumn("__p", F.explode(F.array(*map(F.lit, probs))))
    total = total.withColumn("__at", at).withColumn("__side", F.explode(F.array(F.lit(0), F.lit(1))))
    rank = F.least(F.floor("__at") + F.col("__side"), F.col("__all") - 1).cast("bigint")
    wanted = total.select(*keys, "__p", (F.col("__at") - F.floor("__at")).alias("__share"), "__side", rank.alias("__rank"))
    open_ = cut(located(counts, wanted, keys))
    done = open_.where((F.col("__n") <= most) | (F.col("__low") == F.col("__high")))
    parts = [done]
    for _ in range(PASSES):
        open_ = open_.where((F.col("__n") > most) & (F.col("__low") < F.col("__high")))
        if open_.isEmpty():
            break
        met = inside(rows, open_, keys)
        place = F.least(F.floor((F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        # a range is known by its ends; ranks are counted from its first value
        new = [F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__l"), F.max("__x").alias("__h")]
        counts = met.groupBy(*keys, "__low", "__high", place.alias("__b")).agg(*new)
        counts = cut(counts.withColumnsRenamed({"__low": "__from", "__high": "__to"}).withColumnsRenamed({"__l": "__low", "__h": "__high"}))
        before = open_.select(*keys, F.col("__low").alias("__from"), F.col("__high").alias("__to"), "__p", "__share", "__side", "__rank")
        open_ = cut(located(counts, before, [*keys, "__from", "__to"]).drop("__from", "__to"))
        parts.append(open_.where((F.col("__n") <= most) | (F.col("__low") == F.col("__high"))))
    else:
        raise RuntimeError("a range of values does not come apart")
    ready = parts[0]
    for p in parts[1:]:
        ready = ready.union(p)
    ready = cut(ready)
    one = ready.where("__low = __high").select(*keys, "__p", "__share", "__side", F.col("__low").alias("__v"))
    several = ready.where("__low < __high")
    held = inside(rows, several, keys).groupBy(*keys, "__low", "__high").agg(F.sort_array(F.collect_list("__x")).alias("__xs"))
    found = several.alias("a").join(held.alias("b"), equal_keys("a", "b", [*keys, "__low", "__high"]))
    found = found.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.__p", "a.__share", "a.__side", F.get("b.__xs", F.col("a.__rank").cast("int")).alias("__v"))
    both = one.union(found).groupBy(*keys, "__p", "__share").agg(F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("__a"), F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("__b"))
    value = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise((1 - F.col("__share")) * F.col("__a") + F.col("__share") * F.col("__b"))
    return both.select(*keys, "__p", value.alias("__v"))


def quantiles(df: DataFrame, keys: list[str], values: dict[str, Column], probs: list[float], most: int = MOST) -> DataFrame:
    """keys and an array for each name of `values`: the exact quantiles at `probs` of the expression, linear between ranks.

    A null or NaN counts as missing; a group whose values are all missing has nulls. Null keys are a group. One row for each
    group, and for no keys one row in all. Columns of the input that are no keys are ignored, whatever their names.
    """
    names = list(values)
    keyed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    of = [f"__k{i}" for i in range(len(keys))]
    x = [F.when(~F.isnan(v.cast("double")), v.cast("double")).alias(f"__v{i}") for i, v in enumerate(values.values())]
    rows = df.select(*keyed, *x)
    n = cut(rows.groupBy(*of).agg(F.count(F.lit(1)).alias("__rows"), F.greatest(*[F.count(f"__v{i}") for i in range(len(names))], F.lit(0)).alias("__n")))
    tops = F.array(*map(F.lit, probs))
    direct = [F.percentile(f"__v{i}", tops).alias(f"__q{i}") for i in range(len(names))]
    big = n.where(F.col("__n") > most).select(*of)
    if big.isEmpty():
        out = rows.groupBy(*of).agg(*direct)
    else:
        small, large = None, rows
        if keys:
            known = F.broadcast(big) if big.count() <= BROADCAST_ROWS else big
            match = equal_keys("a", "b", of)
            small = rows.alias("a").join(known.alias("b"), match, "left_anti").groupBy(*of).agg(*direct)
            large = rows.alias("a").join(known.alias("b"), match, "left_semi")
        long = large.select(*of, F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(f"__v{i}").alias("__x")) for i in range(len(names))])).alias("__e")).select(*of, "__e.*").where("__x is not null")
        got = selected(long, [*of, "__c"], probs, most)
        entry = F.sort_array(F.collect_list(F.struct("__p", "__v")))
        wide = got.groupBy(*of, "__c").agg(entry.alias("__s")).groupBy(*of).agg(*[F.max(F.when(F.col("__c") == i, F.col("__s"))).alias(f"__s{i}") for i in range(len(names))])
        # the probabilities in the order asked for
        at = [F.transform(F.col(f"__s{i}"), lambda s: s["__v"]) for i in range(len(names))]
        order = [sorted(set(probs)).index(p) for p in probs]
        rising = [F.when(a.isNotNull(), F.array(*[F.get(a, F.lit(j)) for j in order])).alias(f"__q{i}") for i, a in enumerate(at)]
        found = wide.select(*of, *rising)
        out = small.unionByName(found) if keys else found
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"__q{i}").alias(m) for i, m in enumerate(names)])
