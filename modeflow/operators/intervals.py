"""Joins of windows, points and frames with labelled intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_MS = 3_600_000


def buckets(start: str, end: str, size: int = BUCKET_MS):
    return F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size)))


def overlap_labels(windows: DataFrame, intervals: DataFrame, keys: list[str], window_id: list[str], least: float = 0.8, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """windows with the label of the one interval that covers most of each, if that is at least `least` of it, else null.

    Ties go to the interval that starts first, then to the first by seq. Overlaps of several intervals are never summed. The
    join is an equi-join on user and time buckets; a pair that meets in several buckets counts once.
    """
    w = windows.select(*keys, *window_id, "ts_start", "ts_end", buckets("ts_start", "ts_end", bucket_ms).alias("__b"))
    i = intervals.withColumn("__b", buckets("started_at", "finished_at", bucket_ms))
    met = w.join(i, [*keys, "__b"]).where((F.col("started_at") < F.col("ts_end")) & (F.col("finished_at") > F.col("ts_start")))
    cover = F.least("ts_end", "finished_at") - F.greatest("ts_start", "started_at")
    best = met.groupBy(*keys, *window_id, "ts_start", "ts_end").agg(F.min_by(F.struct("mode", cover.alias("c")), F.struct(-cover, "started_at", "seq")).alias("__best"))
    frac = F.col("__best.c") / (F.col("ts_end") - F.col("ts_start"))
    best = best.select(*keys, *window_id, "ts_start", F.when(frac >= least, F.col("__best.mode")).alias("label"))
    return windows.join(best, [*keys, *window_id, "ts_start"], "left")


def as_of(frames: DataFrame, intervals: DataFrame, keys: list[str], frame: str = "ts_ms", label: str = "mode", name: str = "label") -> DataFrame:
    """frames with the label of the last interval that started at or before each, if that one still lasts (closed end).

    An earlier interval that still covers the frame is not consulted. Both sides are cut into buckets of time; each bucket
    starts with the last interval of the buckets before it, and is one sorted pass over the union of its frames and intervals.
    So a long timeline is spread over many tasks.
    """
    kind = "struct<e:bigint,l:string>"
    bucket = F.floor(F.col("__t") / BUCKET_MS)
    a = frames.select("*", F.col(frame).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__s")).withColumn("__b", bucket)
    b = intervals.select(*keys, F.col("started_at").alias("__t"), F.lit(0).alias("__side"), F.col("seq").alias("__seq"), F.struct(F.col("finished_at").alias("e"), F.col(label).alias("l")).cast(kind).alias("__s")).withColumn("__b", bucket)
    ends = b.groupBy(*keys, "__b").agg(F.max_by("__s", F.struct("__t", "__seq")).alias("__s"))
    spots = ends.unionByName(a.select(*keys, "__b").distinct(), allowMissingColumns=True).groupBy(*keys, "__b").agg(F.first("__s", ignorenulls=True).alias("__s"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = spots.withColumn("__s", F.last("__s", ignorenulls=True).over(before)).withColumn("__side", F.lit(-1))
    both = a.unionByName(b, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    w = W.partitionBy(*keys, "__b").orderBy("__before", "__t", "__side", "__seq").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("__before", F.col("__side") >= 0)
    last = both.withColumn("__last", F.last("__s", ignorenulls=True).over(w)).where("__side = 1")
    return last.withColumn(name, F.when(F.col(frame) <= F.col("__last.e"), F.col("__last.l"))).drop("__t", "__side", "__seq", "__s", "__last", "__b", "__before")


def frames(spans: DataFrame, keys: list[str], step_ms: int = 1000, start: str = "t0_ms", end: str = "t1_ms") -> DataFrame:
    """keys and ts_ms of all frames of fixed resolution from the start to the end of each span."""
    return spans.select(*keys, F.explode(F.sequence(F.col(start), F.col(end), F.lit(step_ms).cast("bigint"))).alias("ts_ms")).distinct()


def pieces(lists: dict[str, DataFrame], keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """keys, a, b and a column for each list: the stretches [a, b] (ms, closed) on which no list changes, with its values there.

    lists: keys, started_at, finished_at (closed), seq and value. At each time a list has the value of the interval that started
    last, then of the last seq, if that one still lasts, else null. Stretches before the first start and after the last end of
    a key are left out. Rows follow the intervals, not the time between them. Events are sorted within time buckets; the
    last start of each list and the first event of the next bucket are carried between them, so a long timeline is spread.
    """
    names = list(lists)
    events = None
    for i, name in enumerate(names):
        rows = lists[name]
        state = F.struct(F.col("finished_at").cast("bigint").alias("e"), F.col("value").alias("v"))
        start = rows.select(*keys, F.col("started_at").cast("bigint").alias("__t"), F.lit(i).alias("__side"), F.col("seq").alias("__seq"), state.alias(f"__s{i}"))
        end = rows.select(*keys, (F.col("finished_at").cast("bigint") + 1).alias("__t"))
        part = start.unionByName(end, allowMissingColumns=True)
        events = part if events is None else events.unionByName(part, allowMissingColumns=True)
    events = events.where("__t is not null").withColumn("__b", F.floor(F.col("__t") / bucket_ms))
    states = [f"__s{i}" for i in range(len(names))]
    last = [F.max_by(s, F.when(F.col(s).isNotNull(), F.struct("__t", "__seq"))).alias(s) for s in states]
    spots = events.groupBy(*keys, "__b").agg(F.min("__t").alias("__first"), *last)
    order = W.partitionBy(*keys).orderBy("__b")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    carried = spots.select(*keys, "__b", F.lead("__first").over(order).alias("__after"), *[F.last(s, ignorenulls=True).over(before).alias(f"__c{s}") for s in states])
    inside = W.partitionBy(*keys, "__b").orderBy("__t", F.col("__seq").asc_nulls_first())
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumns({"__next": F.lead("__t").over(inside)} | {s: F.last(s, ignorenulls=True).over(upto) for s in states})
    both = seen.join(carried, [*keys, "__b"]).withColumn("__next", F.coalesce("__next", "__after")).where("__next > __t")
    value = lambda s: F.when(F.col("__t") <= F.coalesce(F.col(s), F.col(f"__c{s}"))["e"], F.coalesce(F.col(s), F.col(f"__c{s}"))["v"])
    return both.select(*keys, F.col("__t").alias("a"), (F.col("__next") - 1).alias("b"), *[value(s).alias(n) for s, n in zip(states, names, strict=True)])


def frame_cells(truth: DataFrame, predicted: DataFrame, keys: list[str], step_ms: int = 1000, spans: DataFrame | None = None) -> DataFrame:
    """keys, t, p, n: how many frames of each true and predicted label there are, without making a frame.

    truth, predicted: keys, started_at, finished_at, seq, mode. Frames lie every step_ms from the start of each span (keys, t0_ms,
    t1_ms; disjoint, closed), or, without spans, from the first start of a key in either list. A frame has the label of the
    interval that started last, if that one still lasts (null if not); frames without any label are left out.
    """
    as_list = lambda df, v: df.select(*keys, "started_at", "finished_at", "seq", F.col(v).alias("value"))
    lists = {"t": as_list(truth, "mode"), "p": as_list(predicted, "mode")}
    if spans is not None:
        lists["o"] = spans.select(*keys, F.col("t0_ms").alias("started_at"), F.col("t1_ms").alias("finished_at"), F.lit(0).alias("seq"), F.col("t0_ms").alias("value"))
        parts = pieces(lists, keys).where("o is not null")
    else:
        first = lists["t"].union(lists["p"]).groupBy(*keys).agg(F.min("started_at").alias("o"))
        parts = pieces(lists, keys).join(first, keys)
    n = F.floor((F.col("b") - F.col("o")) / step_ms) - F.ceil((F.col("a") - F.col("o")) / step_ms) + 1
    return parts.where("t is not null or p is not null").withColumn("n", n).where("n > 0").groupBy(*keys, "t", "p").agg(F.sum("n").alias("n"))
