"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined in three steps, and every step groups by the digest AND the whole text, so that two texts are only ever
merged after a comparison of their full content:

1. locally: the partial aggregate of each map task leaves one row for each text of the task;
2. salted: those rows meet by (digest, salt); the salt comes from the map task, so a text that fills a third of the table is
   spread over `salts` reducers;
3. globally: at most `salts` winners of a text meet and give the row that stays.

The verdicts return to the rows by digests (SHA-256, length and another hash). The winners hold every text there is, compared
in full, so where a set of digests belongs to one winner only, each row with them has that very text; should two texts ever
share them, the job fails rather than mix them up. Verdicts of the largest groups, 10,000 at most, are broadcast; the others
meet their rows by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType

from .common import cut, table, text_or_empty

#: Groups with more than this share of all rows count as hot: so there are 10,000 of them at most.
HOT_SHARE = 1e-4


def winners(df: DataFrame, best: Column, text: Column, salts: int = 16, order: Column | None = None) -> DataFrame:
    """One row for each distinct text: __sha, __text, __best (of its rows the largest `best`, or that of the largest `order`),
    __size (their number)."""
    columns = [best.alias("__best")] + ([] if order is None else [order.alias("__order")])
    rows = df.select(F.sha2(text.cast("binary"), 256).alias("__sha"), text.alias("__text"), (F.spark_partition_id() % salts).alias("__salt"), *columns)
    top = [F.max("__best").alias("__best")] if order is None else [F.max_by("__best", "__order").alias("__best"), F.max("__order").alias("__order")]
    salted = rows.groupBy("__sha", "__salt", "__text").agg(*top, F.count(F.lit(1)).alias("__size"))
    return salted.groupBy("__sha", "__text").agg(*top, F.sum("__size").alias("__size"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, salts: int = 16) -> DataFrame:
    """For every row its id, keep_id, group_size, kept and text_sha256; the row with the largest id of a text stays.

    A null text counts as empty. A null id never stays while its text has another id. Rows that repeat an id and a text are
    counted in group_size and share one verdict. Other columns are ignored, whatever their names.
    """
    text = text_or_empty(text_col)
    text = normalise(text) if normalise else text
    digests = ["__sha", "__n", "__h"]
    best = winners(df, F.col(id_col), text, salts).groupBy("__sha", F.length("__text").alias("__n"), F.xxhash64("__text").alias("__h"))
    best = best.agg(F.max("__best").alias("__best"), F.max("__size").alias("__size"), F.count(F.lit(1)).alias("__texts"))
    one = F.when(F.col("__texts") == 1, F.col("__size")).otherwise(F.raise_error(F.lit("two different texts share all their digests")))
    best = cut(best.select(*digests, "__best", one.alias("__size")))
    total = best.agg(F.sum("__size")).first()[0] or 0
    hot = best.where(F.col("__size") > total * HOT_SHARE).select(*digests, F.struct("__best", "__size").alias("__hot"))
    rows = df.select(F.col(id_col).alias("__id"), F.sha2(text.cast("binary"), 256).alias("__sha"), F.length(text).alias("__n"), F.xxhash64(text).alias("__h"))
    rows = rows.join(F.broadcast(hot), digests, "left").withColumn("__key", F.when(F.col("__hot").isNull(), F.col("__h")).otherwise(F.xxhash64("__id")))
    cold = best.where(F.col("__size") <= total * HOT_SHARE).select("__sha", "__n", F.col("__h").alias("__key"), F.struct("__best", "__size").alias("__cold"))
    joined = rows.join(cold, ["__sha", "__n", "__key"], "left").withColumn("__v", F.coalesce("__hot", "__cold"))
    return joined.select(F.col("__id").alias(id_col), F.col("__v.__best").alias("keep_id"), F.col("__v.__size").alias("group_size"), F.col("__id").eqNullSafe(F.col("__v.__best")).alias("kept"), F.col("__sha").alias("text_sha256"))


def ordered(kind: DataType) -> bool:
    """Whether values of a type can be compared (maps, variants and intervals of the calendar cannot)."""
    if isinstance(kind, StructType):
        return all(ordered(f.dataType) for f in kind.fields)
    return ordered(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType, CalendarIntervalType))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, with all columns of the input: one row for each distinct text (null counts as empty), that of the
    largest id. Of rows that repeat an id and a text the one with the largest other columns stays; columns that have no order
    decide nothing."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    columns = [F.col(id_col), F.col(text_col).isNotNull().alias("__has"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)]]
    sortable = [c for c, name in zip(columns, [id_col, text_col, *others], strict=True) if ordered(df.schema[name].dataType)]
    kept = winners(df, F.struct(*columns), text_or_empty(text_col), salts, None if len(sortable) == len(columns) else F.struct(*sortable))
    named = {c: F.col(f"__best.__c{i}") for i, c in enumerate(others)}
    named |= {id_col: F.col("__best").getField(id_col), text_col: F.when(F.col("__best.__has"), F.col("__text"))}
    return kept.select(*[named[c].alias(c) for c in df.columns])


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
