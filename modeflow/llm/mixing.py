"""Mixing sources to target weights: blocks of equal size apportioned by the Sainte-Lague rule, in DataFrame operations only.

Sources get word targets by weight. Blocks of about BLOCK words are seats: first the sources, then the shards of each source
get integer numbers of them by highest quotients votes / (2k + 1). A shard is a hashed part of a source; its documents lie in
seeded order on an axis of words cut into equal blocks. A quota of q blocks out of n takes every block q div n times and, once
more, q mod n blocks from a seeded start onwards. So no block is ever materialised, and only (id, source, size) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, table, text_or_empty

#: Words of a block; about so many words of all sources together for each shard number, and the most such numbers (a bound on
#: the rows of the quota tables for each source); the seed; the most a source repeats.
BLOCK, SHARD_WORDS, SHARDS, SEED, REPEATS = 16, 50_000, 65_536, "17", 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: weighted shares of all sizes, none above `repeats` times its source's size.

    The excess of sources at that limit is shared again by weight until none is above. With r = limit / weight in ascending
    order, the level (total - limits of the sources before) / (weights from here on) rises while sources are at their limit
    and falls after, so its largest value is the level of all others.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = src.withColumn("__rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("__w", weight).withColumn("__limit", F.col("source_size") * F.lit(float(repeats)))
    order = W.orderBy(F.col("__limit") / F.col("__w"), "__rank")
    before, onwards, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("__w").over(onwards)
    levelled = ranked.withColumn("__level", level).withColumn("__level", F.max("__level").over(everything))
    return levelled.select("source", "source_size", F.least(F.col("__limit"), F.col("__level") * F.col("__w")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Adds `quota`: the `seats` of each group (a column) go one by one to the highest votes / (2k + 1); ties to the first party.

    With n parties, V votes and S seats the last winning quotient lies between V / (S + n/2) and V / (S - n/2), so a party's
    quota is known up to its share of n seats; only the quotients in that band are ranked, a few for each party.
    """
    g = W.partitionBy(*group)
    x = parties.withColumn("__vote", F.col(votes).cast("double")).withColumn("__votes", F.sum("__vote").over(g)).withColumn("__n", F.count(F.lit(1)).over(g))
    fair, slack = F.coalesce(F.try_divide(F.col("__vote") * F.col(seats), F.col("__votes")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("__vote") * F.col("__n"), 2 * F.col("__votes")), F.lit(0.0))
    x = x.withColumn("__low", F.greatest(F.lit(0), F.floor(fair - slack) - 1)).withColumn("__high", F.ceil(fair + slack) + 1)
    x = x.withColumn("__left", F.col(seats) - F.sum("__low").over(g))
    bids = x.select(*group, *party, "__vote", "__left", F.explode(F.sequence("__low", "__high")).alias("__k"))
    rank = F.row_number().over(g.orderBy((F.col("__vote") / (2 * F.col("__k") + 1)).desc(), *party, "__k"))
    won = bids.withColumn("__rank", rank).where((F.col("__rank") <= F.col("__left")) & (F.col("__vote") > 0)).groupBy(*group, *party).agg(F.count(F.lit(1)).alias("__more"))
    joined = x.join(won, [*group, *party], "left")
    return joined.withColumn("quota", F.col("__low") + F.coalesce("__more", F.lit(0))).drop("__vote", "__votes", "__n", "__low", "__high", "__left", "__more")


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts], F.lit(SEED)).cast("binary"))


def number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of df with __size, __source_size, __target and __taken (words that the mix takes, repeats counted).

    A null text has size 0, a null source is a source of its own and comes last. Rows that repeat an id are separate
    documents, in the order of their texts; rows without an id are dealt to shards by theirs. Columns of df may have any
    names that do not begin with two underscores.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = df.withColumn("__size", F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint"))
    identity = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text_or_empty(text_col).cast("binary"))))
    rows = rows.withColumn("__key", key).withColumn("__digest", seeded(identity)).withColumn("__tie", F.xxhash64(text_or_empty(text_col)))
    small = cut(rows.select(F.col(source_col).alias("source"), "__key", "__digest", F.col("__size").alias("size")))
    targets = source_targets(small).withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    targets = targets.withColumn("__seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("bigint")).withColumn("__all", F.lit(1))
    sources = sainte_lague(targets, ["__all"], ["__key"], "target", "__seats").select("__key", "source_size", "target", F.col("quota").alias("__source_quota"))
    words = small.agg(F.sum("size")).first()[0] or 0
    split = min(SHARDS, max(1, words // shard_words))
    shard = F.pmod(number(F.col("__digest")), F.lit(split)).alias("__shard")
    parts = small.groupBy("__key", shard).agg(F.sum("size").alias("__words")).join(sources, "__key")
    quotas = sainte_lague(parts, ["__key"], ["__shard"], "__words", "__source_quota")
    blocks = F.greatest(F.lit(1), F.floor(F.col("__words") / F.lit(float(block)) + 0.5).cast("bigint"))
    quotas = quotas.withColumn("__n", blocks).withColumn("__q", F.least(F.col("quota"), REPEATS * F.col("__n")))
    quotas = quotas.withColumn("__o", F.pmod(number(seeded(F.col("__key"), F.col("__shard"))), F.col("__n")))
    quotas = cut(quotas.select("__key", "__shard", "__words", "__n", "__q", "__o", F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    placed = rows.withColumn("__shard", shard)
    placed = placed.withColumn("__end", F.sum("__size").over(W.partitionBy("__key", "__shard").orderBy("__digest", "__size", "__tie").rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["__key", "__shard"])
    edge = lambda b: F.expr(f"(({b}) * __words) div __n")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("__end"), b) - F.greatest(F.col("__end") - F.col("__size"), a))
    once = overlap(edge("__o"), edge("least(__n, __o + __q % __n)")) + overlap(F.lit(0), edge("greatest(0, __o + __q % __n - __n)"))
    taken = F.expr("__q div __n") * F.col("__size") + once
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], "__size", "__source_size", "__target", taken.cast("bigint").alias("__taken"))


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of df: each document as often as its taken words are nearest to, possibly not at all."""
    mixed = mix(df, **options)
    copies = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size") + 0.5)).otherwise(0).cast("int")
    return mixed.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).drop("__copy")


def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


#: The same rows by ranking every quotient of every party.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) || '/17') AS h FROM documents),
ranked AS (SELECT k, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY any_value(source) NULLS LAST) AS rn FROM d GROUP BY k),
weighed AS (SELECT *, CAST([1, 2, 3][(rn - 1) % 3 + 1] AS DOUBLE) AS w, total * 3.0::DOUBLE AS most FROM ranked),
levels AS (SELECT *, (sum(total) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT k, total, least(most, max(level) OVER () * w) AS target FROM levels),
seats AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS n FROM targets),
source_bids AS (SELECT k, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, k, i) AS place FROM targets, seats, LATERAL (SELECT unnest(range(0, seats.n + 1)) AS i) WHERE target > 0),
source_quotas AS (SELECT t.*, (SELECT count(*) FROM source_bids b, seats WHERE b.k = t.k AND place <= seats.n) AS quota FROM targets t),
split AS (SELECT least(65536, greatest(1, CAST(coalesce(sum(size), 0) AS BIGINT) // 50000)) AS n FROM d),
sharded AS (SELECT d.*, CAST('0x' || substr(h, 1, 8) AS BIGINT) % split.n AS shard FROM d, split),
shards AS (SELECT k, shard, CAST(sum(size) AS BIGINT) AS words FROM sharded GROUP BY ALL),
shard_bids AS (SELECT s.k, shard, row_number() OVER (PARTITION BY s.k ORDER BY words / CAST(2 * i + 1 AS DOUBLE) DESC, shard, i) AS place, q.quota FROM shards s JOIN source_quotas q USING (k), LATERAL (SELECT unnest(range(0, q.quota + 1)) AS i) WHERE words > 0),
won AS (SELECT k, shard, count(*) AS quota FROM shard_bids WHERE place <= quota GROUP BY ALL),
blocks AS (SELECT s.*, greatest(1, CAST(floor(words / 16.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS n, coalesce(quota, 0) AS quota FROM shards s LEFT JOIN won USING (k, shard)),
starts AS (SELECT *, least(quota, 3 * n) AS q, CAST('0x' || substr(md5(k || '/' || shard || '/17'), 1, 8) AS BIGINT) % n AS o FROM blocks),
placed AS (SELECT doc_id, k, shard, size, CAST(sum(size) OVER (PARTITION BY k, shard ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM sharded)
SELECT doc_id, size, total AS source_size, target, CAST((q // n) * size
  + greatest(0, least(e, least(n, o + q % n) * words // n) - greatest(e - size, o * words // n))
  + greatest(0, least(e, greatest(0, o + q % n - n) * words // n) - greatest(e - size, 0)) AS BIGINT) AS taken
FROM placed JOIN starts USING (k, shard) JOIN source_quotas USING (k)
"""
