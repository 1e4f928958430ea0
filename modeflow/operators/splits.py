"""Train and test splits as columns: no rows are copied, a split is a filter on what is added here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import cumulated, drawn


def session_starts(windows: DataFrame) -> DataFrame:
    """session_id, start, i (0-based by start, then id) and n: one row for each session."""
    s = windows.groupBy("session_id").agg(F.min("ts_start").alias("start"))
    return numbered(s, ["start", "session_id"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, their place from 0 in a strict order, and n, their number."""
    one = rows.withColumn("__one", F.lit(1).cast("bigint"))
    placed = cumulated(one, order, ["__one"]).withColumnRenamed("before___one", "i").drop("__one")
    return placed.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))


def leave_one_user_out(windows: DataFrame) -> DataFrame:
    """fold (the user left out), n_train, n_test; counts from one row for each user."""
    n = windows.groupBy(F.col("userId").alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    return n.join(F.broadcast(n.agg(F.sum("n_test").alias("__all")))).select("fold", "n_test", (F.col("__all") - F.col("n_test")).alias("n_train"))


def temporal(windows: DataFrame, share: float = 0.2) -> DataFrame:
    """windows with split: the sessions that start last, int(n * share) of them and one at least, are test."""
    s = session_starts(windows)
    test = s.where(F.col("i") >= F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))).select("session_id", F.lit("test").alias("split"))
    return windows.join(test, "session_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def rolling_blocks(windows: DataFrame, folds: int = 5, last: float = 0.5) -> DataFrame:
    """fold, lo, hi (session positions) and block_start of the test blocks that cover the last part of the sessions."""
    step = last / folds
    edges = [1.0 - last + step * k for k in range(folds + 1)]
    s = session_starts(windows)
    blocks = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("fold"), F.lit(edges[k]).alias("a"), F.lit(edges[k + 1]).alias("b")) for k in range(folds)])).alias("e")
    cut = s.agg(F.max("n").alias("n")).select("n", blocks).select(F.col("e.fold").alias("fold"), F.floor(F.col("n") * F.col("e.a")).alias("lo"), F.floor(F.col("n") * F.col("e.b")).alias("hi"))
    starts = s.join(F.broadcast(cut), F.col("i") == F.col("lo")).select("fold", "lo", "hi", F.col("start").alias("block_start"))
    return starts


def rolling(windows: DataFrame, folds: int = 5, last: float = 0.5, least: int = 10) -> DataFrame:
    """fold, block_start, n_train, n_test: test is a block of sessions, train all sessions that start strictly before it.

    Folds with fewer than `least` test windows, or no training windows, are left out.
    """
    per = windows.groupBy("session_id").agg(F.count(F.lit(1)).alias("w"))
    s = session_starts(windows).join(per, "session_id")
    met = s.join(F.broadcast(rolling_blocks(windows, folds, last)), (F.col("start") < F.col("block_start")) | F.col("i").between(F.col("lo"), F.col("hi") - 1))
    test = F.col("i").between(F.col("lo"), F.col("hi") - 1)
    out = met.groupBy("fold", "block_start").agg(F.sum(F.when(~test & (F.col("start") < F.col("block_start")), F.col("w")).otherwise(0)).alias("n_train"), F.sum(F.when(test, F.col("w")).otherwise(0)).alias("n_test"))
    return out.where((F.col("n_test") >= least) & (F.col("n_train") > 0))


def fold_rows(windows: DataFrame, fold: int, folds: int = 5, last: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(train, test) windows of one rolling fold, by semi joins."""
    block = rolling_blocks(windows, folds, last).where(F.col("fold") == fold)
    s = session_starts(windows).join(F.broadcast(block))
    inside = F.col("i").between(F.col("lo"), F.col("hi") - 1)
    test = s.where(inside).select("session_id")
    train = s.where(~inside & (F.col("start") < F.col("block_start"))).select("session_id")
    return windows.join(train, "session_id", "left_semi"), windows.join(test, "session_id", "left_semi")


def hashed_folds(windows: DataFrame, folds: int = 5, group: str = "session_id", seed: int = 42) -> DataFrame:
    """Adds fold 0..folds-1 by a hash of the group, so that no group is split."""
    return windows.withColumn("fold", F.floor(drawn(group, seed=seed) * folds).cast("int"))


def stratified_folds(windows: DataFrame, label: str, folds: int = 5, group: str = "session_id", seed: int = 42) -> DataFrame:
    """Adds fold 0..folds-1 so that no group is split and every fold gets its part of each kind of group.

    A group's kind is its most frequent label (of equals the first by name; no label is a kind, too). Groups of a kind are
    dealt to and fro over the folds, the largest first, equal ones by a seeded draw. Rows without a group have no fold.
    """
    counts = windows.groupBy(group, F.coalesce(F.col(label), F.lit("")).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    groups = counts.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by("__label", F.struct(-F.col("__n"), F.col("__label"))).alias("__kind"), (-F.sum("__n")).alias("__less"))
    placed = numbered(groups.withColumn("__draw", drawn(group, seed=seed)), ["__kind", "__less", "__draw", group])
    turn = F.col("i") % (2 * folds)
    dealt = placed.select(group, F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold"))
    return windows.join(dealt, group, "left")


def random_sessions(windows: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """windows with split: a share of the sessions, one at least, chosen by a seeded hash, is test."""
    s = numbered(windows.select("session_id").distinct().withColumn("h", drawn("session_id", seed=seed)), ["h", "session_id"])
    test = s.where(F.col("i") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))).select("session_id", F.lit("test").alias("split"))
    return windows.join(test, "session_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))
