"""Upserts that read and write only the months that a batch touches.

A table is a folder of immutable pieces, data/b=<batch>/upsert_month=<yyyy-MM>, and of manifests, one JSON file for each batch, which
name the piece that holds each month. Batch b merges its rows with the months it touches, as the last manifest below b has them,
writes them as pieces of its own, and commits by renaming its manifest into place. A reader sees one manifest, whole or not at
all. A batch that is run again finds its manifest and does nothing, or finds none and writes its pieces anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import appended, meeting, month


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def batches(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the committed batches, in order."""
    fs, p, _ = _fs(spark, f"{target}/manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, target: str, below: int | None = None) -> dict[str, int]:
    """The batch that wrote each month, by the last manifest, or the last below a batch's number; empty where there is none."""
    known = [b for b in batches(spark, target) if below is None or b < below]
    return json.loads(spark.read.text(f"{target}/manifests/{known[-1]:09d}.json", wholetext=True).first()[0]) if known else {}


def pieces(spark: SparkSession, target: str, months: dict[str, int], schema) -> DataFrame:
    """The rows of the pieces named."""
    paths = [f"{target}/data/b={b}/upsert_month={m}" for m, b in sorted(months.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def table(spark: SparkSession, target: str, schema, since: str | None = None, until: str | None = None) -> DataFrame:
    """The current rows, of the months from `since` to `until` (yyyy-MM, both included) only."""
    months = manifest(spark, target)
    return pieces(spark, target, {m: b for m, b in months.items() if (since is None or m >= since) and (until is None or m <= until)}, schema)


def commit(spark: SparkSession, target: str, batch_id: int, months: dict[str, int]) -> None:
    """Put a manifest in place by one rename; one that is there already stays."""
    fs, folder, jvm = _fs(spark, f"{target}/manifests")
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(months, sort_keys=True).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(folder, f"{batch_id:09d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)


def clean(spark: SparkSession, target: str, kept: int) -> None:
    """Remove manifests but the last `kept`, and the pieces that none of those names."""
    known = batches(spark, target)
    fs, folder, jvm = _fs(spark, f"{target}/manifests")
    named = {(b, m) for at in known[-kept:] for m, b in json.loads(spark.read.text(f"{target}/manifests/{at:09d}.json", wholetext=True).first()[0]).items()}
    for b in known[:-kept]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"{b:09d}.json"), False)
    data = jvm.org.apache.hadoop.fs.Path(f"{target}/data")
    for piece in fs.listStatus(data) if known and fs.exists(data) else []:
        b = int(piece.getPath().getName().removeprefix("b="))
        if b > known[-1]:
            continue  # being written
        left = [s.getPath() for s in fs.listStatus(piece.getPath()) if s.isDirectory()]
        for p in left:
            if (b, p.getName().removeprefix("upsert_month=")) not in named:
                fs.delete(p, True)
        if not any(n[0] == b for n in named):
            fs.delete(piece.getPath(), True)


def merge(batch: DataFrame, batch_id: int, target: str, keys: list[str], time: str = "timestamp", kept: int = 3) -> dict[str, int]:
    """Merge a batch, the last row of each key winning; returns the months that were read, with the batches that wrote them.

    `time` (ms) must be one of the keys, so that a key's rows are of one month. Rows without a time are of the month `none`.
    """
    if time not in keys:
        raise ValueError(f"{time} must be a key: else rows of a key could lie in several months")
    spark = batch.sparkSession
    if batch_id in batches(spark, target):
        return {}
    named = F.coalesce(month(F.col(time)), F.lit("none"))
    held = batch.persist(StorageLevel.MEMORY_AND_DISK)
    touched = [r[0] for r in held.select(named).distinct().collect()]  # months: few
    before = manifest(spark, target, below=batch_id)
    read = {m: before[m] for m in touched if m in before}
    merged = appended(pieces(spark, target, read, batch.schema), held, keys)
    if touched:
        merged.withColumn("upsert_month", named).repartition("upsert_month", F.floor(F.col(time) / 86_400_000)).write.mode("overwrite").partitionBy("upsert_month").parquet(f"{target}/data/b={batch_id}")
    held.unpersist()
    commit(spark, target, batch_id, before | dict.fromkeys(touched, batch_id))
    clean(spark, target, kept)
    return read


def upsert_by_month(stream: DataFrame, target: str, keys: list[str], checkpoint: str, time: str = "timestamp", kept: int = 3):
    """Merge each micro-batch of a stream of the files there are; a lost driver or executor leaves the last manifest valid."""

    def run(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id, target, keys, time, kept)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_labels(source: DataFrame, target: str, run: int, until_ms: int, days: int = 60, floor_ms: int | None = None, kept: int = 3) -> dict[str, int]:
    """Merge the reference intervals that meet the last `days` before until_ms again, as labels are corrected after the fact.

    source: userId, started_at, finished_at, mode (an export, a table or a micro-batch); the range reaches its scan. An interval is
    known by its user and start: a corrected one replaces it, others stay. Only the months in the range are read and written;
    floor_ms bounds it from below. Returns the months that were read, as `merge` does.
    """
    since = until_ms - days * 86_400_000
    since = since if floor_ms is None else max(since, floor_ms)
    return merge(meeting(source, since, until_ms), run, target, ["userId", "started_at"], "started_at", kept)


def streamed_labels(stream: DataFrame, target: str, checkpoint: str, until_ms: int, days: int = 60, floor_ms: int | None = None):
    """The same for each micro-batch of a stream of label files."""

    def run(batch: DataFrame, batch_id: int) -> None:
        refresh_labels(batch, target, batch_id, until_ms, days, floor_ms)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
