"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: White space of the contracts: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that cross to a Python worker at once: long texts must not come ten thousand at a time.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


#: Applications that the package was shipped to.
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver has it, and bound the batches that cross to them.

    The bounds stay set in the session, as plans run later than they are made. On a cluster the package is shipped to the
    executors as an archive, once for each application; workers of a local session read the driver's folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    if context.master.startswith("local"):
        env = context.environment
        paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    elif context.applicationId not in _shipped:
        archive = os.path.join(tempfile.mkdtemp(prefix="modeflow-"), "modeflow.zip")  # of code, on the driver, which serves it
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(Path(ROOT, "modeflow").rglob("*.py")):
                out.write(file, file.relative_to(ROOT))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in a local session where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="modeflow-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (removed by Spark once it is unreachable)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a compressed table in the shared folder and read it again: for rows too wide to checkpoint.

    The table goes when the driver ends; until then it outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(mod: int, rest: int):
    """crc32 of doc_id as text, modulo mod, equals rest."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About `rows` rows chosen by a hash of the key, all of them where there are fewer; the same on every run."""
    total = df.count()
    if total <= rows:
        return df
    limit = int(rows / total * (1 << 32))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 32)) < limit)
