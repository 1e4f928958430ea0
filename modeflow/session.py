"""Session settings that all queries rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Results depend on the time zone only; the others let Spark adapt plans to the data it meets.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "modeflow", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that can change at run time to a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only in a local session where it is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = named or tempfile.mkdtemp(prefix="modeflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute rows once, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
