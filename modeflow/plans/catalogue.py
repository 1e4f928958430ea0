"""All registered queries of the engine and their independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import files, labels, more, registry, scans, timeline  # noqa: F401  (importing registers)


def queries() -> dict[str, registry.Plan]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From points to the modal split: filter, sessions, windows, kinematics, cascade, shares."""
    return labels.modal_split(spark, sf_dir)
