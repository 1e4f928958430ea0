"""Where queries register: name, plan, and the SQL an independent engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql.strip()
        return plan

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a few digits (and no negative zero), so that sums in another order compare equal."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
