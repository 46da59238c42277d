"""Registered queries: a Spark plan and, where SQL can say it, its oracle.

Doubles are rounded on both sides so that different summation orders of two
engines compare equal; the tiny shift keeps exact halves off the boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, TimestampType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and drop the time zone from timestamps."""
    cols = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            half = 0.49 * 10.0 ** -digits
            cols[f.name] = F.when(F.abs(c) < F.lit(half), F.lit(0.0)).otherwise(F.round(c + F.lit(2e-10), digits))
        elif isinstance(f.dataType, TimestampType):
            cols[f.name] = c.cast("timestamp_ntz")
    return df.withColumns(cols) if cols else df


def rounded(sql: str, doubles: Sequence[str], digits: int = 6) -> str:
    if not doubles:
        return sql
    half = 0.49 * 10.0 ** -digits
    parts = ", ".join(
        f"CASE WHEN abs({c}) < {half} THEN CAST(0 AS DOUBLE) ELSE round(CAST({c} AS DOUBLE) + 2e-10, {digits}) END AS {c}"
        for c in doubles)
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6):
    """Register a query; ``doubles`` names the oracle's floating columns."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # billing time is UTC throughout
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finish(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded(sql, doubles, digits)
        return fn

    return add
