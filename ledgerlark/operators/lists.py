"""Filtered, sorted and paged lists, with totals computed separately."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import TRAINING_SOURCES


def filter_equal(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Equality filters; a ``None`` value means "not filtered"."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def filter_range(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Inclusive time range."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp"))
    return df


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int, max_size: int = 200) -> DataFrame:
    """One page. Sort, offset and limit plan as a bounded top-k, not a full sort."""
    if page < 1 or not 1 <= size <= max_size:
        raise ValueError(f"page must be >= 1 and size in 1..{max_size}")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def totals(df: DataFrame, size: int, at_least: int = 0) -> DataFrame:
    """``total, pages`` of a filtered list."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.ceil(F.col("total") / F.lit(size)), F.lit(at_least)).cast("long"))


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def anomaly_order(sort: str = "detected_at", order: str = "desc") -> list[Column]:
    """Whitelisted sort column with the id as tie-break."""
    keys = {
        "detected_at": F.col("detected_at"),
        "bucket": F.col("bucket"),
        "anomaly_score": F.col("anomaly_score"),
        "severity": severity_rank(F.col("severity")),
    }
    key = keys.get(sort, keys["detected_at"])
    return [key.asc() if order == "asc" else key.desc(), F.col("anomaly_id").asc()]


def filter_anomalies(df: DataFrame, from_bucket: str | None = None, to_bucket: str | None = None, **equal) -> DataFrame:
    return filter_range(filter_equal(df, equal), "bucket", from_bucket, to_bucket)


def list_anomalies(df: DataFrame, sort: str = "detected_at", order: str = "desc", page: int = 1, size: int = 50,
                   **filters) -> DataFrame:
    return page_of(filter_anomalies(df, **filters), anomaly_order(sort, order), page, size)


def list_alerts(df: DataFrame, page: int = 1, size: int = 50, **equal) -> DataFrame:
    return page_of(filter_equal(df, equal), [F.col("created_at").desc(), F.col("alert_id").asc()], page, size)


def search_alerts(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over the identifying fields; blank matches all."""
    needle = text.strip().lower()
    if not needle:
        return df
    hay = F.lower(F.concat_ws(" ", "account_id", "service", "region", "dedup_key"))
    return df.filter(F.contains(hay, F.lit(needle)))


def list_audit(df: DataFrame, page: int = 1, size: int = 50, from_time: str | None = None,
               to_time: str | None = None, **equal) -> DataFrame:
    df = filter_range(filter_equal(df, equal), "created_at", from_time, to_time)
    return page_of(df, [F.col("created_at").desc(), F.col("audit_id").asc()], page, size)


def training_rows(events: DataFrame, source: str = "all") -> DataFrame:
    wanted = [k for k, v in TRAINING_SOURCES.items() if source not in TRAINING_SOURCES.values() or v == source]
    return events.filter(F.col("source_type").isin(*wanted))


def list_training(events: DataFrame, source: str = "all", page: int = 1, size: int = 50) -> DataFrame:
    rows = page_of(training_rows(events, source), [F.col("timestamp").desc(), F.col("event_id").asc()],
                   max(page, 1), size)
    return rows.select(
        "event_id", "timestamp", "provider", "account_id", "service", "region",
        F.round("cost_amount", 4).alias("cost_amount"), F.round("usage_amount", 4).alias("usage_amount"), "usage_unit",
        F.when(F.col("source_type") == "training_generated", F.lit("generated")).otherwise(F.lit("uploaded")).alias("source"))


def failed_alerts(df: DataFrame, limit: int = 50) -> DataFrame:
    return (
        df.filter(F.col("status") == "failed")
        .orderBy(F.col("created_at").desc(), F.col("alert_id").asc()).limit(limit)
        .select("alert_id", "anomaly_id", "channel", "severity", "created_at", "error_detail")
    )
