"""KPI aggregates over anomalies, alerts, events and run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..config import KEYS, STATUSES
from ..functions.quantiles import exact_quantiles


def training_counts(events: DataFrame) -> DataFrame:
    """One row: generated, uploaded, total training rows."""
    gen = F.col("source_type") == "training_generated"
    upl = F.col("source_type") == "training_uploaded"
    return events.filter(gen | upl).agg(
        F.count_if(gen).alias("generated"), F.count_if(upl).alias("uploaded"), F.count(F.lit(1)).alias("total"))


def kpi_summary(anomalies: DataFrame, now: str) -> DataFrame:
    """Counts by status and severity and of the last 24 hours, in one pass."""
    since = F.lit(now).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    return anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES],
        *[F.count_if(F.col("severity") == s).alias(f"{s}_severity_count") for s in ("high", "medium", "low")],
        F.count_if(F.col("detected_at") >= since).alias("anomalies_last_24h"),
    )


def top_counts(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent values; equal counts are ordered by value."""
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(column).asc()).limit(n)
    )


def daily_trend(anomalies: DataFrame, now: str, days: int) -> DataFrame:
    """Count per day of the trailing ``days``, days without anomalies as zero."""
    today = F.to_date(F.lit(now).cast("timestamp"))
    start = F.date_sub(today, days - 1)
    counts = (
        anomalies.filter(F.col("detected_at") >= start.cast("timestamp"))
        .groupBy(F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    )
    spine = anomalies.sparkSession.range(1).select(
        F.explode(F.sequence(start, today)).alias("day")) if days >= 1 else None
    if spine is None:
        return counts.select("day", F.col("n").alias("count")).limit(0)
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def daily_average(anomalies: DataFrame, now: str, days: int = 30) -> DataFrame:
    trend = daily_trend(anomalies, now, days)
    return trend.agg(F.round(F.sum("count") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("daily_avg"))


def time_to_acknowledge(anomalies: DataFrame, now: str, newest: int = 200) -> DataFrame:
    """Median and p95 lag of the newest acknowledged anomalies, in seconds.

    Picks element ``max(0, int(n*p) - 1)`` of the ascending lags, no
    interpolation. At most ``newest`` rows reach the ranking.
    """
    ack = (
        anomalies.filter(F.col("status") == "acknowledged").select("detected_at", "anomaly_id")
        .orderBy(F.col("detected_at").desc(), "anomaly_id").limit(newest)
    )
    lag = F.abs(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("detected_at")) / 1e6
    one = ack.agg(F.array_sort(F.collect_list(lag)).alias("lags")).withColumn("n", F.size("lags"))

    def pick(p: float):
        index = F.greatest(F.floor(F.col("n") * F.lit(p)) - 1, F.lit(0)).cast("int")
        return F.round(F.when(F.col("n") > 0, F.get("lags", index)), 1)

    return one.select(pick(0.5).alias("mtt_ack_p50_seconds"), pick(0.95).alias("mtt_ack_p95_seconds"))


def detection_lag_p95(anomalies: DataFrame, events: DataFrame, now: str, days: int = 7) -> DataFrame:
    """p95 of detection minus ingestion time, in ms, over all recent events."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    recent = events.filter(F.col("ingested_at") > since).select(
        *KEYS, F.col("timestamp").alias("bucket"), "ingested_at")
    lag = (F.unix_micros("detected_at") - F.unix_micros("ingested_at")) / 1000.0
    lags = anomalies.select(*KEYS, "bucket", "detected_at").join(recent, [*KEYS, "bucket"]).select(
        F.greatest(F.lit(0.0), lag).alias("lag"))
    return exact_quantiles(lags, "lag", {"p": 0.95}).select(F.round("p", 1).alias("lag_p95_ms"))


def delivery_rates(alerts: DataFrame) -> DataFrame:
    """Sent and failed shares of delivered-or-failed alerts, in percent."""
    sent, failed = F.count_if(F.col("status") == "sent"), F.count_if(F.col("status") == "failed")
    one = alerts.agg(
        sent.alias("sent"), failed.alias("failed"), F.count_if(F.col("status") == "suppressed").alias("suppressed"))
    base = F.col("sent") + F.col("failed")

    def share(c: str):
        return F.round(F.col(c) / F.when(base > 0, base) * 100.0, 1)

    return one.withColumns({"success_rate": share("sent"), "fail_rate": share("failed")})


def dispatch_p95(alerts: DataFrame) -> DataFrame:
    """Element ``ceil(0.95 n)`` of the positive dispatch times, in seconds."""
    took = (F.unix_micros("sent_at") - F.unix_micros("created_at")) / 1e6
    df = alerts.select(took.alias("took")).filter(F.col("took") > 0)
    return exact_quantiles(df, "took", {"dispatch_p95_seconds": 0.95}, how="ceil")


def pending_count(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") == "pending").agg(F.count(F.lit(1)).alias("pending"))


# -- run metrics --------------------------------------------------------------------


def batch_metrics(scored: DataFrame, batch: str, batch_at: str) -> DataFrame:
    """Metrics rows of scored batches: rows and anomalies per batch id."""
    return scored.groupBy(F.col(batch).alias("batch_id"), F.col(batch_at).alias("batch_at")).agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies_detected"))


def run_totals(metrics: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Totals over all batches, values of the last batch, errors by component."""
    have = set(metrics.columns)

    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0)) if c in have else F.lit(0)

    out = metrics.agg(
        F.count(F.lit(1)).alias("batches_processed"),
        *[total(c).cast("long").alias(c)
          for c in ("rows_scored", "anomalies_detected", "anomalies_persisted", "events_emitted")],
        F.max("batch_at").alias("last_batch_at"),
        F.max_by("rows_scored", F.struct("batch_at", "batch_id")).alias("last_batch_rows"),
        F.max_by("anomalies_detected", F.struct("batch_at", "batch_id")).alias("last_batch_anomalies"),
        F.lit(1).alias("_one"),
    )
    if errors is None:
        return out.drop("_one")
    by = errors.agg(
        *[F.count_if(F.col("component") == c).alias(f"errors_{c}") for c in ("scoring", "persist", "emit")],
        F.lit(1).alias("_one"))
    return out.join(F.broadcast(by), "_one").drop("_one")


def windowed_rates(metrics: DataFrame, counters: Sequence[str], seconds: int = 300, by: Sequence[str] = (),
                   sum_col: str | None = None, count_col: str | None = None, chunk_seconds: int = 86_400) -> DataFrame:
    """Per-second increase over the trailing window and a sum/count average.

    ``metrics`` holds one row per recorded batch; ``by`` names the series. The
    time axis is cut into chunks; rows a later chunk still looks back on are
    copied into it, so no task holds a whole series.
    """
    if seconds > chunk_seconds:
        raise ValueError("chunk_seconds must be at least the window")
    at = F.unix_seconds("batch_at")
    chunk = F.floor(at / chunk_seconds)
    own = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_copy"))
    ahead = F.when(
        (chunk + 1) * chunk_seconds - at < seconds, F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_copy")))
    cut = metrics.select("*", F.explode(F.array_compact(F.array(own, ahead))).alias("_c")).select(metrics["*"], "_c.*")
    trailing = Window.partitionBy(*by, "_chunk").orderBy(at).rangeBetween(-(seconds - 1), 0)
    out = cut.withColumns({
        f"{c}_per_second": F.sum(c).over(trailing) / F.lit(float(seconds)) for c in counters})
    if sum_col and count_col:
        n = F.sum(count_col).over(trailing)
        out = out.withColumn(f"{sum_col}_avg", F.sum(sum_col).over(trailing) / F.when(n != 0, n))
    return out.filter(~F.col("_copy")).drop("_chunk", "_copy")
