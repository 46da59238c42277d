"""Spark side of the shared derived frames (see ``sql`` for the oracle side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import InjectionConfig, RuleConfig
from ..operators import baseline, evaluate, inject, scoring
from ..sources.adapters import NOW, billing, hourly, raw_records, select_text, table
from . import sql

RULES = RuleConfig(budget_limit=sql.BUDGET_LIMIT)


def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return select_text(hourly(spark, sf).filter(sql.ANOMALY_FILTER), sql.ANOMALY_COLUMNS)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = anomalies(spark, sf).withColumn("channel", F.explode(F.array(F.lit("in_app"), F.lit("email"))))
    return select_text(pairs, sql.ALERT_COLUMNS)


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return select_text(table(spark, sf, "events"), sql.AUDIT_COLUMNS)


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Billing events with their ingestion time."""
    delay = F.make_dt_interval(secs=F.col("seq") * 7919 % 600)
    return billing(spark, sf).withColumn("ingested_at", F.col("timestamp") + delay)


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.fit_profile(hourly(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_series(hourly(spark, sf), profile(spark, sf), rules=RULES)


def rule_scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_series(hourly(spark, sf), rules=RULES)


INJECTION = InjectionConfig(
    seed="backtest", spike_count=6, spike_multiplier=5.0, drift_start=240, drift_slope=0.02,
    shift_start=250, shift_amount=40.0, budget_start=100, budget_duration=6, budget_multiplier=3.0)


def injected(spark: SparkSession, sf: str) -> DataFrame:
    df = inject.inject(hourly(spark, sf), INJECTION)
    return df.withColumn("row_id", F.md5(F.concat_ws("|", "account_id", "service", "region", F.col("bucket").cast("string"))))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Injected series with the per-account z-score as anomaly score."""
    return evaluate.zscore_score(injected(spark, sf))


def labelled_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Injected series scored by the ensemble, the z-score as its detector.

    ``is_anomaly`` is the true label, ``flagged`` the ensemble's decision.
    """
    base = injected(spark, sf).withColumnRenamed("is_anomaly", "_label")

    def detector(df: DataFrame) -> DataFrame:
        return evaluate.zscore_score(df, out="if_score").withColumn("if_anomaly", F.lit(0))

    out = scoring.score_series(base, profile(spark, sf), detector, rules=RULES)
    return out.withColumn("flagged", F.col("is_anomaly")).withColumn("is_anomaly", F.col("_label")).drop("_label").withColumns({
        c: F.round(F.col(c), 6) for c in ("ts_signal", "if_score", "rule_score", "anomaly_score")})


__all__ = ["NOW", "hourly", "raw_records"]
