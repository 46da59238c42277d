"""Signal fusion, decision and severity; the scoring chain over a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import KEYS, BaselineConfig, ReclassifyConfig, ResidualConfig, RuleConfig, ScoringConfig, SeverityConfig
from ..functions.exprs import flag, nan_to_null
from .baseline import ewma_memory, forecast, residuals
from .rules import apply_rules
from .series import SplitConfig, over_series


def ts_signal(abs_z: Column, cap: float = 10.0) -> Column:
    """Capped deviation scaled to [0, 1]; NULL when there is no forecast."""
    cap = max(cap, 1e-9)
    return F.when(abs_z.isNotNull(), F.least(abs_z, F.lit(cap)) / F.lit(cap))


def active_weight(signal: Column, weight: float) -> Column:
    """Configured weight when the signal is present, else zero."""
    return F.when(signal.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))


def fuse(df: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Weighted mean over the signals that are present and enabled."""
    used = {c: w for c, w in cfg.weights().items() if w > 0.0 and c in df.columns}
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in used.items():
        s = nan_to_null(F.col(name).cast("double"))
        total = total + F.coalesce(F.lit(w) * s, F.lit(0.0))
        weight = weight + active_weight(s, w)
    out = df.withColumns({"_total": total, "_weight": weight})
    out = out.withColumn(
        "anomaly_score",
        F.when(F.col("_weight") > 0, F.col("_total") / F.col("_weight")).otherwise(F.lit(0.0)))
    return out.withColumn("is_anomaly", flag(F.col("anomaly_score") >= F.lit(cfg.threshold))).drop("_total", "_weight")


def severity_of(score: Column, anomalous: Column, cfg: SeverityConfig = SeverityConfig()) -> Column:
    return (
        F.when(anomalous == 0, F.lit("none"))
        .when(score >= F.lit(cfg.high), F.lit("high"))
        .when(score >= F.lit(cfg.medium), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def add_severity(df: DataFrame, cfg: SeverityConfig = SeverityConfig()) -> DataFrame:
    """``severity`` from the score; uses ``is_anomaly`` when the frame has it."""
    if "anomaly_score" not in df.columns:
        raise ValueError("anomaly_score is missing")
    score = F.col("anomaly_score")
    anomalous = F.col("is_anomaly") if "is_anomaly" in df.columns else flag(score >= F.lit(cfg.threshold))
    return df.withColumn("severity", severity_of(score, anomalous, cfg))


def reclassify(anomalies: DataFrame, cfg: ReclassifyConfig = ReclassifyConfig()) -> DataFrame:
    """Severity of stored anomalies by new thresholds; never ``none``."""
    score = F.col("anomaly_score")
    return anomalies.withColumn(
        "severity",
        F.when(score >= F.lit(cfg.high), F.lit("high"))
        .when(score >= F.lit(cfg.medium), F.lit("medium"))
        .otherwise(F.lit("low")),
    )


def score_series(
    buckets: DataFrame,
    profile: DataFrame | None = None,
    detector=None,
    rules: RuleConfig = RuleConfig(),
    scoring: ScoringConfig = ScoringConfig(),
    severity: SeverityConfig | None = SeverityConfig(),
    baseline: BaselineConfig = BaselineConfig(),
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("bucket",),
    split: SplitConfig | None = None,
) -> DataFrame:
    """Score every bucket of every series.

    ``detector`` is a callable adding ``if_score`` and ``if_anomaly`` (see
    ``detectors``). A missing or disabled component leaves its signal NULL and
    the weights of the others are renormalised. Forecast, residual and rule
    columns are kept for the explanations.
    """

    def windows(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        if scoring.enable_ts and profile is not None:
            frame = forecast(frame, profile, baseline, part, order)
        return apply_rules(frame, rules, part, order) if scoring.enable_rules else frame

    before = max(ewma_memory(baseline.alpha), rules.jump_lookback, rules.sustained_window + 1)
    df = over_series(buckets, windows, before=before, keys=keys, order=order, split=split)

    if scoring.enable_ts and profile is not None:
        levels = tuple(round(level * 100) for level in baseline.levels)
        df = residuals(df, ResidualConfig(rules.target, levels, scoring.z_cap))
        df = df.withColumn("ts_signal", ts_signal(F.col("abs_z_score"), scoring.z_cap))
    else:
        df = df.withColumn("ts_signal", F.lit(None).cast("double"))
    if scoring.enable_if and detector is not None:
        df = detector(df)
    else:
        df = df.withColumns({"if_score": F.lit(None).cast("double"), "if_anomaly": F.lit(0)})
    if not scoring.enable_rules:
        df = df.withColumn("rule_score", F.lit(0.0))
    df = fuse(df, scoring)
    return add_severity(df, severity) if severity else df
