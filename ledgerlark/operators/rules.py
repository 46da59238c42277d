"""Deterministic rules over a bucketed series, as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import KEYS, RuleConfig
from ..functions.exprs import flag
from .series import series_window


def threshold_breach(x: Column, limit: float) -> tuple[Column, Column, Column]:
    """(fired, score, overshoot) of ``x`` above a fixed limit."""
    fired = x > F.lit(limit)
    over = F.lit(1.0) if limit == 0.0 else (x - F.lit(limit)) / F.lit(limit)
    score = F.when(fired, F.least(over, F.lit(1.0))).otherwise(F.lit(0.0))
    return flag(fired), score, over


def sudden_jump(x: Column, mean: Column, jump: float) -> tuple[Column, Column, Column]:
    """(fired, score, relative jump) of ``x`` against the mean of earlier rows."""
    pct = (x - mean) / F.when(mean != 0, mean)
    from_zero = (mean == 0) & (x > 0)
    fired = from_zero | ((mean != 0) & (pct > F.lit(jump)))
    scaled = F.lit(1.0) if jump == 0.0 else F.least((pct - F.lit(jump)) / F.lit(jump), F.lit(1.0))
    score = F.when(from_zero, F.lit(1.0)).when(fired, scaled).otherwise(F.lit(0.0))
    return flag(fired), score, pct


def apply_rules(df: DataFrame, cfg: RuleConfig = RuleConfig(), keys: Sequence[str] = KEYS,
                order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Fired flag and score of each rule and the blended ``rule_score``.

    Also keeps the numbers the explanations quote (``jump_mean`` and so on).
    One partitioning and sort serve every frame.
    """
    w = series_window(keys, order)
    x = F.col(cfg.target).cast("double")
    n = cfg.sustained_window
    base = df.withColumns({
        "jump_mean": F.avg(x).over(w.rowsBetween(-cfg.jump_lookback, -1)),
        "_prev": F.lag(x, 1).over(w),
        "sustained_seen": F.count(x).over(w.rowsBetween(-n, 0)),
    })
    prev = F.col("_prev")
    grew = F.when(prev == 0, x > 0).otherwise((x - prev) / F.abs(F.when(prev != 0, prev)) >= F.lit(cfg.sustained_min_growth))
    base = base.withColumn("_grew", flag(grew))
    passing = F.sum("_grew").over(w.rowsBetween(-(n - 1), 0)) if n > 0 else F.lit(0)
    base = base.withColumn("sustained_passing", passing)

    t_fired, t_score, t_over = threshold_breach(x, cfg.budget_limit)
    j_fired, j_score, j_pct = sudden_jump(x, F.col("jump_mean"), cfg.jump_pct)
    enough = F.col("sustained_seen") >= n + 1
    s_score = F.when(enough, F.col("sustained_passing") / F.lit(float(n))).otherwise(F.lit(0.0)) if n else F.lit(0.0)
    scored = base.withColumns({
        "threshold_over": t_over,
        "threshold_fired": t_fired,
        "threshold_score": t_score,
        "jump_pct": j_pct,
        "jump_fired": j_fired,
        "jump_score": j_score,
        "sustained_fired": flag(enough & (F.col("sustained_passing") == n)),
        "sustained_score": s_score,
    })
    return scored.withColumn(
        "rule_score",
        F.lit(cfg.weight_threshold) * F.col("threshold_score")
        + F.lit(cfg.weight_jump) * F.col("jump_score")
        + F.lit(cfg.weight_sustained) * F.col("sustained_score"),
    ).drop("_prev", "_grew")


RULE_COLUMNS = (
    "jump_mean", "sustained_seen", "sustained_passing", "threshold_over", "jump_pct",
    "threshold_fired", "threshold_score", "jump_fired", "jump_score", "sustained_fired", "sustained_score",
)
