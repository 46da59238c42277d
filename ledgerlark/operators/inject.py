"""Backtest injection: labelled anomalies put into an existing series.

Positions are 0-based per series. The draw of spike rows is a hash of the row,
so a run can be repeated on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import KEYS, InjectionConfig
from ..functions.exprs import join_on
from .series import place, segment_counts, tag_segments

# Later kinds overwrite earlier ones, in the labels and in the order applied.
KINDS = ("spike", "drift", "level_shift", "budget_breach")


def add_positions(df: DataFrame, seed: str, spikes: int | None, keys: Sequence[str] = KEYS, order: str = "bucket",
                  target: str = "total_cost", budget: float | None = None) -> DataFrame:
    """``pos`` (0-based time order), ``series_rows``, ``_budget``, ``drawn`` (spike row).

    One table of counted time segments gives positions, series lengths and the
    mean cost, which is the budget unless one is given. The drawn rows come from
    a per-series top-k that Spark limits before the shuffle. So a long series is
    never gathered in one task, and the input is read three times at most.
    """
    keys = list(keys)
    tagged = tag_segments(df, order)
    cost = F.col(target).cast("double")
    counts = segment_counts(tagged, keys, _sum=cost, _known=cost.isNotNull().cast("long"))
    out = place(tagged, counts, "pos", keys, (order,)).withColumnRenamed("_total", "series_rows")
    if budget is None:
        mean = counts.agg((F.sum("_sum") / F.nullif(F.sum("_known"), F.lit(0))).alias("_budget"), F.lit(1).alias("_one"))
        out = out.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one").drop("_one")
    else:
        out = out.withColumn("_budget", F.lit(float(budget)))
    if not spikes or spikes < 0:
        return out.withColumn("drawn", F.lit(False))
    row_hash = F.md5(F.concat_ws("|", F.lit(seed), *keys, F.col(order).cast("string")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    drawn = (
        df.select(*keys, order, row_hash.alias("_hash")).withColumn("_rank", rank).filter(F.col("_rank") <= spikes)
        .select(*keys, order, F.lit(True).alias("drawn"))
    )
    return join_on(out, drawn, [*keys, order], "left").withColumn("drawn", F.coalesce("drawn", F.lit(False)))


def spike(x: Column, cfg: InjectionConfig) -> tuple[Column, Column]:
    if not cfg.spike_count or cfg.spike_count < 0:
        return x, F.lit(False)
    hit = F.col("drawn")
    return F.when(hit, x * F.lit(cfg.spike_multiplier)).otherwise(x), hit


def drift(x: Column, cfg: InjectionConfig) -> tuple[Column, Column]:
    if cfg.drift_start is None:
        return x, F.lit(False)
    start = max(0, cfg.drift_start)
    hit = F.col("pos") >= start
    factor = F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(cfg.drift_slope) * (F.col("pos") - start))
    return F.when(hit, x * factor).otherwise(x), hit


def level_shift(x: Column, cfg: InjectionConfig) -> tuple[Column, Column]:
    if cfg.shift_start is None:
        return x, F.lit(False)
    hit = F.col("pos") >= max(0, cfg.shift_start)
    return F.when(hit, x + F.lit(cfg.shift_amount)).otherwise(x), hit


def budget_breach(x: Column, cfg: InjectionConfig, budget: Column) -> tuple[Column, Column]:
    if cfg.budget_start is None:
        return x, F.lit(False)
    start = F.least(F.lit(max(0, cfg.budget_start)), F.col("series_rows") - 1)
    hit = (F.col("pos") >= start) & (F.col("pos") < start + max(cfg.budget_duration, 1))
    level = F.greatest(F.lit(0.0), budget * F.lit(cfg.budget_multiplier))
    return F.when(hit, F.greatest(x, level)).otherwise(x), hit


def label(hits: dict[str, Column]) -> Column:
    """Type of a row: the last kind in the fixed order that hit it."""
    out = F.lit("normal")
    for kind in KINDS:
        if kind in hits:
            out = F.when(hits[kind], F.lit(kind)).otherwise(out)
    return out


def inject(df: DataFrame, cfg: InjectionConfig, target: str = "total_cost", keys: Sequence[str] = KEYS,
           order: str = "bucket") -> DataFrame:
    """Apply the enabled injectors and add ``is_anomaly, anomaly_type``.

    Costs end non-negative at six decimals. The default budget is the mean cost
    of all rows before injection.
    """
    # without a budget kind nothing reads the mean
    budget = 1000.0 if cfg.budget is None and cfg.budget_start is None else cfg.budget
    base = add_positions(df, cfg.seed, cfg.spike_count, keys, order, target, budget)
    hits = {}
    x, hits["spike"] = spike(F.col(target), cfg)
    base = base.withColumn("_x", x)
    x, hits["drift"] = drift(F.col("_x"), cfg)
    base = base.withColumn("_x", x)
    x, hits["level_shift"] = level_shift(F.col("_x"), cfg)
    base = base.withColumn("_x", x)
    x, hits["budget_breach"] = budget_breach(F.col("_x"), cfg, F.col("_budget"))
    base = base.withColumns({"_x": x, "anomaly_type": label(hits)})
    return base.withColumns({
        target: F.round(F.greatest(F.col("_x"), F.lit(0.0)), 6),
        "is_anomaly": F.when(F.col("anomaly_type") == "normal", F.lit(0)).otherwise(F.lit(1)),
    }).drop("_x", "_budget", "drawn", "series_rows")
