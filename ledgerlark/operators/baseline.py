"""Seasonal baseline: profile fit, forecast, residuals, retraining.

The profile is a table of 24 x 7 slots plus one pooled row per model version,
so broadcasting it is bounded whatever the training volume.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import KEYS, BaselineConfig, ResidualConfig
from ..functions.exprs import clip, flag, join_on
from .features import calendar_features
from .series import bucket_rollup, series_window

# hour_of_day and day_of_week of the row that holds the pooled statistics
GLOBAL_SLOT = -1


def _ensure_calendar(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    if {"hour_of_day", "day_of_week"} <= set(df.columns):
        return df
    return df.withColumns({"hour_of_day": F.hour(bucket), "day_of_week": F.weekday(bucket)})


def fit_profile(df: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Mean, sample std and count per (hour, weekday), pooled over series.

    Returns ``hour_of_day, day_of_week, mean, std, n``: always all 168 slots
    (an unseen one has ``n = 0`` and the pooled statistics) and the pooled row
    at slot (-1, -1). One shuffle of at most 168 rows per map task; the rest
    works on a single row holding those slots. :func:`require_rows` refuses a
    fit on too few rows.
    """
    slots = (
        _ensure_calendar(df)
        .select("hour_of_day", "day_of_week", F.col(cfg.target).cast("double").alias("_x"))
        .groupBy((F.col("hour_of_day") + F.col("day_of_week") * 24).alias("slot"))
        .agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.count("_x").alias("n"))
    )

    def usable(std: Column, mean: Column) -> Column:
        """Zero (or noise around zero) becomes the smallest allowed std."""
        return F.when(std > F.abs(mean) * F.lit(1e-12), std).otherwise(F.lit(cfg.min_std))

    def total(term) -> Column:
        return F.aggregate("_slots", F.lit(0.0), lambda acc, s: acc + term(s))

    seen = slots.filter(F.col("n") > 0)
    one = seen.agg(F.collect_list(F.struct("slot", "mean", "std", "n")).alias("_slots"), F.sum("n").alias("_n"))
    one = one.filter(F.col("_n") > 0).withColumn("_gm", total(lambda s: s["n"] * s["mean"]) / F.col("_n"))
    spread = total(lambda s: (s["n"] - 1) * F.coalesce(s["std"], F.lit(0.0)) * F.coalesce(s["std"], F.lit(0.0))
                   + s["n"] * (s["mean"] - F.col("_gm")) * (s["mean"] - F.col("_gm")))
    one = one.withColumn("_gs", F.when(F.col("_n") > 1, F.sqrt(spread / F.when(F.col("_n") > 1, F.col("_n") - 1))))
    one = one.withColumn("_gs", usable(F.coalesce("_gs", F.lit(0.0)), F.col("_gm")))
    one = one.withColumn("_by", F.map_from_entries(F.transform("_slots", lambda s: F.struct(s["slot"], s))))
    rows = one.select("_gm", "_gs", "_n", F.explode(F.sequence(F.lit(-1), F.lit(167))).alias("_slot"), "_by")
    hit = F.try_element_at("_by", F.col("_slot"))
    pooled = F.col("_slot") < 0
    return rows.select(
        F.when(pooled, F.lit(GLOBAL_SLOT)).otherwise(F.col("_slot") % 24).cast("int").alias("hour_of_day"),
        F.when(pooled, F.lit(GLOBAL_SLOT)).otherwise(F.floor(F.col("_slot") / 24)).cast("int").alias("day_of_week"),
        F.coalesce(hit["mean"], F.col("_gm")).alias("mean"),
        F.when(hit["n"] >= 2, usable(hit["std"], hit["mean"])).otherwise(F.col("_gs")).alias("std"),
        F.when(pooled, F.col("_n")).otherwise(F.coalesce(hit["n"], F.lit(0))).cast("long").alias("n"),
    )


def require_rows(profile: DataFrame, minimum: int) -> int:
    """Training row count of a fitted profile; raises below ``minimum``."""
    row = profile.filter(F.col("hour_of_day") == GLOBAL_SLOT).select("n").first()
    rows = int(row["n"]) if row else 0
    if rows < minimum:
        raise ValueError(f"training set has {rows} rows, need at least {minimum}")
    return rows


def ewma(df: DataFrame, target: str, alpha: float, out: str = "ewma", keys: Sequence[str] = KEYS,
         order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Exponentially weighted mean including the current row, per series.

    The first value of a series has full weight, later ones ``alpha``. A NULL
    adds nothing and repeats the mean, but the memory fades over its row too:
    after g rows the old mean has weight ``(1 - alpha)^g`` against ``alpha``.
    Each row is a step ``old -> fade * old + add``, a NULL one that changes
    nothing; steps are joined over 1, 2, 4, ... rows until the dropped weight is
    below 1e-16, so the cost per row is logarithmic in the memory length, and one
    sort of a series serves it all.
    """
    w = series_window(keys, order)
    x = F.col(target).cast("double")
    keep = 1.0 - alpha
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # rows since the last known value; a series' first known value has none
    cur = df.withColumn("_at", F.row_number().over(w))
    cur = cur.withColumn("_gap", F.col("_at") - F.last(F.when(x.isNotNull(), F.col("_at")), ignorenulls=True).over(before))
    old = F.pow(F.lit(keep), F.col("_gap"))
    # a NULL is the step that changes nothing, what is unknown before the first value counts as zero
    cur = cur.withColumn("_fade", F.when(x.isNull(), F.lit(1.0)).when(F.col("_gap").isNull(), F.lit(0.0)).otherwise(old / (old + F.lit(alpha))))
    cur = cur.withColumn("_add", F.when(x.isNull(), F.lit(0.0)).otherwise((F.lit(1.0) - F.col("_fade")) * x))
    span = 1
    while _slowest(alpha) ** span > 1e-16:
        cur = cur.withColumns({
            "_add": F.col("_add") + F.col("_fade") * F.coalesce(F.lag("_add", span).over(w), F.lit(0.0)),
            "_fade": F.col("_fade") * F.coalesce(F.lag("_fade", span).over(w), F.lit(0.0))})
        span *= 2
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return cur.withColumn(out, F.last(F.when(x.isNotNull(), F.col("_add")), ignorenulls=True).over(upto)).drop("_at", "_gap", "_fade", "_add")


def _slowest(alpha: float) -> float:
    """The most that a row leaves of the old mean, whatever NULLs stand between the known values."""
    keep = 1.0 - alpha
    return max((keep ** g / (keep ** g + alpha)) ** (1.0 / g) for g in range(1, 65))


def ewma_memory(alpha: float) -> int:
    """Rows of known history that matter to :func:`ewma` (the halo when series are cut).

    Beyond them lies a weight below 1e-16, or below 1e-11 where most rows are NULL.
    """
    span, keep = 1, 1.0 - alpha
    while keep > 0 and keep ** span > 1e-16:
        span *= 2
    return span - 1


def forecast(df: DataFrame, profile: DataFrame, cfg: BaselineConfig = BaselineConfig(),
             keys: Sequence[str] = KEYS, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Add ``forecast_mean, forecast_std`` and one ``ci_lower/upper`` pair per level."""
    work = ewma(_ensure_calendar(df), cfg.target, cfg.alpha, "_ewma", keys, order)
    slots = profile.select("hour_of_day", "day_of_week", F.col("mean").alias("_sm"), F.col("std").alias("_ss"))
    work = work.join(F.broadcast(slots), ["hour_of_day", "day_of_week"], "left")
    sw = cfg.seasonal_weight
    out = work.withColumns({
        "forecast_mean": F.lit(sw) * F.col("_sm") + F.lit(1.0 - sw) * F.col("_ewma"),
        "forecast_std": F.greatest(
            F.col("_ss") * F.lit(sw + (1.0 - sw) * cfg.alpha), F.lit(cfg.min_std)),
    })
    bands = {}
    for level in cfg.levels:
        z = NormalDist().inv_cdf((1.0 + level) / 2.0)
        pct = round(level * 100)
        half = F.lit(z) * F.col("forecast_std")
        low = F.col("forecast_mean") - half
        bands[f"ci_lower_{pct}"] = F.when(low.isNotNull(), F.greatest(low, F.lit(0.0)))
        bands[f"ci_upper_{pct}"] = F.col("forecast_mean") + half
    # keep the caller's column order; the calendar columns stay when added here
    extra = [c for c in ("hour_of_day", "day_of_week") if c not in df.columns]
    added = [c for c in ("forecast_mean", "forecast_std", *bands) if c not in df.columns]
    return out.withColumns(bands).select(*df.columns, *extra, *added)


def merge_forecast(actuals: DataFrame, predicted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach forecast columns by key, NULL matching NULL; columns the actuals already have win."""
    new = [c for c in predicted.columns if c not in actuals.columns]
    return join_on(actuals, predicted.select(*on, *new), list(on), "left")


def residuals(df: DataFrame, cfg: ResidualConfig = ResidualConfig()) -> DataFrame:
    """``residual, abs_residual, z_score, abs_z_score, is_outside_ci_{level}``."""
    needed = {cfg.target, "forecast_mean", "forecast_std"}
    needed |= {f"ci_{side}_{p}" for p in cfg.levels for side in ("lower", "upper")}
    missing = needed - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    x = F.col(cfg.target).cast("double")
    std = F.when(F.col("forecast_std").isNotNull(), F.greatest(F.col("forecast_std"), F.lit(cfg.min_std)))
    out = df.withColumn("residual", x - F.col("forecast_mean"))
    z = F.col("residual") / std
    if cfg.z_cap is not None:
        z = clip(z, -abs(cfg.z_cap), abs(cfg.z_cap))
    out = out.withColumn("z_score", z)
    cols = {"abs_residual": F.abs("residual"), "abs_z_score": F.abs("z_score")}
    for p in cfg.levels:
        cols[f"is_outside_ci_{p}"] = flag((x < F.col(f"ci_lower_{p}")) | (x > F.col(f"ci_upper_{p}")))
    return out.withColumns(cols)


def lookback(df: DataFrame, now: datetime | str, days: int, column: str = "timestamp") -> DataFrame:
    """Rows at or after ``now - days``; a plain comparison, so it reaches the scan."""
    cutoff = F.lit(str(now)).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col(column) >= cutoff)


def retrain(events: DataFrame, now: datetime | str, days: int = 30, unit: str = "hour",
            cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Look back, roll up, add calendar fields, fit. Lazy; see ``require_rows``."""
    buckets = bucket_rollup(lookback(events, now, days), unit)
    return fit_profile(calendar_features(buckets), cfg)
