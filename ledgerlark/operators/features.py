"""Rolling, growth, volatility and calendar features of a bucketed series.

Frames count rows, not time: missing buckets are not filled. Every function
keeps its input columns and partitions by ``keys``; all windows of one call
share one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import DataFrame, functions as F

from ..config import KEYS, CalendarConfig, GrowthConfig, RollingConfig, VolatilityConfig
from ..functions.exprs import clip, flag, nonzero_std, safe_div
from ..functions.quantiles import sorted_quantile
from .series import SplitConfig, over_series, series_window

_AGGS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def _with(df: DataFrame, cols: dict) -> DataFrame:
    return df.withColumns(cols) if cols else df


def rolling_features(df: DataFrame, cfg: RollingConfig = RollingConfig(), keys: Sequence[str] = KEYS,
                     order: Sequence[str] = ("bucket",)) -> DataFrame:
    """``{target}_roll{w}_{agg}`` and ``{target}_roll{w}_zscore``."""
    w = series_window(keys, order)
    x = F.col(cfg.target).cast("double")
    rolled = _with(df, {
        f"{cfg.target}_roll{n}_{a}": _AGGS[a](x).over(w.rowsBetween(-(n - 1), 0))
        for n in cfg.windows for a in cfg.aggs
    })
    if not {"mean", "std"} <= set(cfg.aggs):
        return rolled
    z = {}
    for n in cfg.windows:
        mean, std = F.col(f"{cfg.target}_roll{n}_mean"), F.col(f"{cfg.target}_roll{n}_std")
        z[f"{cfg.target}_roll{n}_zscore"] = (x - mean) / nonzero_std(std, mean)
    return _with(rolled, z)


def last_values(df: DataFrame, n: int, target: str = "total_cost", keys: Sequence[str] = KEYS,
                order: Sequence[str] = ("bucket",)) -> DataFrame:
    """``{target}_last{n}``: the current and the ``n - 1`` preceding values, oldest first."""
    w = series_window(keys, order).rowsBetween(-(n - 1), 0)
    return df.withColumn(f"{target}_last{n}", F.collect_list(F.col(target).cast("double")).over(w))


def growth_features(df: DataFrame, cfg: GrowthConfig = GrowthConfig(), keys: Sequence[str] = KEYS,
                    order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Percent change, log return, annualised growth, acceleration."""
    w = series_window(keys, order)
    t = cfg.target
    x = F.col(t).cast("double")
    shifts = sorted({1, *cfg.lags, *cfg.windows})
    shifted = df.withColumns({f"_lag{n}": F.lag(x, n).over(w) for n in shifts})

    def pct(n: int):
        prev = F.col(f"_lag{n}")
        return clip(safe_div(x - prev, F.abs(prev)), -cfg.pct_cap, cfg.pct_cap)

    def ratio(n: int):
        prev = F.col(f"_lag{n}")
        floored = F.greatest(x, F.lit(cfg.floor)) / F.greatest(prev, F.lit(cfg.floor))
        return F.when(prev.isNotNull() & x.isNotNull(), floored)

    cols = {}
    for n in cfg.lags:
        cols[f"{t}_pct_change_{n}"] = pct(n)
        cols[f"{t}_log_return_{n}"] = F.ln(ratio(n))
    for n in cfg.windows:
        grown = F.pow(ratio(n), F.lit(cfg.periods_per_year / n)) - 1.0
        cols[f"{t}_cagr_{n}"] = clip(grown, -cfg.annual_cap, cfg.annual_cap)
    # A stand-alone acceleration (lag 1 not requested) differences the raw change.
    step = pct(1) if 1 in cfg.lags else safe_div(x - F.col("_lag1"), F.abs(F.col("_lag1")))
    out = shifted.withColumns({**cols, "_step": step})
    out = out.withColumn(f"{t}_accel", F.col("_step") - F.lag("_step", 1).over(w))
    return out.drop("_step", *[f"_lag{n}" for n in shifts])


def volatility_features(df: DataFrame, cfg: VolatilityConfig = VolatilityConfig(), keys: Sequence[str] = KEYS,
                        order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Variation coefficient, range, IQR, band width, historical volatility.

    Reuses rolling and log-return columns when the frame already has them.
    """
    t = cfg.target
    x = F.col(t).cast("double")
    w = series_window(keys, order)
    have = set(df.columns)
    tmp: list[str] = []

    if f"{t}_log_return_1" in have:
        ret, out = F.col(f"{t}_log_return_1"), df
    else:
        prev = F.lag(x, 1).over(w)
        out = df.withColumn("_ret", F.when(
            prev.isNotNull(), F.ln(F.greatest(x, F.lit(1e-9)) / F.greatest(prev, F.lit(1e-9)))))
        ret = F.col("_ret")
        tmp.append("_ret")

    stage: dict = {}
    for n in cfg.windows:
        f = w.rowsBetween(-(n - 1), 0)
        stage[f"_n{n}"] = F.count(x).over(f)
        stage[f"_nr{n}"] = F.count(ret).over(f)
        stage[f"_sr{n}"] = F.stddev_samp(ret).over(f)
        # a bounded frame is cheaper to collect and sort than to re-aggregate
        stage[f"_q{n}"] = F.collect_list(x).over(f)
        for agg in ("mean", "std", "min", "max"):
            if f"{t}_roll{n}_{agg}" not in have:
                stage[f"_{agg}{n}"] = _AGGS[agg](x).over(f)
    out = out.withColumns(stage).withColumns({f"_q{n}": F.sort_array(f"_q{n}") for n in cfg.windows})
    tmp += list(stage)

    cols = {}
    for n in cfg.windows:
        def rolled(agg: str):
            name = f"{t}_roll{n}_{agg}"
            return F.col(name) if name in have else F.col(f"_{agg}{n}")

        enough = F.col(f"_n{n}") >= cfg.min_periods
        mean = F.when(rolled("mean") != 0, rolled("mean"))
        # A noise-sized deviation of a constant window counts as zero.
        std = F.when(rolled("std").isNotNull(),
                     F.coalesce(nonzero_std(rolled("std"), rolled("mean")), F.lit(0.0)))
        reuse_range = {f"{t}_roll{n}_max", f"{t}_roll{n}_min"} <= have
        reuse_band = {f"{t}_roll{n}_mean", f"{t}_roll{n}_std"} <= have
        spread = rolled("max") - rolled("min")
        cols[f"{t}_cv_{n}"] = F.when(enough, std / mean)
        cols[f"{t}_range_{n}"] = spread if reuse_range else F.when(enough, spread)
        cols[f"{t}_iqr_{n}"] = F.when(
            enough, sorted_quantile(F.col(f"_q{n}"), 0.75) - sorted_quantile(F.col(f"_q{n}"), 0.25))
        band = (F.lit(4.0) * std) / mean
        cols[f"{t}_bb_width_{n}"] = band if reuse_band else F.when(enough, band)
        cols[f"{t}_hist_vol_{n}"] = F.when(
            F.col(f"_nr{n}") >= cfg.min_periods,
            F.col(f"_sr{n}") * F.lit(sqrt(cfg.periods_per_year / n)))
    return out.withColumns(cols).drop(*tmp)


def calendar_features(df: DataFrame, cfg: CalendarConfig = CalendarConfig()) -> DataFrame:
    """Hour, weekday (0 = Monday), day, month, flags and cyclic encodings."""
    b = F.col(cfg.bucket)
    local = b if cfg.tz == "UTC" else F.from_utc_timestamp(b, cfg.tz)
    hour, dow = F.hour(local), F.weekday(local)
    out = df.withColumns({
        "hour_of_day": hour,
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(local),
        "month": F.month(local),
    })
    hour, dow = F.col("hour_of_day"), F.col("day_of_week")
    return out.withColumns({
        "is_weekend": flag(dow >= 5),
        "is_business_hour": flag((dow < 5) & (hour >= cfg.business_start) & (hour < cfg.business_end)),
        "hour_sin": F.sin(hour * F.lit(2 * pi / 24)),
        "hour_cos": F.cos(hour * F.lit(2 * pi / 24)),
        "dow_sin": F.sin(dow * F.lit(2 * pi / 7)),
        "dow_cos": F.cos(dow * F.lit(2 * pi / 7)),
    })


def rolling_mad(
    df: DataFrame,
    target: str = "cost_amount",
    window: int = 7,
    threshold: float = 3.0,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("timestamp", "event_id"),
    split: SplitConfig | None = SplitConfig(),
) -> DataFrame:
    """Centred rolling median and MAD detector over raw events, per series.

    Raw events have no calendar bound per key, so series are cut by default.
    """
    back = window // 2
    ahead = window - back - 1

    def apply(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        f = series_window(part, order).rowsBetween(-back, ahead)
        x = F.col(target).cast("double")

        def centred_median(df: DataFrame, source, name: str) -> DataFrame:
            """Median of a full window, else NULL."""
            df = df.withColumn("_sorted", F.collect_list(source).over(f)).withColumn("_sorted", F.sort_array("_sorted"))
            return df.withColumn(name, F.when(
                F.size("_sorted") == window, sorted_quantile(F.col("_sorted"), 0.5))).drop("_sorted")

        out = centred_median(frame, x, "median")
        out = out.withColumn("deviation", F.abs(x - F.col("median")))
        out = centred_median(out, F.col("deviation"), "mad")
        return out.withColumn("is_anomaly", flag(F.col("deviation") > F.lit(threshold) * F.col("mad")))

    return over_series(df, apply, before=2 * back, after=2 * ahead, keys=keys, order=order, split=split)
