"""Queries over bucketed series: features, models, rules, scoring, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ForestConfig, GrowthConfig, ResidualConfig, RollingConfig, VolatilityConfig
from ..operators import baseline, detectors, explain, features, rules, scoring, series
from ..session import scratch_path
from ..sources import models, tables
from ..sources.adapters import NOW, billing, daily, hourly
from . import frames
from .detector_sql import COMPONENTS, FEATURES
from .registry import query
from .sql import BUDGET_LIMIT, K, NOW_SQL, PART, with_

KB = ["account_id", "service", "region", "bucket"]
KBS = f"{K}, bucket"
WINDOWS = (5, 15, 60)


def _frame(n: int) -> str:
    return f"({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# -- rolling -----------------------------------------------------------------------------

_ROLL_NAMES = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def _rolling_sql(src: str) -> tuple[str, list[str]]:
    cols = {f"total_cost_roll{n}_{a}": f"{fn}(total_cost) OVER {_frame(n)}" for n in WINDOWS for a, fn in _ROLL_NAMES.items()}
    return f"SELECT {KBS}, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {src}", list(cols)


_sql, _cols = _rolling_sql("hourly")


@query("f1_rolling", with_(_sql, "hourly"), _cols)
def _(spark, sf, cols=tuple(_cols)):
    return features.rolling_features(hourly(spark, sf)).select(*KB, *cols)


_sql, _dcols = _rolling_sql("daily")


@query("f1_rolling_daily", with_(_sql, "daily"), _dcols, digits=3)
def _(spark, sf, cols=tuple(_dcols)):
    return features.rolling_features(daily(spark, sf)).select(*KB, *cols)


_sql, _mcols = _rolling_sql("minutely")


@query("f1_rolling_minute", with_(_sql, "minutely"), _mcols, digits=4)
def _(spark, sf, cols=tuple(_mcols)):
    """Minute series have no calendar bound worth the name and are cut."""
    minutes = series.bucket_rollup(billing(spark, sf), "minute")
    cut = series.over_series(
        minutes, lambda df, part: features.rolling_features(df, keys=part), before=max(WINDOWS), split=series.split_for("minute"))
    return cut.select(*KB, *cols)


_z = [f"total_cost_roll{n}_zscore" for n in WINDOWS]


def _z_sql(src: str) -> str:
    return f"SELECT {KBS}, " + ", ".join(
        f"CASE WHEN s{n} > abs(m{n}) * 1e-12 THEN (total_cost - m{n}) / s{n} END AS total_cost_roll{n}_zscore" for n in WINDOWS) + \
        " FROM (SELECT *, " + ", ".join(
            f"avg(total_cost) OVER {_frame(n)} AS m{n}, stddev_samp(total_cost) OVER {_frame(n)} AS s{n}" for n in WINDOWS) + f" FROM {src})"


@query("f2_rolling_zscore", with_(_z_sql("hourly"), "hourly"), _z)
def _(spark, sf):
    return features.rolling_features(hourly(spark, sf)).select(*KB, *_z)


@query("f3_series_isolation", with_(
    f"""SELECT {K}, count(*) AS n, sum(first_mean) AS first_rows_mean, sum(CASE WHEN first_std IS NULL THEN 1 ELSE 0 END) AS single_row_stds FROM (
        SELECT {K}, CASE WHEN row_number() OVER ({PART}) = 1 THEN total_cost END AS first_mean,
          stddev_samp(total_cost) OVER {_frame(15)} AS first_std FROM hourly) GROUP BY {K}""", "hourly"), ("first_rows_mean",))
def _(spark, sf):
    df = features.rolling_features(hourly(spark, sf), RollingConfig(windows=(15,), aggs=("mean", "std")))
    first = F.row_number().over(series.series_window()) == 1
    df = df.withColumn("first", F.when(first, F.col("total_cost_roll15_mean")))
    return df.groupBy("account_id", "service", "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("first").alias("first_rows_mean"),
        F.count_if(F.col("total_cost_roll15_std").isNull()).alias("single_row_stds"))


# minute series have no calendar bound per key, so they are cut into blocks
_sql, _mcols = _rolling_sql("minutely")


@query("f3_rolling_minute_blocks", with_(_sql, "minutely"), _mcols)
def _(spark, sf, cols=tuple(_mcols)):
    df = series.bucket_rollup(billing(spark, sf), "minute")
    out = series.over_series(
        df, lambda frame, keys: features.rolling_features(frame, RollingConfig(), keys), before=59,
        split=series.SplitConfig(segment_seconds=3600, block_rows=200))
    return out.select(*KB, *cols)


@query("f4_last_values", with_(
    f"""SELECT {KBS}, array_to_string(list(round(total_cost, 2)) OVER ({PART} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS last5
        FROM hourly""", "hourly"))
def _(spark, sf):
    df = features.last_values(hourly(spark, sf), 5)
    texts = F.transform("total_cost_last5", lambda v: F.round(v, 2).cast("string"))
    return df.select(*KB, F.array_join(texts, ",").alias("last5"))


# -- growth ---------------------------------------------------------------------------------


def _lag(n: int) -> str:
    return f"lag(total_cost, {n}) OVER ({PART})"


def _pct(n: int) -> str:
    e = f"(total_cost - {_lag(n)}) / nullif(abs({_lag(n)}), 0)"
    return f"CASE WHEN ({e}) IS NOT NULL THEN greatest(-5.0, least(5.0, {e})) END"


_growth = {f"total_cost_pct_change_{n}": _pct(n) for n in (1, 5, 15)}


@query("f5_percent_change", with_(f"SELECT {KBS}, " + ", ".join(f"{e} AS {c}" for c, e in _growth.items()) + " FROM hourly", "hourly"), list(_growth))
def _(spark, sf):
    return features.growth_features(hourly(spark, sf)).select(*KB, *_growth)


_logs = {f"total_cost_log_return_{n}":
         f"CASE WHEN {_lag(n)} IS NOT NULL THEN ln(greatest(total_cost, 1e-9) / greatest({_lag(n)}, 1e-9)) END" for n in (1, 5, 15)}


@query("f6_log_return", with_(f"SELECT {KBS}, " + ", ".join(f"{e} AS {c}" for c, e in _logs.items()) + " FROM hourly", "hourly"), list(_logs))
def _(spark, sf):
    return features.growth_features(hourly(spark, sf)).select(*KB, *_logs)


# two annual bases: the default overflows on noisy series and is clipped
_cagr = {f"total_cost_cagr_{n}": f"""CASE WHEN {_lag(n)} IS NOT NULL THEN greatest(-10.0, least(10.0,
  CASE WHEN CAST({p}.0 / {n} AS DOUBLE) * ln(greatest(total_cost, 1e-9) / greatest({_lag(n)}, 1e-9)) > 700 THEN 1e300
  ELSE pow(greatest(total_cost, 1e-9) / greatest({_lag(n)}, 1e-9), CAST({p}.0 / {n} AS DOUBLE)) - 1.0 END)) END"""
         for n, p in ((5, 525600), (15, 525600), (60, 525600))}


@query("f7_annualised_growth", with_(f"SELECT {KBS}, " + ", ".join(f"{e} AS {c}" for c, e in _cagr.items()) + " FROM hourly", "hourly"), list(_cagr))
def _(spark, sf):
    return features.growth_features(hourly(spark, sf)).select(*KB, *_cagr)


@query("f7_growth_per_day_base", with_(
    f"""SELECT {KBS}, CASE WHEN {_lag(24)} IS NOT NULL THEN greatest(-10.0, least(10.0,
        pow(greatest(total_cost, 1e-9) / greatest({_lag(24)}, 1e-9), CAST(48 AS DOUBLE) / 24) - 1.0)) END AS total_cost_cagr_24 FROM hourly""",
    "hourly"), ("total_cost_cagr_24",))
def _(spark, sf):
    cfg = GrowthConfig(windows=(24,), periods_per_year=48)
    return features.growth_features(hourly(spark, sf), cfg).select(*KB, "total_cost_cagr_24")


@query("f8_acceleration", with_(
    f"SELECT {KBS}, pc - lag(pc) OVER ({PART}) AS total_cost_accel FROM (SELECT *, {_pct(1)} AS pc FROM hourly)", "hourly"),
       ("total_cost_accel",))
def _(spark, sf):
    return features.growth_features(hourly(spark, sf)).select(*KB, "total_cost_accel")


# -- volatility --------------------------------------------------------------------------------

_STATS = "SELECT *, " + ", ".join(
    f"avg(total_cost) OVER {_frame(n)} AS m{n}, stddev_samp(total_cost) OVER {_frame(n)} AS s{n}, count(*) OVER {_frame(n)} AS n{n}, "
    f"max(total_cost) OVER {_frame(n)} - min(total_cost) OVER {_frame(n)} AS r{n}, "
    f"quantile_cont(total_cost, 0.75) OVER {_frame(n)} - quantile_cont(total_cost, 0.25) OVER {_frame(n)} AS q{n}"
    for n in WINDOWS) + " FROM hourly"


def _vol(name: str, prefix: str, expr, rolled: bool = False):
    cols = [f"total_cost_{prefix}_{n}" for n in WINDOWS]

    @query(name, with_(f"SELECT {KBS}, " + ", ".join(f"{expr(n)} AS {c}" for n, c in zip(WINDOWS, cols)) + f" FROM ({_STATS})", "hourly"), cols)
    def _(spark, sf):
        df = hourly(spark, sf)
        if rolled:
            df = features.rolling_features(df)
        return features.volatility_features(df).select(*KB, *cols)


def _clean(n: int) -> str:
    return f"CASE WHEN s{n} IS NOT NULL THEN CASE WHEN s{n} > abs(m{n}) * 1e-12 THEN s{n} ELSE 0.0 END END"


_vol("f9_variation_coefficient", "cv", lambda n: f"CASE WHEN n{n} >= 2 THEN ({_clean(n)}) / nullif(m{n}, 0) END")
_vol("f10_rolling_range", "range", lambda n: f"CASE WHEN n{n} >= 2 THEN r{n} END")
_vol("f10_rolling_range_reused", "range", lambda n: f"r{n}", rolled=True)
_vol("f11_interquartile_range", "iqr", lambda n: f"CASE WHEN n{n} >= 2 THEN q{n} END")
_vol("f12_band_width", "bb_width", lambda n: f"4.0 * ({_clean(n)}) / nullif(m{n}, 0)")

_hv = [f"total_cost_hist_vol_{n}" for n in WINDOWS]


@query("f13_historical_volatility", with_(
    f"SELECT {KBS}, " + ", ".join(
        f"CASE WHEN count(lr) OVER {_frame(n)} >= 2 THEN stddev_samp(lr) OVER {_frame(n)} * sqrt(525600.0 / {n}) END AS total_cost_hist_vol_{n}"
        for n in WINDOWS) + f" FROM (SELECT *, {_logs['total_cost_log_return_1']} AS lr FROM hourly)", "hourly"), _hv, digits=4)
def _(spark, sf):
    return features.volatility_features(hourly(spark, sf), VolatilityConfig()).select(*KB, *_hv)


# -- calendar and the median detector ------------------------------------------------------------

_CAL = "CAST(hour(bucket) AS INTEGER) AS hour_of_day, CAST(isodow(bucket) - 1 AS INTEGER) AS day_of_week"


@query("f14_calendar", with_(
    f"SELECT {KBS}, {_CAL}, CAST(day(bucket) AS INTEGER) AS day_of_month, CAST(month(bucket) AS INTEGER) AS month FROM hourly", "hourly"))
def _(spark, sf):
    return features.calendar_features(hourly(spark, sf)).select(*KB, "hour_of_day", "day_of_week", "day_of_month", "month")


@query("f15_business_flags", with_(
    f"""SELECT {KBS}, CASE WHEN isodow(bucket) >= 6 THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN isodow(bucket) < 6 AND hour(bucket) >= 9 AND hour(bucket) < 17 THEN 1 ELSE 0 END AS is_business_hour FROM hourly""", "hourly"))
def _(spark, sf):
    return features.calendar_features(hourly(spark, sf)).select(*KB, "is_weekend", "is_business_hour")


@query("f16_cyclic_encoding", with_(
    f"""SELECT {KBS}, sin(2 * pi() * hour(bucket) / 24) AS hour_sin, cos(2 * pi() * hour(bucket) / 24) AS hour_cos,
        sin(2 * pi() * (isodow(bucket) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(bucket) - 1) / 7) AS dow_cos FROM hourly""", "hourly"),
       ("hour_sin", "hour_cos", "dow_sin", "dow_cos"))
def _(spark, sf):
    return features.calendar_features(hourly(spark, sf)).select(*KB, "hour_sin", "hour_cos", "dow_sin", "dow_cos")


_MAD = f"PARTITION BY {K} ORDER BY timestamp, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"


@query("f17_rolling_mad", with_(
    f"""SELECT event_id, median, deviation, mad, CASE WHEN deviation > 3 * mad THEN 1 ELSE 0 END AS is_anomaly FROM (
        SELECT *, CASE WHEN count(deviation) OVER w = 7 THEN quantile_cont(deviation, 0.5) OVER w END AS mad FROM (
          SELECT *, abs(cost_amount - median) AS deviation FROM (
            SELECT event_id, {K}, timestamp, cost_amount, CASE WHEN count(*) OVER w = 7 THEN quantile_cont(cost_amount, 0.5) OVER w END AS median
            FROM billing WINDOW w AS ({_MAD}))) WINDOW w AS ({_MAD}))""", "billing"), ("median", "deviation", "mad"))
def _(spark, sf):
    return features.rolling_mad(billing(spark, sf)).select("event_id", "median", "deviation", "mad", "is_anomaly")


# -- models ----------------------------------------------------------------------------------------


@query("m1_seasonal_profile", with_("SELECT hour_of_day, day_of_week, mean, std, n FROM profile", "profile"), ("mean", "std"))
def _(spark, sf):
    return frames.profile(spark, sf).filter((F.col("hour_of_day") >= 0) & (F.col("n") > 0))


@query("m1_pooled_statistics", with_("SELECT gm AS mean, gs AS std, gn AS n FROM profile_pooled", "profile"), ("mean", "std"))
def _(spark, sf):
    return frames.profile(spark, sf).filter(F.col("hour_of_day") == baseline.GLOBAL_SLOT).select("mean", "std", "n")


@query("m2_ewma", with_(f"SELECT {KBS}, ewma FROM forecasted_ewma", "forecasted"), ("ewma",))
def _(spark, sf):
    return baseline.ewma(hourly(spark, sf), "total_cost", 0.3).select(*KB, "ewma")


_FC = ("forecast_mean", "forecast_std")


@query("m3_forecast", with_(f"SELECT {KBS}, forecast_mean, forecast_std FROM forecasted", "forecasted"), _FC)
def _(spark, sf):
    return baseline.forecast(hourly(spark, sf), frames.profile(spark, sf)).select(*KB, *_FC)


_CI = ("ci_lower_80", "ci_upper_80", "ci_lower_95", "ci_upper_95")


@query("m4_confidence_bounds", with_(
    f"""SELECT {KBS}, greatest(0.0, forecast_mean - 1.2815515655446008 * forecast_std) AS ci_lower_80,
        forecast_mean + 1.2815515655446008 * forecast_std AS ci_upper_80, ci_lower_95, ci_upper_95 FROM forecasted""", "forecasted"), _CI)
def _(spark, sf):
    from ..config import BaselineConfig

    cfg = BaselineConfig(levels=(0.80, 0.95))
    return baseline.forecast(hourly(spark, sf), frames.profile(spark, sf), cfg).select(*KB, *_CI)


_RES = ("residual", "abs_residual", "z_score", "abs_z_score")


@query("m5_residuals", with_(
    f"SELECT {KBS}, residual, abs(residual) AS abs_residual, z_score, abs(z_score) AS abs_z_score FROM forecasted", "forecasted"), _RES)
def _(spark, sf):
    actuals = hourly(spark, sf)
    predicted = baseline.forecast(actuals, frames.profile(spark, sf))
    return baseline.residuals(baseline.merge_forecast(actuals, predicted, KB)).select(*KB, *_RES)


@query("m6_interval_breach", with_(
    f"SELECT {KBS}, CASE WHEN total_cost < ci_lower_95 OR total_cost > ci_upper_95 THEN 1 ELSE 0 END AS is_outside_ci_95 FROM forecasted",
    "forecasted"))
def _(spark, sf):
    df = baseline.residuals(baseline.forecast(hourly(spark, sf), frames.profile(spark, sf)), ResidualConfig())
    return df.select(*KB, "is_outside_ci_95")


def _training(spark, sf):
    return features.calendar_features(hourly(spark, sf))


@query("m7_feature_columns", with_(
    "SELECT feature, (SELECT count(*) FROM hourly) AS n_rows FROM (VALUES " + ", ".join(f"('{c}')" for c in FEATURES) + ") v(feature)", "hourly"))
def _(spark, sf):
    df = baseline.residuals(baseline.forecast(_training(spark, sf), frames.profile(spark, sf)))
    names = detectors.feature_columns(df)
    # one row per chosen feature, with the number of rows that have it
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("has")) for c in names])).alias("f")) \
        .groupBy("f.feature").agg(F.count_if("f.has").alias("n_rows"))


@query("m8_training_medians", with_(
    f"""SELECT feature, quantile_cont(v, 0.5) AS median FROM (
        SELECT unnest(['total_cost', 'total_usage', 'pct']) AS feature, unnest([total_cost, total_usage, pct]) AS v FROM (
          SELECT *, {_pct(1)} AS pct FROM hourly)) WHERE v IS NOT NULL GROUP BY 1""", "hourly"), ("median",))
def _(spark, sf):
    df = features.growth_features(hourly(spark, sf)).withColumnRenamed("total_cost_pct_change_1", "pct")
    return detectors.feature_medians(df, ["total_cost", "total_usage", "pct"])


@query("m8_complete_rows", with_(
    f"SELECT {K}, count(pct) AS n_complete, count(*) AS n_rows FROM (SELECT *, {_pct(15)} AS pct FROM hourly) GROUP BY {K}", "hourly"))
def _(spark, sf):
    df = features.growth_features(hourly(spark, sf)).select(*KB, "total_cost", "total_cost_pct_change_15")
    kept = detectors.complete_rows(df, ["total_cost", "total_cost_pct_change_15"]).groupBy("account_id", "service", "region").agg(
        F.count(F.lit(1)).alias("n_complete"))
    every = df.groupBy("account_id", "service", "region").agg(F.count(F.lit(1)).alias("n_rows"))
    return every.join(kept, ["account_id", "service", "region"])


def _forest(spark, sf):
    return detectors.fit_forest(_training(spark, sf), ForestConfig())


def _reconstruction(spark, sf):
    return detectors.fit_reconstruction(_training(spark, sf))


_NODES_SQL = "SELECT tree, node, coalesce(f - 1, -1) AS feature, cut, path FROM if_nodes"
_VECTOR_NAMES = [f"component_{i}" for i in range(COMPONENTS)]


def _vectors(rows):
    """A row per feature of stored reconstructions: mean, deviation and weight in each component."""
    per = rows.select(F.posexplode("features").alias("i", "feature"), "fill", "scale", "components")
    return per.select(
        "feature", F.get("fill", F.col("i")).alias("mean"), F.get("scale", F.col("i")).alias("std"),
        *[F.get(F.get("components", F.lit(j)), F.col("i")).alias(c) for j, c in enumerate(_VECTOR_NAMES)])


@query("m9_isolation_forest_fit", with_(_NODES_SQL, "if_nodes"), ("cut", "path"))
def _(spark, sf):
    return spark.createDataFrame(_forest(spark, sf).nodes, detectors.TREE_SCHEMA)


@query("m10_isolation_forest_score", with_(f"SELECT {KBS}, if_score, if_anomaly FROM if_scored", "if_scored"), ("if_score",))
def _(spark, sf):
    return _forest(spark, sf).transform(_training(spark, sf)).select(*KB, "if_score", "if_anomaly")


@query("m11_reconstruction_fit", with_("SELECT * FROM re_model", "re_model"), ("mean", "std", *_VECTOR_NAMES))
def _(spark, sf):
    return _vectors(spark.createDataFrame([_reconstruction(spark, sf).record()], detectors.MODEL_SCHEMA))


@query("io15_forest_table", with_(f"SELECT 'v1' AS model_version, (SELECT n FROM if_size) AS train_rows, * FROM ({_NODES_SQL})", "if_nodes", "if_size"),
       ("cut", "path"))
def _(spark, sf):
    root = scratch_path(spark, "detectors")
    models.save(spark, _forest(spark, sf), root, "v1")
    return models.records(spark, root).select("model_version", "train_rows", F.inline("trees"))


@query("io15_reconstruction_table", with_("SELECT * FROM re_model", "re_model"), ("mean", "std", *_VECTOR_NAMES))
def _(spark, sf):
    root = scratch_path(spark, "detectors")
    models.save(spark, _reconstruction(spark, sf), root, "v1")
    return _vectors(models.records(spark, root, "v1"))


@query("io15_stored_forest_score", with_(f"SELECT {KBS}, if_score, if_anomaly FROM if_scored", "if_scored"), ("if_score",))
def _(spark, sf):
    root = scratch_path(spark, "detectors")
    models.save(spark, _forest(spark, sf), root)
    return models.load(spark, root).transform(_training(spark, sf)).select(*KB, "if_score", "if_anomaly")


@query("m11_standardisation", with_(
    """SELECT feature, avg(v) AS mean, stddev_samp(v) AS std FROM (SELECT unnest(['total_cost', 'total_usage', 'hour_of_day', 'day_of_week', 'is_weekend']) AS feature,
         unnest([total_cost, total_usage, CAST(hour(bucket) AS DOUBLE), CAST(isodow(bucket) - 1 AS DOUBLE), CASE WHEN isodow(bucket) >= 6 THEN 1.0 ELSE 0.0 END]) AS v
       FROM hourly) GROUP BY 1""", "hourly"), ("mean", "std"))
def _(spark, sf):
    m = detectors.fit_reconstruction(_training(spark, sf), features=["total_cost", "total_usage", "hour_of_day", "day_of_week", "is_weekend"])
    return spark.createDataFrame(list(zip(m.features, m.means, m.stds)), "feature STRING, mean DOUBLE, std DOUBLE")


@query("m12_reconstruction_score", with_(f"SELECT {KBS}, if_score, if_anomaly FROM re_scored", "re_scored"), ("if_score",))
def _(spark, sf):
    return _reconstruction(spark, sf).transform(_training(spark, sf)).select(*KB, "if_score", "if_anomaly")


@query("m13_retrain", with_(
    f"""SELECT CAST(hour(bucket) AS INTEGER) AS hour_of_day, CAST(isodow(bucket) - 1 AS INTEGER) AS day_of_week, avg(total_cost) AS mean,
        count(*) AS n FROM (SELECT date_trunc('hour', timestamp) AS bucket, {K}, round(sum(cost_amount), 6) AS total_cost FROM billing
        WHERE timestamp >= {NOW_SQL} - INTERVAL 14 DAY GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""", "billing"), ("mean",))
def _(spark, sf):
    root = scratch_path(spark, "models")
    fitted = baseline.retrain(billing(spark, sf), NOW, days=14)
    tables.write_version(fitted, root, "v20240131_000000")
    stored = tables.read_version(spark, root)
    baseline.require_rows(stored, 60)
    return stored.filter((F.col("hour_of_day") >= 0) & (F.col("n") > 0)).select("hour_of_day", "day_of_week", "mean", "n")


# -- rules and fusion -----------------------------------------------------------------------------


def _rule(name: str, short: str):
    cols = [f"{short}_fired", f"{short}_score"]

    @query(name, with_(f"SELECT {KBS}, {', '.join(cols)} FROM ruled", "ruled"), cols[1:])
    def _(spark, sf):
        return rules.apply_rules(hourly(spark, sf), frames.RULES).select(*KB, *cols)


_rule("r1_threshold_breach", "threshold")
_rule("r2_sudden_jump", "jump")
_rule("r3_sustained_increase", "sustained")


@query("r4_rule_score", with_(f"SELECT {KBS}, rule_score FROM ruled", "ruled"), ("rule_score",))
def _(spark, sf):
    return rules.apply_rules(hourly(spark, sf), frames.RULES).select(*KB, "rule_score")


@query("e1_ts_signal", with_(f"SELECT {KBS}, ts_signal FROM signals", "signals"), ("ts_signal",))
def _(spark, sf):
    return frames.scored(spark, sf).select(*KB, "ts_signal")


_HOLES = """SELECT *, CASE WHEN event_count % 3 = 0 THEN NULL ELSE least(total_cost / 200, 1.0) END AS ts_signal,
  CASE WHEN event_count % 2 = 0 THEN NULL ELSE least(total_usage / 150, 1.0) END AS if_score,
  CASE WHEN event_count % 4 = 3 THEN NULL ELSE least(total_cost / 300, 1.0) END AS rule_score FROM hourly"""


@query("e2_fusion", with_(
    f"""SELECT {KBS}, CASE WHEN ts_signal IS NULL AND if_score IS NULL AND rule_score IS NULL THEN 0.0 ELSE
        (coalesce(CAST(0.35 AS DOUBLE) * ts_signal, 0) + coalesce(CAST(0.40 AS DOUBLE) * if_score, 0) + coalesce(CAST(0.25 AS DOUBLE) * rule_score, 0)) /
        nullif(CASE WHEN ts_signal IS NULL THEN 0 ELSE 0.35 END + CASE WHEN if_score IS NULL THEN 0 ELSE 0.40 END
        + CASE WHEN rule_score IS NULL THEN 0 ELSE 0.25 END, 0) END AS anomaly_score FROM ({_HOLES})""", "hourly"), ("anomaly_score",))
def _(spark, sf):
    n, one = F.col("event_count"), F.lit(1.0)
    df = hourly(spark, sf).withColumns({
        "ts_signal": F.when(n % 3 != 0, F.least(F.col("total_cost") / 200, one)),
        "if_score": F.when(n % 2 != 0, F.least(F.col("total_usage") / 150, one)),
        "rule_score": F.when(n % 4 != 3, F.least(F.col("total_cost") / 300, one)),
    })
    return scoring.fuse(df).select(*KB, "anomaly_score")


@query("e3_decision", with_("SELECT is_anomaly, count(*) AS n FROM rule_scored GROUP BY 1", "rule_scored"))
def _(spark, sf):
    return frames.rule_scored(spark, sf).groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"))


@query("e4_severity", with_(f"SELECT {KBS}, severity FROM rule_scored", "rule_scored"))
def _(spark, sf):
    return frames.rule_scored(spark, sf).select(*KB, "severity")


@query("e6_rule_scoring", with_(f"SELECT {KBS}, total_cost, rule_score, anomaly_score, is_anomaly, severity FROM rule_scored", "rule_scored"),
       ("total_cost", "rule_score", "anomaly_score"))
def _(spark, sf):
    return frames.rule_scored(spark, sf).select(*KB, "total_cost", "rule_score", "anomaly_score", "is_anomaly", "severity")


@query("e6_ensemble_scoring", with_(
    f"SELECT {KBS}, ts_signal, if_score, rule_score, anomaly_score, is_anomaly, severity FROM scored", "scored"),
       ("ts_signal", "rule_score", "anomaly_score"))
def _(spark, sf):
    return frames.scored(spark, sf).select(*KB, "ts_signal", "if_score", "rule_score", "anomaly_score", "is_anomaly", "severity")


@query("e6_full_ensemble", with_(
    f"SELECT {KBS}, ts_signal, if_score, if_anomaly, rule_score, anomaly_score, is_anomaly, severity FROM det_scored", "det_scored"),
       ("ts_signal", "if_score", "rule_score", "anomaly_score"))
def _(spark, sf):
    model = _reconstruction(spark, sf)
    out = scoring.score_series(_training(spark, sf), frames.profile(spark, sf), model.transform, rules=frames.RULES)
    return out.select(*KB, "ts_signal", "if_score", "if_anomaly", "rule_score", "anomaly_score", "is_anomaly", "severity")


# -- explanations ------------------------------------------------------------------------------------


@query("x1_forecast_explanation", with_(
    f"""SELECT {KBS}, CASE WHEN residual > 0 THEN 'above' WHEN residual < 0 THEN 'below' ELSE 'within' END AS exp_direction,
        residual / nullif(abs(forecast_mean), 0) * 100 AS exp_pct_deviation, z_score AS exp_z_score,
        total_cost < ci_lower_95 OR total_cost > ci_upper_95 AS exp_ci_breach,
        CASE WHEN total_cost < ci_lower_95 OR total_cost > ci_upper_95 THEN ', breaching the 95% confidence interval.' ELSE '' END AS breach_text
        FROM forecasted""", "forecasted"), ("exp_pct_deviation", "exp_z_score"))
def _(spark, sf):
    df = baseline.residuals(baseline.forecast(hourly(spark, sf), frames.profile(spark, sf)))
    return explain.explain_forecast(df).select(
        *KB, "exp_direction", "exp_pct_deviation", "exp_z_score", "exp_ci_breach",
        F.regexp_extract("exp_summary", r", breaching.*$", 0).alias("breach_text"))


@query("x2_rule_explanation", with_(
    f"""SELECT {KBS}, concat_ws(', ', CASE WHEN threshold_fired = 1 THEN 'threshold_breach' END, CASE WHEN jump_fired = 1 THEN 'sudden_jump' END,
        CASE WHEN sustained_fired = 1 THEN 'sustained_increase' END) AS exp_rule_triggered_rules,
        CASE WHEN rn < 4 THEN 'Need at least 4 observations, got ' || rn || '.'
             WHEN sustained_fired = 1 THEN 'All 3 consecutive periods grew by ≥5.0% — sustained upward trend detected.'
             ELSE 'Only ' || passing || '/3 periods met the 5.0% growth threshold.' END AS exp_rule_sustained_reason,
        CASE threshold_fired + jump_fired + sustained_fired WHEN 0 THEN 'No rules triggered.' WHEN 1 THEN '1 rule triggered'
             ELSE threshold_fired + jump_fired + sustained_fired || ' rules triggered' END AS headline
        FROM ruled""", "ruled"))
def _(spark, sf):
    df = explain.explain_rules(rules.apply_rules(hourly(spark, sf), frames.RULES), frames.RULES)
    return df.select(*KB, "exp_rule_triggered_rules", "exp_rule_sustained_reason",
                     F.regexp_replace("exp_rule_summary", ": .*$", "").alias("headline"))


@query("x2_rule_reasons", with_(
    f"""SELECT {KBS}, CASE WHEN threshold_fired = 1 THEN 'exceeds' ELSE printf('Value %.2f within budget limit {BUDGET_LIMIT:.2f}.', total_cost) END AS threshold_reason,
        jump_score AS exp_rule_jump_score FROM ruled""", "ruled"), ("exp_rule_jump_score",))
def _(spark, sf):
    df = explain.explain_rules(rules.apply_rules(hourly(spark, sf), frames.RULES), frames.RULES)
    reason = F.when(F.col("exp_rule_threshold_fired"), F.lit("exceeds")).otherwise(F.col("exp_rule_threshold_reason"))
    return df.select(*KB, reason.alias("threshold_reason"), "exp_rule_jump_score")


_PARTS = """SELECT *, CASE c WHEN 'ts_signal' THEN ts_signal WHEN 'if_score' THEN if_score ELSE rule_score END AS raw_score,
  CASE c WHEN 'ts_signal' THEN 0.35 WHEN 'if_score' THEN 0.40 ELSE 0.25 END AS configured_weight
  FROM scored, (VALUES ('ts_signal'), ('if_score'), ('rule_score')) v(c)"""
_BD = ("raw_score", "configured_weight", "effective_weight", "weighted_contribution")


@query("x3_score_breakdown", with_(
    f"""SELECT {KBS}, c AS name, raw_score, CAST(configured_weight AS DOUBLE) AS configured_weight,
        CASE WHEN raw_score IS NULL THEN 0.0 ELSE configured_weight / wsum END AS effective_weight,
        CASE WHEN raw_score IS NULL THEN 0.0 ELSE configured_weight / wsum * raw_score END AS weighted_contribution,
        raw_score IS NOT NULL AS active FROM ({_PARTS})""", "scored"), _BD)
def _(spark, sf):
    df = explain.score_breakdown(frames.scored(spark, sf))
    return df.select(*KB, F.explode("exp_components").alias("c")).select(*KB, "c.name", *[f"c.{f}" for f in _BD], "c.active")


@query("x4_explanation_payload", with_(
    f"""SELECT {KBS}, anomaly_score, CAST(0.55 AS DOUBLE) AS anomaly_threshold, is_anomaly = 1 AS is_anomaly, severity, 3 AS n_components,
        forecast_mean, CAST(NULL AS DOUBLE) AS if_raw, z_score, true AS payload_agrees,
        total_cost < ci_lower_95 OR total_cost > ci_upper_95 AS breach_95, threshold_fired = 1 AS threshold_fired,
        CASE WHEN threshold_fired = 1 THEN 1 ELSE 0 END + CASE WHEN jump_fired = 1 THEN 1 ELSE 0 END + CASE WHEN sustained_fired = 1 THEN 1 ELSE 0 END AS n_triggered,
        0 AS n_errors FROM scored""", "scored"), ("anomaly_score", "anomaly_threshold", "forecast_mean", "if_raw", "z_score"))
def _(spark, sf):
    df = explain.explain_rules(explain.explain_forecast(frames.scored(spark, sf)), frames.RULES)
    df = explain.explanation_payload(df).select(
        *KB, "anomaly_score", "forecast_mean", "z_score", explain.payload_json().alias("j"), F.size(explain.payload_errors()).alias("n_errors"))
    body = F.from_json("j", """anomaly_score DOUBLE, anomaly_threshold DOUBLE, is_anomaly BOOLEAN, severity STRING,
      components ARRAY<STRUCT<name: STRING, raw_score: DOUBLE>>,
      forecast_explanation STRUCT<forecast_mean: DOUBLE, z_score: DOUBLE, ci_breaches: MAP<STRING, BOOLEAN>>,
      rule_explanation STRUCT<threshold_breach: STRUCT<fired: BOOLEAN>, triggered_rules: ARRAY<STRING>>""")
    return df.withColumn("b", body).select(
        *KB, "anomaly_score", "b.anomaly_threshold", "b.is_anomaly", "b.severity", F.size("b.components").alias("n_components"),
        "forecast_mean", F.col("b.components")[1]["raw_score"].alias("if_raw"), "z_score",
        ((F.abs(F.col("b.anomaly_score") - F.col("anomaly_score")) < 6e-7)
         & (F.abs(F.col("b.forecast_explanation.forecast_mean") - F.col("forecast_mean")) < 6e-7)
         & (F.abs(F.col("b.forecast_explanation.z_score") - F.col("z_score")) < 6e-5)).alias("payload_agrees"),
        F.col("b.forecast_explanation.ci_breaches")["95"].alias("breach_95"),
        F.col("b.rule_explanation.threshold_breach.fired").alias("threshold_fired"),
        F.size("b.rule_explanation.triggered_rules").alias("n_triggered"), "n_errors")
