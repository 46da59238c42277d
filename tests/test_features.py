import math

import numpy as np
import pandas as pd
import pytest

from helpers import by_bucket, frame, series_rows
from ledgerlark.config import GrowthConfig, RollingConfig, VolatilityConfig
from ledgerlark.operators import baseline, features
from ledgerlark.operators.series import SplitConfig, over_series

RNG = np.random.default_rng(7)
NOISE = RNG.gamma(2.0, 50.0, 200).round(2)


def close(got, want, tol=1e-9):
    for g, w in zip(got, want, strict=True):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None
        else:
            assert g == pytest.approx(w, rel=tol, abs=tol)


def test_rolling_matches_pandas(spark):
    df = features.rolling_features(frame(spark, series_rows(NOISE)))
    s = pd.Series(NOISE)
    for w in (5, 15, 60):
        r = s.rolling(w, min_periods=1)
        for agg in ("mean", "std", "min", "max", "sum"):
            close([v for (v,) in by_bucket(df, f"total_cost_roll{w}_{agg}")], getattr(r, agg)())
        close([v for (v,) in by_bucket(df, f"total_cost_roll{w}_zscore")], (s - r.mean()) / r.std(), 1e-7)


def test_single_row_and_constant_series(spark):
    df = features.rolling_features(frame(spark, series_rows([50.0] * 20, service="storage"), series_rows([5.0], service="one")))
    rows = df.filter("service = 'storage'").collect()
    assert all(r.total_cost_roll5_zscore is None for r in rows)
    one = df.filter("service = 'one'").first()
    assert one.total_cost_roll5_std is None and one.total_cost_roll5_mean == 5.0


def test_series_are_isolated(spark):
    ramp, flat = series_rows(range(100, 120)), series_rows([50.0] * 20, service="storage")
    both = features.rolling_features(frame(spark, ramp, flat)).filter("service = 'compute'")
    alone = features.rolling_features(frame(spark, ramp))
    cols = [c for c in alone.columns if "roll" in c]
    assert by_bucket(both, *cols) == by_bucket(alone, *cols)


def test_growth_edges(spark):
    df = features.growth_features(frame(spark, series_rows([0.0, 10.0, 5.0, 1000.0])), GrowthConfig(lags=(1,), windows=(1,)))
    rows = by_bucket(df, "total_cost_pct_change_1", "total_cost_log_return_1", "total_cost_cagr_1", "total_cost_accel")
    assert rows[0] == (None, None, None, None)
    assert rows[1][0] is None and rows[1][2] == 10.0  # from zero: no percent, growth clipped
    assert rows[2][0] == pytest.approx(-0.5) and rows[2][2] == -1.0 and rows[2][3] is None
    assert rows[3][0] == 5.0 and rows[3][3] == pytest.approx(5.5)


def test_volatility_matches_pandas(spark):
    df = features.volatility_features(frame(spark, series_rows(NOISE)), VolatilityConfig(windows=(5, 60)))
    s = pd.Series(NOISE)
    log_ret = np.log(s / s.shift(1))
    for w in (5, 60):
        r = s.rolling(w, min_periods=2)
        close([v for (v,) in by_bucket(df, f"total_cost_cv_{w}")], r.std() / r.mean())
        close([v for (v,) in by_bucket(df, f"total_cost_range_{w}")], r.max() - r.min())
        close([v for (v,) in by_bucket(df, f"total_cost_iqr_{w}")], r.quantile(0.75) - r.quantile(0.25))
        close([v for (v,) in by_bucket(df, f"total_cost_bb_width_{w}")], 4 * r.std() / r.mean())
        close([v for (v,) in by_bucket(df, f"total_cost_hist_vol_{w}")],
              log_ret.rolling(w, min_periods=2).std() * math.sqrt(525600 / w), 1e-8)


def test_calendar_time_zone(spark):
    from ledgerlark.config import CalendarConfig

    df = frame(spark, series_rows([1.0]))  # Tuesday 09:00 UTC
    utc = features.calendar_features(df).first()
    assert (utc.hour_of_day, utc.day_of_week, utc.is_business_hour, utc.is_weekend) == (9, 1, 1, 0)
    tokyo = features.calendar_features(df, CalendarConfig(tz="Asia/Tokyo")).first()
    assert (tokyo.hour_of_day, tokyo.is_business_hour) == (18, 0)


def test_blocks_equal_uncut(spark):
    """Cutting a hot series into blocks changes no value."""
    hot = frame(spark, series_rows(NOISE), series_rows(NOISE[:33], account="b"))

    def apply(df, keys):
        return baseline.ewma(features.rolling_features(df, RollingConfig(), keys), "total_cost", 0.3, "ewma", keys)

    cols = [f"total_cost_roll{w}_{a}" for w in (5, 15, 60) for a in ("mean", "std", "max")] + ["ewma"]
    whole = by_bucket(over_series(hot, apply, before=127), *cols)
    for size, seconds in ((127, 60), (130, 600), (150, 3600)):
        cut = by_bucket(over_series(hot, apply, before=127, split=SplitConfig(seconds, size)), *cols)
        assert len(cut) == len(whole)
        for a, b in zip(cut, whole):
            close(a, b, 1e-12)


def test_blocks_refuse_short_block(spark):
    with pytest.raises(ValueError):
        over_series(frame(spark, series_rows([1.0])), lambda d, k: d, before=60, split=SplitConfig(60, 10))


def test_mad_split_equals_uncut(spark):
    rows = [(f"e{i:04d}", r[0], *r[1:4], r[4]) for i, r in enumerate(series_rows(NOISE))]
    df = spark.createDataFrame(rows, "event_id string, timestamp timestamp, account_id string, service string, region string, cost_amount double")
    got = {}
    for name, split in (("cut", SplitConfig(300, 20)), ("whole", None)):
        out = features.rolling_mad(df, split=split).orderBy("event_id")
        got[name] = [(r.median, r.deviation, r.mad, r.is_anomaly) for r in out.collect()]
    assert got["cut"] == got["whole"]
    s = pd.Series(NOISE)
    med = s.rolling(7, center=True).median()
    close([g[0] for g in got["whole"]], med)
    mad = (s - med).abs().rolling(7, center=True).median()
    close([g[2] for g in got["whole"]], mad)
    assert [g[3] for g in got["whole"]] == ((s - med).abs() > 3 * mad).astype(int).tolist()


def test_ewma_matches_pandas(spark):
    df = baseline.ewma(frame(spark, series_rows(NOISE)), "total_cost", 0.3)
    close([v for (v,) in by_bucket(df, "ewma")], pd.Series(NOISE).ewm(alpha=0.3, adjust=False).mean(), 1e-12)


def test_last_values(spark):
    df = features.last_values(frame(spark, series_rows([1, 2, 3, 4])), 3)
    assert [v for (v,) in by_bucket(df, "total_cost_last3")] == [[1.0], [1.0, 2.0], [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]]


def test_unknown_aggregate():
    with pytest.raises(ValueError):
        RollingConfig(aggs=("median",))


def test_rolling_plan_has_one_sort(spark, sf):
    from ledgerlark.sources.adapters import hourly

    df = features.volatility_features(features.growth_features(features.rolling_features(hourly(spark, sf))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # rollup and series
    assert plan.count("Sort [") == 1
