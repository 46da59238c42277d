import json

import pytest
from pyspark.sql import functions as F

from helpers import by_bucket, frame, series_rows
from ledgerlark.config import RuleConfig, ScoringConfig, SeverityConfig
from ledgerlark.operators import baseline, explain, rules, scoring
from ledgerlark.operators.series import SplitConfig


def run(spark, costs, **kw):
    return rules.apply_rules(frame(spark, series_rows(costs)), RuleConfig(**kw))


def test_threshold_edges(spark):
    rows = by_bucket(run(spark, [1000.0, 1250.0, 5000.0]), "threshold_fired", "threshold_score")
    assert rows == [(0, 0.0), (1, 0.25), (1, 1.0)]
    zero = by_bucket(run(spark, [0.0, 3.0], budget_limit=0.0), "threshold_fired", "threshold_score")
    assert zero == [(0, 0.0), (1, 1.0)]


def test_jump_edges(spark):
    rows = by_bucket(run(spark, [0.0, 0.0, 5.0]), "jump_fired", "jump_score")
    assert rows == [(0, 0.0), (0, 0.0), (1, 1.0)]  # no history; both zero; positive from zero
    rows = by_bucket(run(spark, [100.0, 150.0]), "jump_fired", "jump_score")
    assert rows[1] == (0, 0.0)  # equal to the limit does not fire
    rows = by_bucket(run(spark, [100.0, 175.0]), "jump_fired", "jump_score")
    assert rows[1] == (1, pytest.approx(0.5))


def test_jump_looks_back_fifteen_rows(spark):
    rows = by_bucket(run(spark, [900.0] + [100.0] * 16), "jump_mean")
    assert rows[15][0] == pytest.approx((900 + 14 * 100) / 15)
    assert rows[16][0] == pytest.approx(100.0)


def test_sustained_edges(spark):
    rows = by_bucket(run(spark, [100, 110, 121, 134]), "sustained_fired", "sustained_score")
    assert rows[2] == (0, 0.0) and rows[3] == (1, 1.0)
    rows = by_bucket(run(spark, [0.0, 1.0, 1.0, 2.0]), "sustained_fired", "sustained_score")
    assert rows[3] == (0, pytest.approx(2 / 3))  # scored although not fired


def test_rule_config_validation():
    with pytest.raises(ValueError):
        RuleConfig(weight_threshold=0.9)
    with pytest.raises(ValueError):
        RuleConfig(weight_threshold=1.5, weight_jump=-0.7)


def signals(spark, *rows):
    return spark.createDataFrame(rows, "ts_signal double, if_score double, rule_score double")


def test_fusion_renormalises(spark):
    df = scoring.fuse(signals(spark, (0.8, 0.6, 0.4), (None, 0.6, 0.4), (None, None, 0.4), (None, None, None), (float("nan"), 0.6, 0.4)))
    s = [r.anomaly_score for r in df.collect()]
    assert s[0] == pytest.approx(0.35 * 0.8 + 0.4 * 0.6 + 0.25 * 0.4)
    assert s[1] == pytest.approx((0.24 + 0.1) / 0.65)
    assert s[2] == pytest.approx(0.4)
    assert s[3] == 0.0
    assert s[4] == pytest.approx(s[1])  # NaN counts as missing


def test_disabled_signal(spark):
    df = scoring.fuse(signals(spark, (1.0, 0.0, 0.0)), ScoringConfig(enable_ts=False))
    assert df.first().anomaly_score == 0.0


def test_severity_boundaries(spark):
    df = spark.createDataFrame([(0.54, 0), (0.55, 1), (0.65, 1), (0.80, 1), (0.99, 0)], "anomaly_score double, is_anomaly int")
    assert [r.severity for r in scoring.add_severity(df).collect()] == ["none", "low", "medium", "high", "none"]
    assert [r.severity for r in scoring.add_severity(df.drop("is_anomaly")).collect()] == ["none", "low", "medium", "high", "high"]
    with pytest.raises(ValueError):
        SeverityConfig(medium=0.9, high=0.8)
    with pytest.raises(ValueError):
        scoring.add_severity(df.drop("anomaly_score"))


def test_contributions_add_up(spark):
    df = scoring.fuse(signals(spark, (0.8, 0.6, 0.4), (None, 0.6, 0.4), (0.1, None, 0.0), (None, None, 0.3)))
    df = explain.score_breakdown(df)
    for r in df.collect():
        assert sum(c.weighted_contribution for c in r.exp_components) == pytest.approx(r.anomaly_score)
        assert [c.active for c in r.exp_components] == [r.ts_signal is not None, r.if_score is not None, True]


def test_cut_series_score_the_same(spark):
    costs = [100 + (i * 37) % 61 + (400 if i % 50 == 49 else 0) for i in range(300)]
    df = frame(spark, series_rows(costs))
    profile = baseline.fit_profile(df)
    cols = ("forecast_mean", "ts_signal", "rule_score", "anomaly_score", "is_anomaly")
    a = by_bucket(scoring.score_series(df, profile), *cols)
    b = by_bucket(scoring.score_series(df, profile, split=SplitConfig(600, 140)), *cols)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y)


def test_forecast_summary_text(spark):
    df = spark.createDataFrame(
        [(150.0, 100.0, 20.0, 60.8, 139.2), (10.0, 0.0, 1.0, 0.0, 20.0), (5.0, None, None, None, None)],
        "total_cost double, forecast_mean double, forecast_std double, ci_lower_95 double, ci_upper_95 double")
    got = [r.exp_summary for r in explain.explain_forecast(df).collect()]
    assert got[0] == ("Actual total_cost (150.00) is 50.0% above the forecast (100.00), a deviation of 2.5 standard deviations, "
                      "breaching the 95% confidence interval.")
    assert got[1].startswith("Actual total_cost (10.00) is above the forecast (0.00) by 10.00 units")
    assert got[2] == "Forecast data unavailable; actual total_cost was 5.00."
    assert [r.exp_direction for r in explain.explain_forecast(df).collect()] == ["above", "above", "unknown"]


def test_rule_summary_text(spark):
    df = explain.explain_rules(run(spark, [100, 110, 121, 134, 2000]))
    last = df.orderBy(F.col("bucket").desc()).first()
    assert last.exp_rule_triggered_rules == "threshold_breach, sudden_jump, sustained_increase"
    assert last.exp_rule_summary.startswith("3 rules triggered: threshold_breach — Value 2000.00 exceeds budget limit 1000.00 by 100.0%.")
    first = df.orderBy("bucket").first()
    assert first.exp_rule_summary == "No rules triggered."
    assert first.exp_rule_jump_reason == "Insufficient history for sudden-jump evaluation."


def test_payload_json(spark):
    df = frame(spark, series_rows([100.0] * 5 + [400.0]))
    scored = scoring.score_series(df, baseline.fit_profile(df))
    out = explain.explanation_payload(explain.explain_rules(explain.explain_forecast(scored)))
    rows = out.select(explain.payload_json().alias("j"), explain.payload_errors().alias("e")).collect()
    assert all(r.e == [] for r in rows)
    p = json.loads(rows[-1].j)
    assert [c["name"] for c in p["components"]] == ["ts_signal", "if_score", "rule_score"]
    assert p["components"][1]["raw_score"] is None
    assert set(p["rule_explanation"]) == {"threshold_breach", "sudden_jump", "sustained_increase", "triggered_rules", "summary"}
    bare = explain.explanation_payload(scoring.fuse(signals(spark, (0.1, 0.2, 0.3))))
    assert "rule_explanation" not in json.loads(bare.select(explain.payload_json().alias("j")).first().j)
