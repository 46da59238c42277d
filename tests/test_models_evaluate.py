import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import frame, series_rows
from ledgerlark.config import BaselineConfig, CalibrationConfig, ForestConfig, ScoringConfig
from ledgerlark.functions import quantiles
from ledgerlark.operators import baseline, detectors, evaluate, explain, features

CONFUSION = [
    (1, 0.95, 400.0, "a", "spike"), (1, 0.30, 100.0, "a", "budget_breach"), (0, 0.80, 350.0, "b", "normal"),
    (0, 0.10, 50.0, "b", "normal"), (0, 0.45, 70.0, "a", "normal"), (1, 0.51, 220.0, "a", "spike"),
]


@pytest.fixture
def labelled(spark):
    rows = [(str(i), *r[:3], r[3], "s", "r", r[4]) for i, r in enumerate(CONFUSION)]
    return spark.createDataFrame(
        rows, "row_id string, is_anomaly int, anomaly_score double, total_cost double, account_id string, service string, region string, anomaly_type string")


def test_hand_checked_confusion(labelled):
    r = evaluate.metrics_at(labelled, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)
    assert r.precision == r.recall == pytest.approx(0.666667)
    assert evaluate.metrics_at(labelled, 0.99).first().precision == 0.0
    assert evaluate.metrics_at(labelled, 0.99, undefined_precision=1.0).first().precision == 1.0
    assert evaluate.fp_curve(labelled, [0.99]).first().precision is None


def test_top_cases(labelled):
    assert [r.row_id for r in evaluate.top_cases(labelled, 0, True, 0.5).collect()] == ["2"]
    assert [r.row_id for r in evaluate.top_cases(labelled, 0, False, 0.5).collect()] == ["4", "3"]
    assert [r.row_id for r in evaluate.top_cases(labelled, 1, False, 0.5, lowest=True).collect()] == ["1"]


def test_pick_ties(spark):
    sweep = spark.createDataFrame(
        [(0, 0.3, 0.9, 0.1, 0.5), (1, 0.4, 0.5, 0.5, 0.5), (2, 0.5, 0.05, 0.9, 0.2)], "pos int, threshold double, precision double, recall double, f1 double")
    assert evaluate.pick_threshold(sweep).first().threshold == 0.4  # tie: higher
    assert evaluate.pick_threshold(sweep, tie="first").first().threshold == 0.3  # tie: first
    assert evaluate.pick_threshold(sweep, "precision").first().threshold == 0.4  # 0.3 is below the recall floor
    assert evaluate.pick_threshold(sweep, "recall").first().threshold == 0.4  # 0.5 is below the precision floor
    assert evaluate.pick_threshold(sweep, "recall", min_precision=0.99).first().threshold == 0.5  # nothing meets it


def test_missing_scores_count_as_zero(labelled):
    df = labelled.withColumn("anomaly_score", F.when(F.col("row_id") == "0", F.lit(None)).otherwise(F.col("anomaly_score")))
    assert evaluate.metrics_at(df, 0.5).first().tp == 1


def test_zscore_single_row_account(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), ("c", 2.0), ("c", 2.0)], "account_id string, total_cost double")
    got = {(r.account_id, r.total_cost): r.anomaly_score for r in evaluate.zscore_score(df).collect()}
    assert got[("b", 7.0)] == 0.0 and got[("c", 2.0)] == 0.0
    assert got[("a", 3.0)] == pytest.approx(1 / np.sqrt(2) / 5, abs=1e-6)


def test_label_resolution(spark, labelled):
    external = spark.createDataFrame([("0", 0), ("1", 1)], "row_id string, label int")
    got = {r.row_id: r.label for r in evaluate.resolve_labels(labelled, external).collect()}
    assert got["0"] == 0 and got["1"] == 1 and got["2"] is None
    none = spark.createDataFrame([("zz", 1)], "row_id string, label int")
    assert evaluate.label_mode(evaluate.resolve_labels(labelled, none)).first().n_true_anomalies == 3


def test_calibration_config():
    with pytest.raises(ValueError):
        CalibrationConfig(grid=(0.0,))
    with pytest.raises(ValueError):
        CalibrationConfig(metric="auc")


def test_examples_tie_and_gaps(spark):
    df = spark.createDataFrame(
        [("b", 0.9, "spike", 1, ""), ("a", 0.9, "spike", 1, ""), ("c", 0.2, "normal", 0, ""), ("d", 0.1, "normal", 0, "")],
        "row_id string, anomaly_score double, anomaly_type string, is_anomaly int, exp_rule_triggered_rules string")
    got = {r["case"]: r.row_id for r in explain.pick_examples(df).collect()}
    assert got == {"high_confidence_spike": "a", "borderline_normal": "c", "calm_normal": "d"}


@pytest.mark.parametrize("n, accuracy", [(1, 10_000), (7, 10_000), (3000, 200), (5000, 50)])
def test_exact_quantiles(spark, monkeypatch, n, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.34, 5.0, rng.lognormal(2, 2, n)).round(3)  # a third share one value
    df = spark.createDataFrame([(float(v), "g" if i % 3 else "h") for i, v in enumerate(values)], "v double, k string")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "all": 1.0, "none": 0.0}
    r = quantiles.exact_quantiles(df, "v", probs).first()
    for name, p in probs.items():
        assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    c = quantiles.exact_quantiles(df, "v", {"p": 0.95}, how="ceil").first()
    assert c.p == np.sort(values)[max(0, int(np.ceil(round(0.95 * n, 9))) - 1)]
    for row in quantiles.exact_quantiles(df, "v", {"mid": 0.5}, by=["k"]).collect():
        group = [v for i, v in enumerate(values) if ("g" if i % 3 else "h") == row.k]
        assert row.mid == pytest.approx(np.quantile(group, 0.5), rel=1e-12)


def test_profile_fallbacks(spark):
    df = frame(spark, series_rows([10.0, 20.0, 30.0]), series_rows([5.0], account="b", start=__import__("datetime").datetime(2026, 1, 7, 3)))
    p = {(r.hour_of_day, r.day_of_week): r for r in baseline.fit_profile(df).collect()}
    assert len(p) == 169
    assert p[(9, 1)].mean == 20.0 and p[(9, 1)].std == pytest.approx(10.0)
    pooled = p[(-1, -1)]
    assert pooled.n == 4 and pooled.std == pytest.approx(np.std([10, 20, 30, 5], ddof=1))
    assert p[(3, 2)].mean == 5.0 and p[(3, 2)].std == pytest.approx(pooled.std)
    assert (p[(0, 0)].n, p[(0, 0)].mean) == (0, pooled.mean)
    constant = {(r.hour_of_day, r.day_of_week): r for r in baseline.fit_profile(frame(spark, series_rows([4.0, 4.0]))).collect()}
    assert constant[(9, 1)].std == 1e-6 and constant[(-1, -1)].std == 1e-6
    with pytest.raises(ValueError):
        baseline.require_rows(baseline.fit_profile(df), 60)
    with pytest.raises(ValueError):
        BaselineConfig(levels=(1.0,))


def planted(spark, n=400, out=6):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 5, n)
    x[:out] = 400 + np.arange(out)
    return frame(spark, series_rows(x))


def test_forest_finds_planted_rows(spark):
    df = planted(spark)
    model = detectors.fit_forest(df, ForestConfig(trees=60), features=["total_cost", "total_usage"])
    rows = model.transform(df).orderBy(F.col("if_score").desc()).collect()
    assert all(0.0 <= r.if_score <= 1.0 for r in rows)
    assert {r.total_cost > 300 for r in rows[:6]} == {True}
    again = detectors.fit_forest(df, ForestConfig(trees=60), features=["total_cost", "total_usage"])
    assert model.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(again.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    assert model.nodes.groupby("tree").size().max() <= 2 * 256
    with pytest.raises(ValueError):
        detectors.fit_forest(df.limit(10), ForestConfig())


def test_forest_fills_missing_with_median(spark):
    df = planted(spark)
    model = detectors.fit_forest(df, ForestConfig(trees=20), features=["total_cost"])
    assert model.medians["total_cost"] == pytest.approx(df.agg(F.percentile("total_cost", 0.5)).first()[0])
    hole = df.withColumn("total_cost", F.lit(None).cast("double"))
    assert 0 <= model.transform(hole).first().if_score <= 0.5


def test_constant_training_scores_half(spark):
    df = frame(spark, series_rows([5.0] * 80))
    model = detectors.fit_forest(df, ForestConfig(trees=5), features=["total_cost"])
    assert {r.if_score for r in model.transform(df).collect()} == {0.5}


def test_reconstruction(spark):
    df = features.calendar_features(planted(spark))
    model = detectors.fit_reconstruction(df)
    assert "event_count" not in model.features and model.error_hi > model.error_lo
    rows = model.transform(df).collect()
    assert all(0.0 <= r.if_score <= 1.0 for r in rows)
    assert all(r.if_anomaly == int(r.if_score >= 0.6) for r in rows)


def test_feature_selection(spark):
    df = planted(spark).withColumns({"ci_lower_95": F.lit(1.0), "residual": F.lit(1.0)})
    assert detectors.feature_columns(df) == ["total_cost", "total_usage", "event_count"]
    assert detectors.feature_columns(df, ["total_cost", "nope"]) == ["total_cost"]
    with pytest.raises(ValueError):
        detectors.feature_columns(df.select("bucket"))


def test_scoring_weights():
    assert ScoringConfig(enable_if=False).weights()["if_score"] == 0.0
