"""Rows in = rows out, with NULL keys, repeated ids and equal rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import frame, series_rows
from ledgerlark.config import AlertConfig, InjectionConfig
from ledgerlark.operators import alerts, baseline, evaluate, inject, series
from ledgerlark.sources import csv_io, normalize, tables

START = datetime(2024, 1, 1)
SERIES = "bucket timestamp, account_id string, service string, region string, total_cost double, event_id string"


@pytest.fixture(scope="module")
def nullable(spark):
    rows = [(START + timedelta(hours=h), a, "s", None, float(10 + h), f"{a}{h}") for a in ("a", None) for h in range(5)]
    return spark.createDataFrame(rows, SERIES)


def test_positions_and_blocks(nullable):
    placed = series.with_positions(nullable).collect()
    assert len(placed) == 10 and sorted(r["pos"] for r in placed) == sorted(2 * list(range(5)))

    def lagged(df, keys):
        return df.withColumn("before", F.lag("total_cost").over(series.series_window(keys)))

    whole = series.over_series(nullable, lagged, 1)
    cut = series.over_series(nullable, lagged, 1, split=series.SplitConfig(60, 2))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.select(*whole.columns).collect()))


def test_zscore_and_injection(nullable):
    assert evaluate.zscore_score(nullable).count() == 10
    assert inject.inject(nullable, InjectionConfig()).count() == 10


def test_cooldown(nullable):
    got = alerts.cooldown(nullable.withColumnRenamed("bucket", "detected_at"), AlertConfig(), event_id="event_id").collect()
    assert len(got) == 10 and sum(not r["suppressed"] for r in got if r["account_id"] is None) == sum(not r["suppressed"] for r in got if r["account_id"] == "a") > 0


def test_upsert_with_itself(nullable):
    table = nullable.select(
        F.col("event_id").alias("anomaly_id"), "account_id", "service", "region", "bucket", F.lit(0.5).alias("anomaly_score"), F.lit("low").alias("severity"),
        F.lit("{}").alias("score_breakdown"), F.lit("open").alias("status"), F.col("bucket").alias("detected_at"))
    assert tables.upsert_anomalies(table, table).count() == 10
    updates = table.limit(1).select("anomaly_id", F.explode(F.array(F.lit("closed"), F.lit("acknowledged"))).alias("new_status"), F.lit("u").alias("actor"))
    updates = updates.withColumn("changed_at", F.when(F.col("new_status") == "closed", F.lit(START)).otherwise(F.lit(START + timedelta(days=1))))
    known = [s for s in ("closed", "acknowledged") if s in tables.STATUSES]
    after, audit = tables.change_status(table, updates)
    assert after.count() == 10 and audit.count() == len(known)


def test_labels_of_repeated_ids(spark):
    frame = spark.createDataFrame([(1, 0), (2, 0)], "row_id long, is_anomaly int")
    external = spark.createDataFrame([(1, 0), (1, 1)], "row_id long, label int")
    assert {r["row_id"]: r["label"] for r in evaluate.resolve_labels(frame, external).collect()} == {1: 1, 2: None}


def test_mean_fades_over_null(spark):
    rows = [(START + timedelta(hours=h), "a", "s", "r", x) for h, x in enumerate([None, 10.0, None, 10.0, 20.0, None, None, 5.0])]
    df = spark.createDataFrame(rows, "bucket timestamp, account_id string, service string, region string, total_cost double")
    want, mean, gap = [], None, 0
    for *_, x in rows:
        gap += 1
        if x is not None:
            old = 0.7 ** gap
            mean = x if mean is None else (old * mean + 0.3 * x) / (old + 0.3)
            gap = 0
        want.append(mean)
    got = [r["ewma"] for r in baseline.ewma(df, "total_cost", 0.3).orderBy("bucket").collect()]
    assert got[0] is None and got[1:] == pytest.approx(want[1:])


def test_text_after_json_is_rejected(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1} trailing',), ('{"a": 1} {"b": 2}',)], "value string")
    assert sorted((r["payload"] is None, r["error"] is None) for r in normalize.decode(df).collect()) == [(False, True), (True, False), (True, False)]


def test_csv_keeps_equal_rows_and_refuses_other_headers(spark, tmp_path):
    head = "timestamp,account_id,service,region,cost_amount,usage_amount\n"
    row = "2024-01-01T00:00:00Z,a,s,r,1.5,2\n"
    (tmp_path / "one.csv").write_text(head + row * 3)
    rows = csv_io.load_billing_csv(spark, str(tmp_path / "one.csv")).rows
    assert rows.count() == 3 and rows.select("event_id").distinct().count() == 3
    (tmp_path / "two.csv").write_text("timestamp,service,account_id,region,cost_amount,usage_amount\n" + row)
    with pytest.raises(Exception, match="(?i)header"):
        csv_io.load_billing_csv(spark, str(tmp_path)).rows.collect()


def test_unlabelled_frame_is_tuned_unsupervised(spark):
    rows = [(None, i / 100, i / 100) for i in range(100)]
    got = evaluate.recommend(spark.createDataFrame(rows, "is_anomaly int, anomaly_score double, if_score double")).first()
    assert got["method"] == "unsupervised" and got["f1_at_recommended"] is None


def test_ewma_over_null_runs(spark):
    """Alternating, leading and very long runs of NULLs, against the sequential rule; one sort per series."""
    costs = [None, None, 5.0, None, 7.0, None, 9.0] + [None] * 400 + [3.0, 4.0] + [None, 2.0, 8.0] * 60
    alpha, mean, gap, want = 0.3, None, 0, []
    for x in costs:
        gap += 1
        if x is not None:
            old = (1 - alpha) ** gap
            mean = x if mean is None else (old * mean + alpha * x) / (old + alpha)
            gap = 0
        want.append(mean)
    df = baseline.ewma(frame(spark, series_rows(costs)), "total_cost", alpha)
    got = [r["ewma"] for r in df.orderBy("bucket").collect()]
    assert [g is None for g in got] == [w is None for w in want]
    assert max(abs(g - w) for g, w in zip(got, want) if w is not None) < 1e-12
    plan = baseline.ewma(frame(spark, series_rows(costs)), "total_cost", alpha)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_forecasts_of_null_keys_are_merged(spark):
    rows = [r[:3] + (None,) + r[4:] for r in series_rows([1.0, 2.0])]
    df = frame(spark, rows)
    predicted = df.select("bucket", "account_id", "service", "region", F.lit(7.0).alias("forecast_mean"))
    merged = baseline.merge_forecast(df, predicted, ["account_id", "service", "region", "bucket"])
    assert [r.forecast_mean for r in merged.collect()] == [7.0, 7.0]
