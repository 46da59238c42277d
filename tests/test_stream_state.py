"""Keyed stream state: NULL costs, stored detectors, backlogs over the limit, idle series, the table by day."""

import time

import pytest
from pyspark.sql import functions as F

from helpers import START, frame, series_rows
from ledgerlark.config import AlertConfig
from ledgerlark.operators import alerts, baseline, detectors, features, scoring
from ledgerlark.plans import frames
from ledgerlark.sources import day_table, models, tables
from ledgerlark.sources.adapters import hourly
from ledgerlark.streaming import jobs

KEY = ["account_id", "service", "region", "bucket"]
VALUES = ["ts_signal", "if_score", "rule_score", "jump_score", "sustained_score", "anomaly_score", "is_anomaly", "severity"]


def written(spark, df, path, files=1):
    df.repartitionByRange(files, "bucket").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ran(stream, tmp_path, spark):
    jobs.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


def rounded(df, cols):
    kinds = dict(df.dtypes)
    rows = df.select(*[F.round(c, 9).alias(c) if kinds[c] == "double" else c for c in cols]).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_null_costs_and_detector_as_in_batch(spark, tmp_path):
    costs = [100, 120, None, 90, 300, None, None, 80, 0, 50, 55, 60, 70, None, 500] * 8
    costs[0] = None
    df = features.calendar_features(frame(spark, series_rows(costs), series_rows([None, None, 5, 6, 7], account="b")))
    models.save(spark, detectors.fit_reconstruction(df), str(tmp_path / "models"))
    model, profile = models.load(spark, str(tmp_path / "models")), baseline.fit_profile(df)
    got = ran(jobs.score_stream(written(spark, df, str(tmp_path / "in"), 3), profile, frames.RULES, detector=model.transform), tmp_path, spark)
    want = scoring.score_series(df, profile, model.transform, rules=frames.RULES)
    assert rounded(got, KEY + VALUES) == rounded(want, KEY + VALUES)


def test_backlog_over_the_limit_gives_the_same(spark, tmp_path):
    df = frame(spark, series_rows([(i * 37) % 101 for i in range(700)])).orderBy(F.rand(3))
    profile = baseline.fit_profile(df)
    state = jobs.StateConfig(row_limit=50, segment_seconds=3600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = ran(jobs.score_stream(written(spark, df, str(tmp_path / "in")), profile, frames.RULES, state=state), tmp_path, spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = scoring.score_series(df, profile, rules=frames.RULES)
    assert rounded(got, KEY + VALUES) == rounded(want, KEY + VALUES)


def test_cooldown_backlog(spark, sf, tmp_path):
    df = frames.anomalies(spark, sf).select("account_id", "service", "region", "anomaly_id", "detected_at", "bucket")
    cfg = AlertConfig(cooldown_seconds=7200)
    out = jobs.cooldown_stream(written(spark, df, str(tmp_path / "in")), cfg, state=jobs.StateConfig(row_limit=3, segment_seconds=86_400))
    assert rounded(ran(out, tmp_path, spark), ["anomaly_id", "suppressed"]) == rounded(alerts.cooldown(df, cfg), ["anomaly_id", "suppressed"])
    with pytest.raises(ValueError):
        jobs.cooldown_stream(df, cfg, state=jobs.StateConfig(idle_seconds=60))


def test_state_of_an_idle_series_goes(spark, tmp_path):
    """The running mean starts anew once the series was idle for too long, and goes on if it was not."""
    rows = frame(spark, series_rows([100.0, 100.0, 200.0]))
    profile = baseline.fit_profile(rows)
    for idle, fresh in ((2, True), (600, False)):
        path, cp, out = (str(tmp_path / f"{n}{idle}") for n in ("in", "cp", "out"))
        rows.filter(F.col("total_cost") < 200).coalesce(1).write.parquet(path)
        scored = jobs.score_stream(spark.readStream.schema(rows.schema).parquet(path), profile, state=jobs.StateConfig(idle_seconds=idle))
        q = scored.select("bucket", "total_cost", "jump_mean").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", cp).trigger(processingTime="500 milliseconds").start()
        try:
            deadline = time.time() + 40
            while time.time() < deadline and not any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(0.2)
            time.sleep(4)
            rows.filter(F.col("total_cost") == 200).coalesce(1).write.mode("append").parquet(path)
            while time.time() < deadline and sum(p["numInputRows"] for p in q.recentProgress) < 3:
                time.sleep(0.2)
            time.sleep(1)
        finally:
            q.stop()
        last = spark.read.parquet(out).filter("total_cost = 200").first()
        assert last is not None and last.jump_mean == (None if fresh else 100.0)


SCHEMA = "account_id string, service string, region string, bucket timestamp, anomaly_score double, is_anomaly int, severity string"


def scored_rows(spark, *rows):
    return spark.createDataFrame([(a, "s", "r", START.replace(day=d) if d else None, x, 1, "high") for a, d, x in rows], SCHEMA)


def test_a_batch_writes_only_touched_days(spark, tmp_path):
    root = str(tmp_path / "t")
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")

    def put(tag, *rows, keep=3):
        return day_table.merge(spark, root, tag, tables.new_anomalies(scored_rows(spark, *rows), now), "bucket", tables.upsert_anomalies, keep)

    assert put("v1", ("a", 5, 0.9), ("a", 6, 0.8), (None, None, 0.7)) == ["2026-01-05", "2026-01-06", "none"]
    first = day_table.manifest(spark, root, "v1")["days"]
    assert put("v2", ("a", 6, 0.6), ("b", 6, 0.6)) == ["2026-01-06"]
    second = day_table.manifest(spark, root, "v2")["days"]
    assert {d for d in second if second[d] != first.get(d)} == {"2026-01-06"}
    assert [p.name for p in (tmp_path / "t" / second["2026-01-06"]).parent.iterdir() if p.name.startswith("day=")] == ["day=2026-01-06"]
    assert put("v2", ("a", 5, 0.1)) == [] and put("v1", ("a", 5, 0.1)) == []  # replayed
    assert rounded(tables.read_version(spark, root), ["account_id", "anomaly_score"]) == sorted(
        [("a", 0.9), ("a", 0.6), ("b", 0.6), (None, 0.7)], key=str)
    assert rounded(tables.read_version(spark, root, "v1"), ["anomaly_score"]) == [(0.7,), (0.8,), (0.9,)]
    assert put("v3", (None, None, 0.5)) == ["none"] and tables.read_version(spark, root).count() == 4
    assert put("v4", keep=2) == []
    assert tables.list_versions(spark, root) == ["v3", "v4"]
    assert not (tmp_path / "t" / first["2026-01-06"]).exists() and (tmp_path / "t" / first["2026-01-05"]).exists()
    assert tables.read_version(spark, root, "v3").count() == 4


def test_published_null_keys_have_messages(spark, tmp_path):
    rows = scored_rows(spark, ("a", 5, 0.9), (None, 5, 0.8), ("r", None, 0.7))
    out = jobs.publish_scored(written(spark, rows, str(tmp_path / "in")), str(tmp_path / "pub"))
    jobs.run_available(out, str(tmp_path / "cp"))
    stats = spark.read.parquet(str(tmp_path / "pub" / "metrics")).agg(F.sum("rows_scored"), F.sum("anomalies_detected"), F.sum("events_emitted")).first()
    assert tuple(stats) == (3, 3, 3)
    assert spark.read.text(str(tmp_path / "pub" / "messages")).count() == 3


def test_anomaly_ids_tell_keys_apart(spark):
    rows = spark.createDataFrame(
        [("a", None, "r"), ("a", "r", None), (None, "a", "r"), ("a|r", "x", "y"), ("a", "r|x", "y"), ("a", "r", "x")],
        "account_id string, service string, region string")
    rows = rows.withColumns({"bucket": F.lit(START), "anomaly_score": F.lit(0.9), "is_anomaly": F.lit(1)})
    got = tables.new_anomalies(rows, F.current_timestamp())
    assert got.select("anomaly_id").distinct().count() == 6


def test_replays_of_hourly_batches(spark, sf, tmp_path):
    cols = ["account_id", "service", "region", "bucket", "anomaly_score", "is_anomaly", "severity"]
    scored = frames.rule_scored(spark, sf).select(*cols)
    assert hourly(spark, sf).count() == scored.count()
    for run in ("cp1", "cp2"):
        jobs.run_available(jobs.publish_scored(written(spark, scored, str(tmp_path / f"in{run}"), 7), str(tmp_path / "pub"), keep=2), str(tmp_path / run))
    table = tables.read_version(spark, str(tmp_path / "pub" / "anomalies"))
    assert table.count() == scored.filter("is_anomaly = 1").count() == table.select("anomaly_id").distinct().count()
    assert len(tables.list_versions(spark, str(tmp_path / "pub" / "anomalies"))) == 2
