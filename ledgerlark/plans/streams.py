"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AlertConfig
from ..operators import detectors, features
from ..session import scratch_path
from ..sources import models, tables
from ..sources.adapters import EVENT_COLUMNS, RAW_TEXT, hourly, select_text
from ..streaming import jobs
from . import detector_sql, frames  # noqa: F401  (defines the detectors' oracle text)
from .registry import query
from .sql import K, with_


def _events(spark, sf):
    return jobs.read_parquet_stream(spark, sf, "events.parquet")


def _to_files(df, path: str, checkpoint: str) -> None:
    jobs.run_available(df.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def _as_stream(spark, df, label: str):
    """A batch frame written to files and read back as a stream."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("t1_normalize_stream", with_(
    "SELECT coalesce(error, 'accepted') AS outcome, count(*) AS n FROM normalized GROUP BY 1", "normalized"))
def _(spark, sf):
    root = scratch_path(spark, "normalize-stream")
    raw = select_text(_events(spark, sf), f"CAST(event_id AS STRING) AS message_id, CAST(ts AS TIMESTAMP) AS arrived_at, {RAW_TEXT} AS value")
    jobs.run_available(jobs.normalize_stream(raw, f"{root}/accepted", f"{root}/rejected"), f"{root}/checkpoint")
    good = spark.read.parquet(f"{root}/accepted").select(F.lit("accepted").alias("outcome"))
    bad = spark.read.schema("error STRING").json(f"{root}/rejected").select(F.col("error").alias("outcome"))
    return good.unionAll(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("t2_dedup_stream", with_(
    """SELECT DISTINCT CASE WHEN seq % 3 = 0 THEN 'same' WHEN seq % 10 = 1 THEN CAST(seq - 1 AS STRING) ELSE event_id END AS event_id FROM billing""",
    "billing"))
def _(spark, sf):
    root = scratch_path(spark, "dedup-stream")
    events = select_text(_events(spark, sf), EVENT_COLUMNS)
    copies = events.withColumn("event_id", F.when(F.col("seq") % 3 == 0, F.lit("same")).when(
        F.col("seq") % 10 == 1, (F.col("seq") - 1).cast("string")).otherwise(F.col("event_id")))
    _to_files(jobs.dedup_stream(copies, "60 days").select("event_id"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("t3_rollup_stream", with_(
    f"""SELECT bucket, {K}, total_cost, total_usage, event_count FROM minutely WHERE bucket + INTERVAL 1 MINUTE <=
        (SELECT date_trunc('millisecond', max(timestamp)) FROM billing) - INTERVAL 10 MINUTE""", "minutely"), ("total_cost", "total_usage"))
def _(spark, sf):
    root = scratch_path(spark, "rollup-stream")
    _to_files(jobs.rollup_stream(select_text(_events(spark, sf), EVENT_COLUMNS)), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("t4_score_stream", with_(
    f"SELECT {K}, bucket, ts_signal, rule_score, anomaly_score, is_anomaly, severity FROM scored", "scored"),
       ("ts_signal", "rule_score", "anomaly_score"))
def _(spark, sf):
    jobs.use_rocksdb(spark)
    root = scratch_path(spark, "score-stream")
    stream = _as_stream(spark, hourly(spark, sf), "buckets")
    scored = jobs.score_stream(stream, frames.profile(spark, sf), frames.RULES)
    _to_files(scored.select("account_id", "service", "region", "bucket", "ts_signal", "rule_score", "anomaly_score", "is_anomaly", "severity"),
              f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("t4_score_stream_detector", with_(
    f"SELECT {K}, bucket, ts_signal, if_score, if_anomaly, rule_score, anomaly_score, is_anomaly, severity FROM det_scored", "det_scored"),
       ("ts_signal", "if_score", "rule_score", "anomaly_score"))
def _(spark, sf):
    """The stream scores against a stored detector; values are those of the batch ensemble."""
    jobs.use_rocksdb(spark)
    root = scratch_path(spark, "score-stream")
    df = features.calendar_features(hourly(spark, sf))
    models.save(spark, detectors.fit_reconstruction(df), f"{root}/detectors")
    scored = jobs.score_stream(
        _as_stream(spark, df, "buckets"), frames.profile(spark, sf), frames.RULES, detector=models.load(spark, f"{root}/detectors").transform)
    _to_files(scored.select("account_id", "service", "region", "bucket", "ts_signal", "if_score", "if_anomaly", "rule_score", "anomaly_score",
                            "is_anomaly", "severity"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("t5_cooldown_stream", with_("SELECT anomaly_id, suppressed FROM cooled", "cooled"))
def _(spark, sf):
    jobs.use_rocksdb(spark)
    root = scratch_path(spark, "cooldown-stream")
    cols = ["account_id", "service", "region", "anomaly_id", "detected_at"]
    stream = _as_stream(spark, frames.anomalies(spark, sf).select(*cols), "anomalies")
    out = jobs.cooldown_stream(stream, AlertConfig(cooldown_seconds=7200)).select("anomaly_id", "suppressed")
    _to_files(out, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("t6_publish_stream", with_(
    """SELECT severity, status, count(*) AS n, (SELECT count(*) FROM rule_scored) AS rows_scored,
         (SELECT count(*) FROM rule_scored WHERE is_anomaly = 1) AS events_emitted FROM (
         SELECT severity, 'open' AS status FROM rule_scored WHERE is_anomaly = 1) GROUP BY 1, 2""", "rule_scored"))
def _(spark, sf):
    root = scratch_path(spark, "publish-stream")
    cols = ["account_id", "service", "region", "bucket", "anomaly_score", "is_anomaly", "severity"]
    stream = _as_stream(spark, frames.rule_scored(spark, sf).select(*cols), "scored")
    jobs.run_available(jobs.publish_scored(stream, root), f"{root}/checkpoint")
    one = F.lit(1).alias("_one")
    totals = spark.read.parquet(f"{root}/metrics").agg(
        F.sum("rows_scored").alias("rows_scored"), F.sum("events_emitted").alias("events_emitted")).select("*", one)
    table = tables.read_version(spark, f"{root}/anomalies")
    return table.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n")).select("*", one).join(
        F.broadcast(totals), "_one").drop("_one")


@query("t6_published_rows", with_(
    f"""SELECT md5(account_id || '|' || service || '|' || region || '|' || CAST(bucket AS VARCHAR)) AS anomaly_id, {K}, bucket,
          round(anomaly_score, 6) AS anomaly_score, severity, 'open' AS status FROM rule_scored WHERE is_anomaly = 1""", "rule_scored"),
       ("anomaly_score",))
def _(spark, sf):
    root = scratch_path(spark, "publish-stream")
    cols = ["account_id", "service", "region", "bucket", "anomaly_score", "is_anomaly", "severity"]
    stream = _as_stream(spark, frames.rule_scored(spark, sf).select(*cols), "scored")
    jobs.run_available(jobs.publish_scored(stream, root), f"{root}/checkpoint")
    return tables.read_version(spark, f"{root}/anomalies").select("anomaly_id", *cols[:5], "severity", "status")
