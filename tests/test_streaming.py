"""Streams give the batch result whatever the micro-batch boundaries are."""

from pyspark.sql import functions as F

from ledgerlark.config import AlertConfig
from ledgerlark.operators import alerts, baseline, scoring
from ledgerlark.plans import frames
from ledgerlark.sources import tables
from ledgerlark.sources.adapters import hourly
from ledgerlark.streaming import jobs


def in_files(df, path, column, cuts):
    """Write ``df`` as one file per time range, oldest first."""
    edges = [None, *cuts, None]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = df
        part = part.filter(F.col(column) >= F.lit(lo).cast("timestamp")) if lo else part
        part = part.filter(F.col(column) < F.lit(hi).cast("timestamp")) if hi else part
        part.coalesce(1).write.parquet(f"{path}/part={i}")


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


CUTS = ["2024-01-08 00:00:00", "2024-01-15 06:00:00", "2024-01-22 00:00:00"]


def test_scoring_over_micro_batches(spark, sf, tmp_path):
    df = hourly(spark, sf)
    profile = baseline.fit_profile(df)
    in_files(df, str(tmp_path / "in"), "bucket", CUTS)
    out = jobs.score_stream(stream_of(spark, df, str(tmp_path / "in")), profile, frames.RULES)
    cols = ["account_id", "service", "region", "bucket", "ts_signal", "rule_score", "anomaly_score", "is_anomaly", "severity"]
    q = jobs.run_available(
        out.select(*cols).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    assert len({p["batchId"] for p in q.recentProgress}) >= 4
    want = scoring.score_series(df, profile, rules=frames.RULES).select(*cols)
    key = cols[:4]
    both = spark.read.parquet(str(tmp_path / "out")).join(want.select(*key, *[F.col(c).alias(f"w_{c}") for c in cols[4:]]), key, "full")
    bad = both.filter(
        (F.abs(F.col("anomaly_score") - F.col("w_anomaly_score")) > 1e-9) | F.col("anomaly_score").isNull() | F.col("w_anomaly_score").isNull()
        | (F.col("is_anomaly") != F.col("w_is_anomaly")) | (F.col("severity") != F.col("w_severity")))
    assert bad.count() == 0


def test_cooldown_over_micro_batches(spark, sf, tmp_path):
    df = frames.anomalies(spark, sf).select("account_id", "service", "region", "anomaly_id", "detected_at")
    in_files(df, str(tmp_path / "in"), "detected_at", CUTS)
    out = jobs.cooldown_stream(stream_of(spark, df, str(tmp_path / "in")), AlertConfig(cooldown_seconds=7200))
    jobs.run_available(out.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    got = {r.anomaly_id: r.suppressed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.anomaly_id: r.suppressed for r in alerts.cooldown(df, AlertConfig(cooldown_seconds=7200)).collect()}
    assert got == want


def test_publishing_is_idempotent(spark, sf, tmp_path):
    cols = ["account_id", "service", "region", "bucket", "anomaly_score", "is_anomaly", "severity"]
    scored = frames.rule_scored(spark, sf).select(*cols)
    in_files(scored, str(tmp_path / "in"), "bucket", CUTS)
    root = str(tmp_path / "pub")
    for run in ("cp1", "cp2"):  # the second run replays every batch id
        stream = stream_of(spark, scored, str(tmp_path / "in"))
        jobs.run_available(jobs.publish_scored(stream, root), str(tmp_path / run))
    table = tables.read_version(spark, f"{root}/anomalies")
    want = scored.filter("is_anomaly = 1").count()
    assert table.count() == want == table.select("anomaly_id").distinct().count()
    stats = spark.read.parquet(f"{root}/metrics").agg(F.sum("rows_scored"), F.sum("events_emitted")).first()
    assert tuple(stats) == (scored.count(), want)
