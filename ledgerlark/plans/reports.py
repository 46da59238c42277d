"""Queries over stored anomalies, alerts, audit rows and run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpis, lists, scoring, series
from ..operators.baseline import lookback
from ..sources import tables
from ..sources.adapters import NOW, billing, daily, hourly
from . import frames
from .registry import query
from .sql import K, NOW_SQL, with_

_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_LISTED = "anomaly_id, account_id, service, region, bucket, anomaly_score, severity, status, detected_at"
_LISTED_COLS = [c.strip() for c in _LISTED.split(",")]

# -- lists ---------------------------------------------------------------------------


@query("q1_anomaly_list", with_(
    f"SELECT {_LISTED} FROM anomalies ORDER BY detected_at DESC, anomaly_id LIMIT 50", "anomalies"), ("anomaly_score",))
def _(spark, sf):
    return lists.list_anomalies(frames.anomalies(spark, sf)).select(*_LISTED_COLS)


@query("q1_anomaly_list_filtered", with_(
    f"""SELECT {_LISTED} FROM anomalies WHERE account_id = 'acct-1' AND status = 'open' AND bucket >= TIMESTAMP '2024-01-05 00:00:00'
        AND bucket <= TIMESTAMP '2024-01-25 00:00:00' ORDER BY {_RANK} ASC, anomaly_id LIMIT 20 OFFSET 20""", "anomalies"),
       ("anomaly_score",))
def _(spark, sf):
    return lists.list_anomalies(
        frames.anomalies(spark, sf), sort="severity", order="asc", page=2, size=20, account_id="acct-1", status="open",
        from_bucket="2024-01-05 00:00:00", to_bucket="2024-01-25 00:00:00").select(*_LISTED_COLS)


@query("q1_anomaly_totals", with_(
    """SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM anomalies WHERE severity = 'high'""", "anomalies"))
def _(spark, sf):
    return lists.totals(lists.filter_anomalies(frames.anomalies(spark, sf), severity="high"), 50)


@query("q2_anomaly_by_id", with_(
    f"SELECT {_LISTED} FROM anomalies WHERE anomaly_id = md5('acct-1|view|r0|2024-01-10 11:00:00')", "anomalies"), ("anomaly_score",))
def _(spark, sf):
    wanted = F.md5(F.lit("acct-1|view|r0|2024-01-10 11:00:00"))
    return frames.anomalies(spark, sf).filter(F.col("anomaly_id") == wanted).select(*_LISTED_COLS)


def _updates(spark, sf):
    """Operators acknowledge high anomalies and resolve medium ones; some ask for an unknown state."""
    a = frames.anomalies(spark, sf)
    return a.filter(F.col("severity") != "low").select(
        "anomaly_id",
        F.when(F.col("account_id") == "acct-0", F.lit("closed")).when(F.col("severity") == "high", F.lit("acknowledged"))
        .otherwise(F.lit("resolved")).alias("new_status"),
        F.concat(F.lit("op-"), "region").alias("actor"), (F.col("detected_at") + F.expr("INTERVAL 1 HOUR")).alias("changed_at"))


_NEW_STATUS = """CASE WHEN account_id = 'acct-0' OR severity = 'low' THEN NULL WHEN severity = 'high' THEN 'acknowledged' ELSE 'resolved' END"""


@query("q3_status_change", with_(f"SELECT anomaly_id, severity, coalesce({_NEW_STATUS}, status) AS status FROM anomalies", "anomalies"))
def _(spark, sf):
    return tables.change_status(frames.anomalies(spark, sf), _updates(spark, sf))[0].select("anomaly_id", "severity", "status")


@query("q3_status_audit", with_(
    f"""SELECT 'anomaly' AS event_type, 'status_change' AS action, 'success' AS outcome, 'op-' || region AS user_id, anomaly_id AS target_id,
        '{{"new_status":"' || {_NEW_STATUS} || '"}}' AS meta, detected_at + INTERVAL 1 HOUR AS created_at
        FROM anomalies WHERE {_NEW_STATUS} IS NOT NULL""", "anomalies"))
def _(spark, sf):
    return tables.change_status(frames.anomalies(spark, sf), _updates(spark, sf))[1].drop("audit_id", "target_type")


_ALERT = "alert_id, anomaly_id, account_id, service, region, severity, channel, status, created_at, sent_at, error_detail"


@query("q4_alert_list", with_(
    f"""SELECT {_ALERT} FROM alerts WHERE channel = 'email' AND status = 'sent' ORDER BY created_at DESC, alert_id LIMIT 50""", "alerts"))
def _(spark, sf):
    return lists.list_alerts(frames.alerts(spark, sf), channel="email", status="sent").select(
        *[c.strip() for c in _ALERT.split(",")])


@query("q4_alert_totals", with_(
    "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM alerts WHERE severity = 'medium'", "alerts"))
def _(spark, sf):
    return lists.totals(lists.filter_equal(frames.alerts(spark, sf), {"severity": "medium"}), 50)


@query("q5_alert_search", with_(
    """SELECT alert_id FROM alerts WHERE contains(lower(account_id || ' ' || service || ' ' || region || ' ' || dedup_key), 'purchase r1')""",
    "alerts"))
def _(spark, sf):
    return lists.search_alerts(frames.alerts(spark, sf), "  Purchase R1 ").select("alert_id")


@query("q6_audit_list", with_(
    """SELECT audit_id, event_type, action, outcome, user_id, created_at FROM audit WHERE event_type = 'anomaly' AND outcome = 'failure'
       AND created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'
       ORDER BY created_at DESC, audit_id LIMIT 50""", "audit"))
def _(spark, sf):
    return lists.list_audit(frames.audit(spark, sf), event_type="anomaly", outcome="failure",
                            from_time="2024-01-10 00:00:00", to_time="2024-01-20 00:00:00")


_TRAIN = "source_type IN ('training_generated', 'training_uploaded')"


@query("q7_training_page", with_(
    f"""SELECT event_id, timestamp, provider, account_id, service, region, round(cost_amount, 4) AS cost_amount,
        round(usage_amount, 4) AS usage_amount, usage_unit, CASE WHEN source_type = 'training_generated' THEN 'generated' ELSE 'uploaded' END AS source
        FROM billing WHERE {_TRAIN} ORDER BY timestamp DESC, event_id LIMIT 50 OFFSET 50""", "billing"), ("cost_amount", "usage_amount"))
def _(spark, sf):
    return lists.list_training(billing(spark, sf), "all", page=2)


@query("q7_training_totals", with_(
    "SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM billing WHERE source_type = 'training_uploaded'",
    "billing"))
def _(spark, sf):
    return lists.totals(lists.training_rows(billing(spark, sf), "uploaded"), 50, at_least=1)


@query("q8_lookback", with_(
    f"SELECT account_id, count(*) AS n, min(timestamp) AS earliest FROM billing WHERE timestamp >= {NOW_SQL} - INTERVAL 7 DAY GROUP BY 1", "billing"))
def _(spark, sf):
    return lookback(billing(spark, sf), NOW, 7).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("earliest"))


@query("q9_failed_alerts", with_(
    """SELECT alert_id, anomaly_id, channel, severity, created_at, error_detail FROM alerts WHERE status = 'failed'
       ORDER BY created_at DESC, alert_id LIMIT 50""", "alerts"))
def _(spark, sf):
    return lists.failed_alerts(frames.alerts(spark, sf))


# -- aggregates ------------------------------------------------------------------------

_BUCKET = f"bucket, {K}, total_cost, total_usage, event_count"


@query("a1_bucket_rollup", with_(f"SELECT {_BUCKET} FROM hourly", "hourly"), ("total_cost", "total_usage"))
def _(spark, sf):
    return hourly(spark, sf)


@query("a1_bucket_rollup_minute", with_(f"SELECT {_BUCKET} FROM minutely", "minutely"), ("total_cost", "total_usage"))
def _(spark, sf):
    return series.bucket_rollup(billing(spark, sf), "minute")


@query("a1_bucket_rollup_daily", with_(f"SELECT {_BUCKET} FROM daily", "daily"), ("total_cost", "total_usage"), digits=4)
def _(spark, sf):
    return daily(spark, sf)


@query("a2_training_counts", with_(
    f"""SELECT count(*) FILTER (WHERE source_type = 'training_generated') AS generated,
        count(*) FILTER (WHERE source_type = 'training_uploaded') AS uploaded, count(*) AS total FROM billing WHERE {_TRAIN}""", "billing"))
def _(spark, sf):
    return kpis.training_counts(billing(spark, sf))


@query("a3_kpi_summary", with_(
    f"""SELECT count(*) AS total_anomalies, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_count" for s in ('open', 'acknowledged', 'resolved', 'suppressed'))},
        {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_severity_count" for s in ('high', 'medium', 'low'))},
        count(*) FILTER (WHERE detected_at >= {NOW_SQL} - INTERVAL 24 HOUR) AS anomalies_last_24h FROM anomalies""", "anomalies"))
def _(spark, sf):
    return kpis.kpi_summary(frames.anomalies(spark, sf), NOW)


@query("a4_top_services", with_(
    "SELECT service, count(*) AS count FROM anomalies GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 5", "anomalies"))
def _(spark, sf):
    return kpis.top_counts(frames.anomalies(spark, sf), "service")


@query("a4_top_accounts", with_(
    "SELECT account_id, count(*) AS count FROM anomalies GROUP BY 1 ORDER BY count(*) DESC, account_id LIMIT 5", "anomalies"))
def _(spark, sf):
    return kpis.top_counts(frames.anomalies(spark, sf), "account_id")


_TREND = f"""SELECT CAST(d.day AS DATE) AS day, coalesce(c.n, 0) AS count FROM (
    SELECT unnest(generate_series(DATE '2024-01-31' - 29, DATE '2024-01-31', INTERVAL 1 DAY)) AS day) d LEFT JOIN (
    SELECT CAST(detected_at AS DATE) AS day, count(*) AS n FROM anomalies GROUP BY 1) c ON c.day = CAST(d.day AS DATE)"""


@query("a5_daily_trend", with_(_TREND, "anomalies"))
def _(spark, sf):
    return kpis.daily_trend(frames.anomalies(spark, sf), NOW, 30)


@query("a6_daily_average", with_(f"SELECT round(sum(count) / count(*), 1) AS daily_avg FROM ({_TREND})", "anomalies"), ("daily_avg",))
def _(spark, sf):
    return kpis.daily_average(frames.anomalies(spark, sf), NOW)


@query("a7_time_to_acknowledge", with_(
    f"""SELECT round(lags[greatest(CAST(floor(len(lags) * 0.5) AS INT) - 1, 0) + 1], 1) AS mtt_ack_p50_seconds,
        round(lags[greatest(CAST(floor(len(lags) * 0.95) AS INT) - 1, 0) + 1], 1) AS mtt_ack_p95_seconds FROM (
        SELECT list_sort(list(abs(epoch_us({NOW_SQL}) - epoch_us(detected_at)) / 1e6)) AS lags FROM (
          SELECT detected_at FROM anomalies WHERE status = 'acknowledged' ORDER BY detected_at DESC, anomaly_id LIMIT 200))""", "anomalies"),
       ("mtt_ack_p50_seconds", "mtt_ack_p95_seconds"))
def _(spark, sf):
    return kpis.time_to_acknowledge(frames.anomalies(spark, sf), NOW)


@query("a8_detection_lag_p95", with_(
    f"""SELECT round(quantile_cont(lag, 0.95), 1) AS lag_p95_ms FROM (
        SELECT greatest(0.0, (epoch_us(a.timestamp + INTERVAL 1 SECOND * CAST(CAST(a.usage_amount AS BIGINT) * 37 % 900 AS INT)) - epoch_us(e.ingested_at)) / 1000.0) AS lag
        FROM billing a JOIN arrivals e ON e.account_id = a.account_id AND e.service = a.service AND e.region = a.region AND e.timestamp = a.timestamp
        WHERE a.cost_amount >= 80 AND e.ingested_at > {NOW_SQL} - INTERVAL 7 DAY)""", "billing", "arrivals"), ("lag_p95_ms",))
def _(spark, sf):
    detected = F.col("timestamp") + F.make_dt_interval(secs=F.col("usage_amount").cast("long") * 37 % 900)
    spotted = billing(spark, sf).filter(F.col("cost_amount") >= 80).select(
        "account_id", "service", "region", F.col("timestamp").alias("bucket"), detected.alias("detected_at"))
    return kpis.detection_lag_p95(spotted, frames.arrivals(spark, sf), NOW)


@query("a9_delivery_rates", with_(
    """SELECT *, round(sent / nullif(sent + failed, 0) * 100.0, 1) AS success_rate, round(failed / nullif(sent + failed, 0) * 100.0, 1) AS fail_rate
       FROM (SELECT count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'failed') AS failed,
             count(*) FILTER (WHERE status = 'suppressed') AS suppressed FROM alerts)""", "alerts"), ("success_rate", "fail_rate"))
def _(spark, sf):
    return kpis.delivery_rates(frames.alerts(spark, sf))


@query("a9_dispatch_p95", with_(
    """SELECT list_sort(list(took))[greatest(1, CAST(ceil(count(*) * 0.95) AS INT))] AS dispatch_p95_seconds FROM (
       SELECT (epoch_us(sent_at) - epoch_us(created_at)) / 1e6 AS took FROM alerts) WHERE took > 0""", "alerts"), ("dispatch_p95_seconds",))
def _(spark, sf):
    return kpis.dispatch_p95(frames.alerts(spark, sf))


@query("a10_pending_alerts", with_("SELECT count(*) AS pending FROM alerts WHERE status = 'pending'", "alerts"))
def _(spark, sf):
    return kpis.pending_count(frames.alerts(spark, sf))


# A batch is one hour of buckets; it is recorded one minute after the hour.
_METRICS = """SELECT CAST(bucket AS STRING) AS batch_id, bucket + INTERVAL 1 MINUTE AS batch_at, count(*) AS rows_scored,
  count(*) FILTER (WHERE total_cost >= 150) AS anomalies_detected FROM hourly GROUP BY 1, 2"""


def _metrics(spark, sf):
    rows = hourly(spark, sf).select(
        F.col("bucket").cast("string").alias("batch"), (F.col("bucket") + F.expr("INTERVAL 1 MINUTE")).alias("at"),
        (F.col("total_cost") >= 150).cast("int").alias("is_anomaly"))
    return kpis.batch_metrics(rows, "batch", "at")


@query("a11_run_totals", with_(
    f"""SELECT count(*) AS batches_processed, CAST(sum(rows_scored) AS BIGINT) AS rows_scored, CAST(sum(anomalies_detected) AS BIGINT) AS anomalies_detected,
        0 AS anomalies_persisted, 0 AS events_emitted, max(batch_at) AS last_batch_at, arg_max(rows_scored, batch_at) AS last_batch_rows,
        arg_max(anomalies_detected, batch_at) AS last_batch_anomalies, (SELECT count(*) FROM billing WHERE service = 'error' AND seq % 3 = 0) AS errors_scoring,
        (SELECT count(*) FROM billing WHERE service = 'error' AND seq % 3 = 1) AS errors_persist,
        (SELECT count(*) FROM billing WHERE service = 'error' AND seq % 3 = 2) AS errors_emit FROM ({_METRICS})""", "hourly", "billing"))
def _(spark, sf):
    names = F.array(F.lit("scoring"), F.lit("persist"), F.lit("emit"))
    errors = billing(spark, sf).filter(F.col("service") == "error").select(F.get(names, (F.col("seq") % 3).cast("int")).alias("component"))
    return kpis.run_totals(_metrics(spark, sf), errors)


@query("a12_windowed_rates", with_(
    f"""SELECT batch_id, sum(rows_scored) OVER w / 10800.0 AS rows_scored_per_second,
        sum(anomalies_detected) OVER w / nullif(sum(rows_scored) OVER w, 0) AS anomalies_detected_avg FROM ({_METRICS})
        WINDOW w AS (ORDER BY epoch(batch_at) RANGE BETWEEN 10799 PRECEDING AND CURRENT ROW)""", "hourly"),
       ("rows_scored_per_second", "anomalies_detected_avg"))
def _(spark, sf):
    # batches of this data are an hour apart, so the window is three hours
    return kpis.windowed_rates(
        _metrics(spark, sf), ["rows_scored"], seconds=10_800, sum_col="anomalies_detected", count_col="rows_scored",
    ).select("batch_id", "rows_scored_per_second", "anomalies_detected_avg")


@query("e5_reclassify", with_(
    """SELECT anomaly_id, CASE WHEN anomaly_score >= 0.7 THEN 'high' WHEN anomaly_score >= 0.4 THEN 'medium' ELSE 'low' END AS severity
       FROM anomalies""", "anomalies"))
def _(spark, sf):
    from ..config import ReclassifyConfig

    return scoring.reclassify(frames.anomalies(spark, sf), ReclassifyConfig(medium=0.4, high=0.7)).select("anomaly_id", "severity")
