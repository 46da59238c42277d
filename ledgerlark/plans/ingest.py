"""Queries over sources, sinks and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import csv_io, messages as msg, normalize as norm, tables
from ..operators import baseline
from ..sources.adapters import billing, hourly, raw_records
from . import frames
from .registry import query
from .sql import K, NOW_SQL, with_

# -- decoding and normalisation -----------------------------------------------------


@query("io1_decode_messages", with_(
    """SELECT message_id, CASE WHEN valid = 0 THEN 'payload is not valid JSON.'
       WHEN is_obj = 0 THEN 'Event payload must be a JSON object.' END AS error,
       CASE WHEN is_obj = 1 THEN len(json_keys(j)) END AS n_keys FROM decoded""", "decoded"))
def _(spark, sf):
    df = norm.decode(raw_records(spark, sf))
    return df.select("message_id", "error", F.size(F.map_keys("payload")).alias("n_keys"))


def _normalized(spark, sf):
    return norm.normalize(raw_records(spark, sf))


@query("n1_provider_dispatch", with_(
    """SELECT canonical, prov AS provider_given, coalesce(error, 'accepted') AS outcome, count(*) AS n
       FROM normalized WHERE error NOT LIKE '%JSON%' OR error IS NULL GROUP BY 1, 2, 3""", "normalized"))
def _(spark, sf):
    raw = norm.decode(raw_records(spark, sf)).filter(F.col("error").isNull())
    shape = raw.select(
        "message_id", norm.looks_canonical(F.col("payload")).alias("canonical"),
        F.coalesce(F.lower(F.trim(F.try_element_at("payload", F.lit("provider")))), F.lit("gcp")).alias("provider_given"))
    out = _normalized(spark, sf).select("message_id", F.coalesce("error", F.lit("accepted")).alias("outcome"))
    return shape.join(out, "message_id").groupBy("canonical", "provider_given", "outcome").agg(
        F.count(F.lit(1)).alias("n"))


def _field(name: str, column: str, doubles=()):
    @query(name, with_(f"SELECT message_id, {column} FROM normalized WHERE error IS NULL", "normalized"), doubles)
    def _(spark, sf):
        return _normalized(spark, sf).filter(F.col("error").isNull()).select("message_id", column)


_field("n2_service", "service")
_field("n3_region", "region")
_field("n4_account", "account_id")
_field("n5_timestamp", "timestamp")
_field("n8_cost", "cost_amount", ("cost_amount",))


@query("n6_usage", with_("SELECT message_id, usage_amount, usage_unit FROM normalized WHERE error IS NULL", "normalized"),
       ("usage_amount",))
def _(spark, sf):
    return _normalized(spark, sf).filter(F.col("error").isNull()).select("message_id", "usage_amount", "usage_unit")


@query("n7_labels", with_("SELECT message_id, env FROM normalized WHERE error IS NULL", "normalized"))
def _(spark, sf):
    return _normalized(spark, sf).filter(F.col("error").isNull()).select(
        "message_id", F.try_element_at("tags", F.lit("env")).alias("env"))


@query("n9_canonical_defaults", with_(
    """SELECT message_id, provider, region, usage_amount, usage_unit, source_type FROM normalized
       WHERE error IS NULL AND canonical""", "normalized"), ("usage_amount",))
def _(spark, sf):
    raw = norm.decode(raw_records(spark, sf)).filter(norm.looks_canonical(F.col("payload")))
    return norm.normalize(raw.select("message_id", "value")).filter(F.col("error").isNull()).select(
        "message_id", "provider", "region", "usage_amount", "usage_unit", "source_type")


@query("n10_iso_timestamps", """
  SELECT CAST(event_id AS STRING) AS message_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS plain,
    date_trunc('second', CAST(ts AS TIMESTAMP)) - INTERVAL 330 MINUTE AS with_offset,
    date_trunc('second', CAST(ts AS TIMESTAMP)) AS zulu, date_trunc('day', CAST(ts AS TIMESTAMP)) AS date_only,
    CAST(NULL AS TIMESTAMP) AS malformed FROM events""")
def _(spark, sf):
    from ..functions.exprs import iso_timestamp

    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    compact = F.date_format("timestamp", "yyyyMMdd'T'HHmmss'Z'")
    return billing(spark, sf).select(
        F.col("event_id").alias("message_id"), iso_timestamp(text).alias("plain"),
        iso_timestamp(F.concat(text, F.lit("+05:30"))).alias("with_offset"),
        iso_timestamp(compact).alias("zulu"),
        iso_timestamp(F.date_format("timestamp", "yyyy-MM-dd")).alias("date_only"),
        iso_timestamp(F.concat(text, F.lit(" soon"))).alias("malformed"))


@query("n11_amount_coercion", with_(
    """SELECT message_id, cost, CASE WHEN x_cost IS NULL THEN 'cost_amount is required.'
         WHEN cost IS NULL THEN 'cost_amount must be numeric.' WHEN cost < 0 THEN 'cost_amount must be non-negative.' END AS problem
       FROM typed WHERE is_obj = 1 AND NOT canonical""", "typed"), ("cost",))
def _(spark, sf):
    from ..functions.exprs import number

    df = norm.decode(raw_records(spark, sf)).filter(
        F.col("payload").isNotNull() & ~norm.looks_canonical(F.col("payload")))
    text = F.coalesce(F.try_element_at("payload", F.lit("cost")), F.try_element_at("payload", F.lit("cost_amount")))
    df = df.select("message_id", text.alias("text")).withColumn("cost", number(F.col("text")))
    return df.select("message_id", "cost", norm.amount_error(F.col("text"), F.col("cost"), "cost_amount", True).alias("problem"))


@query("n12_text_coercion", with_(
    """SELECT message_id, nullif(trim(json_extract_string(j, '$.service_description')), '') AS text,
         coalesce(nullif(trim(json_extract_string(j, '$.usage_unit')), ''), 'unit') AS with_default
       FROM decoded WHERE is_obj = 1""", "decoded"))
def _(spark, sf):
    from ..functions.exprs import text_or_null

    df = norm.decode(raw_records(spark, sf)).filter(F.col("payload").isNotNull())
    return df.select(
        "message_id", text_or_null(F.try_element_at("payload", F.lit("service_description"))).alias("text"),
        F.coalesce(text_or_null(F.try_element_at("payload", F.lit("usage_unit"))), F.lit("unit")).alias("with_default"))


@query("n13_tags", with_(
    """SELECT CASE WHEN env IS NULL THEN 0 ELSE CASE WHEN value LIKE '%"team": "data"%' THEN 2 ELSE 1 END END AS n_tags,
         count(*) AS n FROM normalized WHERE error IS NULL GROUP BY 1""", "normalized"))
def _(spark, sf):
    return _normalized(spark, sf).filter(F.col("error").isNull()).groupBy(
        F.when(F.col("tags").isNull(), F.lit(0)).otherwise(F.size(F.map_keys("tags"))).alias("n_tags")).agg(
        F.count(F.lit(1)).alias("n"))


@query("n14_event_ids", with_("SELECT message_id, event_id FROM normalized WHERE error IS NULL", "normalized"))
def _(spark, sf):
    return _normalized(spark, sf).filter(F.col("error").isNull()).select("message_id", "event_id")


@query("n15_required_fields", with_(
    """SELECT message_id, concat_ws(', ',
         CASE WHEN NOT json_exists(j, '$.event_id') THEN 'event_id' END, CASE WHEN NOT json_exists(j, '$.timestamp') THEN 'timestamp' END,
         CASE WHEN NOT json_exists(j, '$.provider') THEN 'provider' END, CASE WHEN NOT json_exists(j, '$.account_id') THEN 'account_id' END,
         CASE WHEN NOT json_exists(j, '$.service') THEN 'service' END, CASE WHEN NOT json_exists(j, '$.region') THEN 'region' END,
         CASE WHEN NOT json_exists(j, '$.cost_amount') THEN 'cost_amount' END, CASE WHEN NOT json_exists(j, '$.usage_amount') THEN 'usage_amount' END,
         CASE WHEN NOT json_exists(j, '$.usage_unit') THEN 'usage_unit' END, CASE WHEN NOT json_exists(j, '$.source_type') THEN 'source_type' END
       ) AS missing FROM decoded WHERE is_obj = 1""", "decoded"))
def _(spark, sf):
    df = norm.decode(raw_records(spark, sf)).filter(F.col("payload").isNotNull())
    return df.select("message_id", norm.missing_required(F.col("payload")).alias("missing"))


@query("n16_ingest_contract", with_(
    f"""SELECT event_id, concat_ws(',', CASE WHEN timestamp > {NOW_SQL} - INTERVAL 3 DAY + INTERVAL 300 SECOND THEN 'timestamp' END,
         CASE WHEN seq % 13 = 0 THEN 'account_id' END, CASE WHEN seq % 7 = 0 THEN 'cost_amount' END,
         CASE WHEN seq % 10 = 0 THEN 'tags' END,
         CASE WHEN source_type NOT IN ('synthetic', 'live') THEN 'source_type' END) AS violations FROM billing""", "billing"))
def _(spark, sf):
    df = billing(spark, sf).withColumns({
        "account_id": F.when(F.col("seq") % 13 == 0, F.lit("  ")).otherwise(F.col("account_id")),
        "cost_amount": F.when(F.col("seq") % 7 == 0, F.col("cost_amount") + F.lit(0.0000004)).otherwise(F.col("cost_amount")),
        "tags": F.when(F.col("seq") % 10 == 0, F.create_map(F.repeat(F.lit("k"), F.lit(65)), F.lit("v"))),
    })
    out = norm.ingest_errors(df, "2024-01-28 00:00:00")
    return out.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("n17_frame_schema", with_(
    """SELECT true AS columns_ok, count(*) FILTER (WHERE cost_amount < 0) AS negative_cost,
         count(*) FILTER (WHERE usage_amount < 0) AS negative_usage FROM normalized WHERE error IS NULL""", "normalized"))
def _(spark, sf):
    return norm.frame_problems(norm.accepted(_normalized(spark, sf)))


@query("normalized_rejections", with_(
    "SELECT coalesce(error, 'accepted') AS outcome, count(*) AS n, count(DISTINCT message_id) AS messages FROM normalized GROUP BY 1",
    "normalized"))
def _(spark, sf):
    return _normalized(spark, sf).groupBy(F.coalesce("error", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("message_id").alias("messages"))


# -- CSV and exports ---------------------------------------------------------------------


@query("io2_csv_load", with_(
    """SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, 'gcp' AS provider, account_id, service, region,
         round(cost_amount, 6) AS cost_amount, round(usage_amount, 6) AS usage_amount, 'units' AS usage_unit
       FROM billing WHERE seq % 9 <> 1 AND seq % 23 <> 5 AND seq % 43 <> 10""", "billing"), ("cost_amount", "usage_amount"))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    _provider_csv(spark, sf).write.csv(path, header=True)
    return csv_io.load_billing_csv(spark, path).accepted().select(
        "timestamp", "provider", "account_id", "service", "region", "cost_amount", "usage_amount", "usage_unit")


def _provider_csv(spark, sf):
    """The billing rows as a provider export, with tax rows and broken rows."""
    return billing(spark, sf).select(
        F.when(F.col("seq") % 23 == 5, F.lit("not a time")).otherwise(
            F.concat(F.replace(F.col("timestamp").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))).alias("Usage_Start_Time"),
        F.col("account_id").alias("project.id"),
        F.concat(F.lit(" "), "service").alias("service.description"),
        F.col("region").alias("location.region"),
        F.when(F.col("seq") % 43 == 10, F.lit("free")).otherwise(F.col("cost_amount").cast("string")).alias("cost"),
        F.col("usage_amount").alias("usage.amount"),
        F.lit(" ").alias("usage.unit"),
        F.when(F.col("seq") % 9 == 1, F.lit("tax")).otherwise(F.lit("Regular")).alias("cost_type"))


@query("io2_csv_load_summary", with_(
    """SELECT count(*) FILTER (WHERE seq % 23 <> 5 AND seq % 43 <> 10) AS accepted,
         count(*) FILTER (WHERE seq % 23 = 5 OR seq % 43 = 10) AS failed, count(*) AS total, least(10,
         count(*) FILTER (WHERE seq % 23 = 5 OR seq % 43 = 10)) AS n_errors FROM billing WHERE seq % 9 <> 1""", "billing"))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    _provider_csv(spark, sf).write.csv(path, header=True)
    s = csv_io.load_billing_csv(spark, path).summary()
    return s.select("accepted", "failed", "total", F.size("errors").alias("n_errors"))


@query("io3_training_export", with_(
    """SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS second, provider, account_id, service, region, cost_amount, usage_amount,
         usage_unit, CASE WHEN source_type = 'training_generated' THEN 'generated' ELSE 'uploaded' END AS source
       FROM billing WHERE source_type IN ('training_generated', 'training_uploaded')""", "billing"),
       ("cost_amount", "usage_amount"))
def _(spark, sf):
    path = scratch_path(spark, "export")
    csv_io.write_csv(csv_io.training_export(billing(spark, sf)), path)
    schema = ("timestamp STRING, provider STRING, account_id STRING, service STRING, region STRING, cost_amount DOUBLE, "
              "usage_amount DOUBLE, usage_unit STRING, source STRING")
    back = spark.read.csv(path, header=True, schema=schema)
    return back.withColumn("second", F.substring("timestamp", 1, 19)).drop("timestamp")


@query("io4_json_lines", with_("SELECT event_id, service, cost_amount, usage_amount FROM billing", "billing"),
       ("cost_amount", "usage_amount"))
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    csv_io.write_json_lines(billing(spark, sf), path)
    return spark.read.schema("event_id STRING, service STRING, cost_amount DOUBLE, usage_amount DOUBLE").json(path)


@query("io5_event_routes", with_(
    """SELECT route, count(*) AS n, count(DISTINCT event_id) AS events FROM (
         SELECT event_id, unnest(['billing-events', 'billing-events.provider.' || provider, 'billing-events.account.' || account_id]) AS route
         FROM normalized WHERE error IS NULL) GROUP BY 1""", "normalized"))
def _(spark, sf):
    routed = msg.route_events(norm.accepted(_normalized(spark, sf)))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))


@query("io5_event_messages", with_("SELECT event_id, service, cost_amount FROM billing", "billing"), ("cost_amount",))
def _(spark, sf):
    routed = msg.route_events(billing(spark, sf), scopes=("global",))
    body = F.from_json("value", "event_id STRING, service STRING, cost_amount DOUBLE")
    return routed.select(body.alias("b")).select("b.*")


# -- dead letters --------------------------------------------------------------------------


def _dead_letters(spark, sf):
    return norm.rejected(_normalized(spark, sf), F.col("arrived_at"))


def _dead_lines(spark, sf):
    """Dead-letter lines as text, every seventh damaged and some incomplete."""
    n = F.col("message_id").cast("long")
    full = F.to_json(F.struct(*msg.DEAD_LETTER_FIELDS), {"ignoreNullFields": "false"})
    partial = F.to_json(F.struct("failed_at", "message_id", "error"), {"ignoreNullFields": "false"})
    return _dead_letters(spark, sf).select(
        F.when(n % 7 == 3, F.lit("{broken")).when(n % 11 == 4, partial).when(n % 13 == 5, F.lit("  ")).otherwise(full).alias("value"))


_KIND = """CASE WHEN CAST(message_id AS BIGINT) % 7 = 3 THEN 'broken' WHEN CAST(message_id AS BIGINT) % 11 = 4 THEN 'partial'
  WHEN CAST(message_id AS BIGINT) % 13 = 5 THEN 'blank' ELSE 'full' END"""


@query("io6_dead_letters", with_(
    """SELECT strftime(arrived_at, '%Y-%m-%dT%H:%M:%S') AS failed_second, 'billing-events' AS stream, message_id, error,
         value AS raw_payload FROM normalized WHERE error IS NOT NULL""", "normalized"))
def _(spark, sf):
    path = scratch_path(spark, "dead-letters")
    msg.write_dead_letters(_dead_letters(spark, sf), path)
    back = spark.read.schema(msg.DEAD_LETTER_SCHEMA).json(path)
    return back.withColumn("failed_second", F.substring("failed_at", 1, 19)).drop("failed_at")


@query("io7_dead_letter_count", with_(
    f"SELECT count(*) AS records FROM normalized WHERE error IS NOT NULL AND {_KIND} <> 'blank'", "normalized"))
def _(spark, sf):
    path = scratch_path(spark, "dead-letters")
    _dead_lines(spark, sf).write.text(path)
    return msg.count_lines(msg.read_lines(spark, path))


@query("io8_dead_letter_tail", with_(
    f"""SELECT message_id, error FROM (SELECT *, {_KIND} AS kind FROM normalized WHERE error IS NOT NULL
        AND {_KIND} NOT IN ('blank', 'broken') ORDER BY arrived_at DESC, message_id DESC LIMIT 50)""", "normalized"))
def _(spark, sf):
    return msg.tail(_dead_lines(spark, sf).filter(F.trim("value") != ""), 50).select("message_id", "error")


@query("io9_dead_letter_validation", with_(
    f"""SELECT message_id, CASE WHEN {_KIND} = 'partial' THEN 'stream,raw_payload' ELSE '' END AS missing FROM normalized
        WHERE error IS NOT NULL AND {_KIND} IN ('full', 'partial')""", "normalized"))
def _(spark, sf):
    return msg.parse_lines(_dead_lines(spark, sf)).select("message_id", "missing")


@query("io10_dead_letter_replay", with_(
    f"""SELECT 'retry' AS stream, error, count(*) AS n FROM normalized
        WHERE error IS NOT NULL AND {_KIND} = 'full' GROUP BY 1, 2""", "normalized"))
def _(spark, sf):
    again = norm.normalize(msg.replay(_dead_lines(spark, sf), stream_override="retry"))
    return again.groupBy("stream", "error").agg(F.count(F.lit(1)).alias("n"))


# -- messages and stored tables ----------------------------------------------------------------


@query("io11_anomaly_messages", with_(
    """SELECT anomaly_id, service, strftime(bucket, '%Y-%m-%dT%H:%M:%S+00:00') AS bucket, anomaly_score, severity, status,
         strftime(detected_at, '%Y-%m-%dT%H:%M:%S+00:00') AS detected_at, true AS keeps_null_breakdown FROM anomalies""", "anomalies"),
       ("anomaly_score",))
def _(spark, sf):
    out = msg.anomaly_messages(frames.anomalies(spark, sf))
    body = F.from_json("value", "service STRING, bucket STRING, anomaly_score DOUBLE, severity STRING, status STRING, detected_at STRING")
    return out.select("anomaly_id", body.alias("b"), F.contains("value", F.lit('"score_breakdown":null')).alias("keeps_null_breakdown")) \
        .select("anomaly_id", "b.*", "keeps_null_breakdown")


def _arrivals_with_copies(spark, sf):
    """Arrivals where a third of all rows carry the same event id."""
    df = frames.arrivals(spark, sf)
    return df.withColumn("event_id", F.when(F.col("seq") % 3 == 0, F.lit("same")).when(
        F.col("seq") % 10 == 1, (F.col("seq") - 1).cast("string")).otherwise(F.col("event_id")))


_COPIES = """SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 'same' WHEN seq % 10 = 1 THEN CAST(seq - 1 AS STRING) ELSE event_id END AS event_id)
  FROM arrivals"""


@query("io12_event_append", with_(
    f"""SELECT event_id, seq, cost_amount FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at, seq) AS rn
        FROM ({_COPIES})) WHERE rn = 1 AND event_id NOT IN (SELECT event_id FROM billing WHERE seq % 5 = 2)""", "arrivals"),
       ("cost_amount",))
def _(spark, sf):
    stored = billing(spark, sf).filter(F.col("seq") % 5 == 2)
    return tables.append_events(stored, _arrivals_with_copies(spark, sf)).select("event_id", "seq", "cost_amount")


@query("io12_append_receipt", with_(
    f"""SELECT count(DISTINCT event_id) AS accepted, count(*) - count(DISTINCT event_id) AS duplicate, count(*) AS total
        FROM ({_COPIES})""", "arrivals"))
def _(spark, sf):
    batch = _arrivals_with_copies(spark, sf)
    return tables.append_receipt(batch, tables.append_events(None, batch))


@query("io13_purge_training", with_(
    """SELECT count(*) FILTER (WHERE source_type LIKE 'training_%') AS events_deleted, 0 AS anomalies_deleted, 0 AS alerts_deleted
       FROM billing""", "billing"))
def _(spark, sf):
    return tables.purge(billing(spark, sf), frames.anomalies(spark, sf), frames.alerts(spark, sf), "training")[1]


@query("io13_purged_events", with_(
    "SELECT source_type, count(*) AS n FROM billing WHERE source_type NOT LIKE 'training_%' GROUP BY 1", "billing"))
def _(spark, sf):
    kept = tables.purge(billing(spark, sf), frames.anomalies(spark, sf), frames.alerts(spark, sf), "training")[0]
    return kept["events"].groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("io13_purge_demo", with_(
    """SELECT (SELECT count(*) FROM billing WHERE source_type = 'synthetic') AS events_deleted,
         (SELECT count(*) FROM anomalies) AS anomalies_deleted, (SELECT count(*) FROM alerts) AS alerts_deleted""",
    "billing", "anomalies", "alerts"))
def _(spark, sf):
    return tables.purge(billing(spark, sf), frames.anomalies(spark, sf), frames.alerts(spark, sf), "demo")[1]


@query("io14_anomaly_upsert", with_(
    f"""SELECT coalesce(t.anomaly_id, i.anomaly_id) AS anomaly_id, bucket, account_id, service, region,
         coalesce(i.anomaly_score, t.anomaly_score) AS anomaly_score, coalesce(i.severity, t.severity) AS severity,
         coalesce(t.status, i.status) AS status, coalesce(t.detected_at, i.detected_at) AS detected_at
       FROM (SELECT * FROM anomalies) t FULL OUTER JOIN (
         SELECT md5(account_id || '|' || service || '|' || region || '|' || CAST(bucket AS STRING)) AS anomaly_id, {K}, bucket,
           round(anomaly_score, 6) AS anomaly_score, severity, 'open' AS status, bucket + INTERVAL 1 HOUR AS detected_at
         FROM rule_scored WHERE is_anomaly = 1) i USING ({K}, bucket)""", "anomalies", "rule_scored"), ("anomaly_score",))
def _(spark, sf):
    fresh = tables.new_anomalies(frames.rule_scored(spark, sf), F.col("bucket") + F.expr("INTERVAL 1 HOUR"))
    return tables.upsert_anomalies(frames.anomalies(spark, sf), fresh).drop("score_breakdown")


# -- model tables ---------------------------------------------------------------------------------


def _registry(spark, sf):
    """Three versions of other settings, each fitted on the whole history."""
    registry = None
    for version, alpha in (("v20240110_000000", 0.2), ("v20240120_000000", 0.3), ("v20240131_000000", 0.4)):
        registry = tables.register_model(registry, baseline.fit_profile(hourly(spark, sf)), version, {"alpha": alpha})
    return registry


_VERSIONS = f"""SELECT v.model_version, h.* FROM hourly h CROSS JOIN (VALUES ('v20240110_000000'), ('v20240120_000000'),
  ('v20240131_000000')) v(model_version)"""


@query("io15_model_table", with_(
    """SELECT hour_of_day, day_of_week, mean, std, n FROM profile""", "profile"), ("mean", "std"))
def _(spark, sf):
    root = scratch_path(spark, "models")
    tables.write_version(frames.profile(spark, sf), root)
    return tables.read_version(spark, root).filter((F.col("hour_of_day") >= 0) & (F.col("n") > 0))


@query("io16_model_versions", with_(
    f"SELECT model_version, count(*) AS train_rows FROM ({_VERSIONS}) GROUP BY 1", "hourly"))
def _(spark, sf):
    return tables.model_versions(_registry(spark, sf))


@query("io16_latest_model", with_(
    f"""SELECT CAST(hour(bucket) AS INTEGER) AS hour_of_day, CAST(isodow(bucket) - 1 AS INTEGER) AS day_of_week, avg(total_cost) AS mean,
         count(*) AS n, 'v20240131_000000' AS model_version FROM ({_VERSIONS}) WHERE model_version = 'v20240131_000000' GROUP BY 1, 2""",
    "hourly"), ("mean",))
def _(spark, sf):
    return tables.load_model(_registry(spark, sf)).filter((F.col("hour_of_day") >= 0) & (F.col("n") > 0)).select(
        "hour_of_day", "day_of_week", "mean", "n", "model_version")


@query("io16_pruned_models", with_(
    f"""SELECT model_version, count(*) AS train_rows FROM ({_VERSIONS}) WHERE model_version > 'v20240110_000000' GROUP BY 1""", "hourly"))
def _(spark, sf):
    return tables.model_versions(tables.prune_models(_registry(spark, sf), 2))


