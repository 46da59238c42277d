"""Shared oracle text: common table expressions over the registered tables."""

from __future__ import annotations

from ..sources.adapters import DAILY_COLUMNS, EVENT_COLUMNS, NOW, RAW_TEXT

K = "account_id, service, region"
PART = f"PARTITION BY {K} ORDER BY bucket"
NOW_SQL = f"TIMESTAMP '{NOW}'"

# Rule limits scaled to the test data (the library defaults suit real bills).
BUDGET_LIMIT = 150.0

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *deps: str) -> None:
    CTES[name] = (deps, text)


def with_(body: str, *names: str) -> str:
    """``WITH`` the named expressions and everything they need."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in CTES[n][0]:
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + body


cte("billing", f"SELECT {EVENT_COLUMNS} FROM events")
cte("hourly", f"""SELECT date_trunc('hour', timestamp) AS bucket, {K},
  round(sum(cost_amount), 6) AS total_cost, round(sum(usage_amount), 6) AS total_usage, count(*) AS event_count
  FROM billing GROUP BY 1, 2, 3, 4""", "billing")
cte("daily", f"""SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS bucket, {K},
  round(sum(cost_amount), 6) AS total_cost, round(sum(usage_amount), 6) AS total_usage, count(*) AS event_count
  FROM (SELECT {DAILY_COLUMNS} FROM lineitem) GROUP BY 1, 2, 3, 4""")
cte("minutely", f"""SELECT date_trunc('minute', timestamp) AS bucket, {K},
  round(sum(cost_amount), 6) AS total_cost, round(sum(usage_amount), 6) AS total_usage, count(*) AS event_count
  FROM billing GROUP BY 1, 2, 3, 4""", "billing")


def rules_cte(name: str, src: str, limit: float = BUDGET_LIMIT) -> None:
    """Rule flags and scores of a bucketed series, default jump and growth parameters."""
    cte(f"{name}_lags", f"""SELECT *, avg(total_cost) OVER ({PART} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS jump_mean,
      lag(total_cost) OVER ({PART}) AS prev, row_number() OVER ({PART}) AS rn FROM {src}""", src)
    cte(f"{name}_steps", f"""SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN prev = 0 THEN CASE WHEN total_cost > 0 THEN 1 ELSE 0 END
      WHEN (total_cost - prev) / abs(prev) >= CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END AS grew,
      (total_cost - jump_mean) / nullif(jump_mean, 0) AS jump_pct FROM {name}_lags""", f"{name}_lags")
    cte(f"{name}_flags", f"""SELECT *, sum(grew) OVER ({PART} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS passing,
      CASE WHEN total_cost > {limit} THEN 1 ELSE 0 END AS threshold_fired,
      CASE WHEN total_cost > {limit} THEN least((total_cost - {limit}) / CAST({limit} AS DOUBLE), 1.0) ELSE 0.0 END AS threshold_score,
      CASE WHEN jump_mean IS NULL THEN 0 WHEN jump_mean = 0 THEN CASE WHEN total_cost > 0 THEN 1 ELSE 0 END
           WHEN jump_pct > 0.5 THEN 1 ELSE 0 END AS jump_fired,
      CASE WHEN jump_mean IS NULL THEN 0.0 WHEN jump_mean = 0 THEN CASE WHEN total_cost > 0 THEN 1.0 ELSE 0.0 END
           WHEN jump_pct > 0.5 THEN least((jump_pct - 0.5) / CAST(0.5 AS DOUBLE), 1.0) ELSE 0.0 END AS jump_score
      FROM {name}_steps""", f"{name}_steps")
    cte(name, f"""SELECT *, CASE WHEN rn >= 4 AND passing = 3 THEN 1 ELSE 0 END AS sustained_fired,
      CASE WHEN rn >= 4 THEN passing / CAST(3 AS DOUBLE) ELSE 0.0 END AS sustained_score,
      CAST(0.5 AS DOUBLE) * threshold_score + CAST(0.3 AS DOUBLE) * jump_score
        + CAST(0.2 AS DOUBLE) * CASE WHEN rn >= 4 THEN passing / CAST(3 AS DOUBLE) ELSE 0.0 END AS rule_score
      FROM {name}_flags""", f"{name}_flags")


def profile_cte(name: str, src: str) -> None:
    """Seasonal profile with its pooled statistics on every row."""
    cte(f"{name}_pooled", f"""SELECT avg(total_cost) AS gm,
      CASE WHEN stddev_samp(total_cost) > abs(avg(total_cost)) * 1e-12 THEN stddev_samp(total_cost) ELSE 1e-6 END AS gs,
      count(*) AS gn FROM {src}""", src)
    cte(name, f"""SELECT CAST(hour(bucket) AS INTEGER) AS hour_of_day, CAST(isodow(bucket) - 1 AS INTEGER) AS day_of_week,
      avg(total_cost) AS mean,
      CASE WHEN count(*) < 2 THEN max(gs) WHEN stddev_samp(total_cost) > abs(avg(total_cost)) * 1e-12
           THEN stddev_samp(total_cost) ELSE 1e-6 END AS std, count(*) AS n
      FROM {src}, {name}_pooled GROUP BY 1, 2""", src, f"{name}_pooled")


def forecast_cte(name: str, src: str, profile: str) -> None:
    """Forecast, band and residual columns; the running mean in closed form."""
    cte(f"{name}_pos", f"SELECT *, row_number() OVER ({PART}) - 1 AS fpos FROM {src}", src)
    cte(f"{name}_ewma", f"""SELECT *, pow(CAST(0.7 AS DOUBLE), fpos) * sum(CASE WHEN fpos = 0 THEN total_cost
      ELSE CAST(0.3 AS DOUBLE) * total_cost * pow(CAST(0.7 AS DOUBLE), -fpos) END) OVER ({PART}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ewma FROM {name}_pos""", f"{name}_pos")
    cte(f"{name}_mean", f"""SELECT s.*, 0.6 * coalesce(p.mean, g.gm) + 0.4 * s.ewma AS forecast_mean,
      greatest(coalesce(p.std, g.gs) * 0.72, 1e-6) AS forecast_std
      FROM {name}_ewma s LEFT JOIN {profile} p ON p.hour_of_day = hour(s.bucket) AND p.day_of_week = isodow(s.bucket) - 1
      CROSS JOIN {profile}_pooled g""", f"{name}_ewma", profile)
    cte(name, f"""SELECT *, greatest(0.0, forecast_mean - 1.959963984540054 * forecast_std) AS ci_lower_95,
      forecast_mean + 1.959963984540054 * forecast_std AS ci_upper_95, total_cost - forecast_mean AS residual,
      greatest(-10.0, least(10.0, (total_cost - forecast_mean) / greatest(forecast_std, 1e-9))) AS z_score
      FROM {name}_mean""", f"{name}_mean")


def fused_cte(name: str, src: str, ts: str = "ts_signal", det: str = "if_score", rule: str = "rule_score") -> None:
    """Fused score, decision and severity; a NULL signal drops out."""
    def total(v: str, w: str) -> str:
        return f"coalesce(CAST({w} AS DOUBLE) * {v}, 0.0)"

    def weight(v: str, w: str) -> str:
        return f"CASE WHEN {v} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0.0 END"

    sig = ((ts, "0.35"), (det, "0.40"), (rule, "0.25"))
    cte(f"{name}_sum", f"""SELECT *, {' + '.join(total(v, w) for v, w in sig)} AS tot,
      {' + '.join(weight(v, w) for v, w in sig)} AS wsum FROM {src}""", src)
    cte(f"{name}_dec", f"""SELECT *, CASE WHEN wsum > 0 THEN tot / nullif(wsum, 0) ELSE 0.0 END AS anomaly_score,
      CASE WHEN wsum > 0 AND tot / nullif(wsum, 0) >= CAST(0.55 AS DOUBLE) THEN 1 ELSE 0 END AS is_anomaly
      FROM {name}_sum""", f"{name}_sum")
    cte(name, f"""SELECT *, CASE WHEN is_anomaly = 0 THEN 'none' WHEN anomaly_score >= CAST(0.80 AS DOUBLE) THEN 'high'
      WHEN anomaly_score >= CAST(0.65 AS DOUBLE) THEN 'medium' ELSE 'low' END AS severity FROM {name}_dec""", f"{name}_dec")


profile_cte("profile", "hourly")
rules_cte("ruled", "hourly")
forecast_cte("forecasted", "hourly", "profile")
rules_cte("fruled", "forecasted")
cte("signals", """SELECT *, least(abs(z_score), 10.0) / 10.0 AS ts_signal, CAST(NULL AS DOUBLE) AS if_score
  FROM fruled""", "fruled")
fused_cte("scored", "signals")
cte("rule_signals", """SELECT *, CAST(NULL AS DOUBLE) AS ts_signal, CAST(NULL AS DOUBLE) AS if_score FROM ruled""", "ruled")
fused_cte("rule_scored", "rule_signals")

# -- stored tables derived from the buckets ------------------------------------------

ANOMALY_COLUMNS = """
  md5(account_id || '|' || service || '|' || region || '|' || CAST(bucket AS STRING)) AS anomaly_id,
  account_id, service, region, bucket,
  round(least(total_cost / 400, 1.0), 6) AS anomaly_score,
  CASE WHEN total_cost >= 250 THEN 'high' WHEN total_cost >= 160 THEN 'medium' ELSE 'low' END AS severity,
  CAST(NULL AS STRING) AS score_breakdown,
  CASE CAST(total_usage AS BIGINT) % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'resolved' WHEN 2 THEN 'suppressed' ELSE 'open' END AS status,
  bucket + INTERVAL 1 MINUTE * CAST(CAST(total_usage AS BIGINT) * 37 % 120 AS INT) AS detected_at
"""
ANOMALY_FILTER = "total_cost >= 80"
cte("anomalies", f"SELECT {ANOMALY_COLUMNS} FROM hourly WHERE {ANOMALY_FILTER}", "hourly")

ALERT_COLUMNS = """
  md5(anomaly_id || ':' || channel) AS alert_id, anomaly_id, account_id, service, region, severity, channel,
  CASE (minute(detected_at) + length(channel)) % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'suppressed' WHEN 2 THEN 'pending' ELSE 'sent' END AS status,
  anomaly_id || ':' || channel AS dedup_key,
  detected_at + INTERVAL 5 SECOND AS created_at,
  CASE WHEN (minute(detected_at) + length(channel)) % 7 > 2
    THEN detected_at + INTERVAL 1 SECOND * CAST(4 + minute(detected_at) % 50 AS INT) END AS sent_at,
  CASE WHEN (minute(detected_at) + length(channel)) % 7 = 0 THEN 'delivery refused' END AS error_detail
"""
cte("alerts", f"""SELECT {ALERT_COLUMNS} FROM
  (SELECT a.*, c.channel FROM anomalies a, (VALUES ('in_app'), ('email')) c(channel))""", "anomalies")

AUDIT_COLUMNS = """
  md5('audit' || CAST(event_id AS STRING)) AS audit_id,
  CASE event_type WHEN 'signup' THEN 'user' WHEN 'error' THEN 'auth' ELSE 'anomaly' END AS event_type,
  CASE event_id % 3 WHEN 0 THEN 'login' WHEN 1 THEN 'status_change' ELSE 'export' END AS action,
  CASE WHEN event_id % 10 = 0 THEN 'failure' ELSE 'success' END AS outcome,
  'u' || CAST(user_id AS STRING) AS user_id, CAST(ts AS TIMESTAMP) AS created_at
"""
cte("audit", f"SELECT {AUDIT_COLUMNS} FROM events")
cte("arrivals", """SELECT *, timestamp + INTERVAL 1 SECOND * CAST(seq * 7919 % 600 AS INT) AS ingested_at FROM billing""", "billing")

# -- normalised raw records -------------------------------------------------------------

cte("messages", f"SELECT CAST(event_id AS STRING) AS message_id, CAST(ts AS TIMESTAMP) AS arrived_at, {RAW_TEXT} AS value FROM events")
cte("decoded", """SELECT *, CASE WHEN json_valid(value) THEN 1 ELSE 0 END AS valid,
  CASE WHEN json_valid(value) THEN CASE WHEN json_type(CAST(value AS JSON)) = 'OBJECT' THEN 1 ELSE 0 END ELSE 0 END AS is_obj,
  CASE WHEN json_valid(value) THEN CASE WHEN json_type(CAST(value AS JSON)) = 'OBJECT' THEN CAST(value AS JSON) ELSE CAST('{}' AS JSON) END
       ELSE CAST('{}' AS JSON) END AS j FROM messages""", "messages")


def _j(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


def _blank(e: str) -> str:
    return f"nullif(trim({e}), '')"


cte("fields", f"""SELECT *,
  json_exists(j, '$.event_id') AND json_exists(j, '$.timestamp') AND json_exists(j, '$.provider') AND json_exists(j, '$.account_id')
    AND json_exists(j, '$.service') AND json_exists(j, '$.region') AND json_exists(j, '$.cost_amount')
    AND json_exists(j, '$.usage_amount') AND json_exists(j, '$.usage_unit') AND json_exists(j, '$.source_type') AS canonical,
  coalesce(lower(trim(nullif({_j('provider')}, ''))), 'gcp') AS prov,
  json_type(j, '$.service') AS service_type, json_type(j, '$.labels') AS label_type
  FROM decoded""", "decoded")
cte("found", f"""SELECT *,
  CASE WHEN canonical THEN {_j('timestamp')} ELSE coalesce({_j('usage_start_time')}, {_j('export_time')}, {_j('timestamp')}) END AS x_ts,
  CASE WHEN canonical THEN {_blank(_j('account_id'))} ELSE coalesce({_blank(_j('billing_account_id'))}, {_blank(_j('account_id'))},
    {_blank(_j('project.id'))}, {_blank(_j('project_id'))}) END AS x_account,
  CASE WHEN canonical THEN {_blank(_j('service'))} ELSE coalesce({_blank(_j('service.description'))}, {_blank(_j('service_description'))},
    CASE WHEN service_type <> 'OBJECT' THEN {_blank(_j('service'))} END) END AS x_service,
  CASE WHEN canonical THEN coalesce({_blank(_j('region'))}, 'global') ELSE coalesce(
    {_blank('coalesce(nullif(' + _j('location.region') + ", ''), " + _j('location.location') + ')')},
    {_blank(_j('location_region'))}, {_blank(_j('region'))}, 'global') END AS x_region,
  CASE WHEN canonical THEN {_j('cost_amount')} ELSE coalesce({_j('cost')}, {_j('cost_amount')}) END AS x_cost,
  CASE WHEN canonical OR json_type(j, '$.usage') IS DISTINCT FROM 'OBJECT' THEN {_j('usage_amount')} ELSE {_j('usage.amount')} END AS x_usage,
  CASE WHEN canonical OR json_type(j, '$.usage') IS DISTINCT FROM 'OBJECT' THEN {_j('usage_unit')} ELSE {_j('usage.unit')} END AS x_unit,
  CASE WHEN canonical THEN {_j('tags.env')} WHEN label_type = 'OBJECT' THEN {_j('labels.env')}
       WHEN label_type = 'ARRAY' THEN json_extract_string(j, '$.labels[1].value') END AS x_env
  FROM fields""", "fields")
cte("typed", """SELECT *, TRY_CAST(x_cost AS DOUBLE) AS cost, TRY_CAST(x_usage AS DOUBLE) AS usage,
  CASE WHEN x_ts LIKE '%+02:00' THEN TRY_CAST(replace(x_ts, '+02:00', '') AS TIMESTAMP) - INTERVAL 2 HOUR
       ELSE TRY_CAST(replace(x_ts, 'Z', '') AS TIMESTAMP) END AS ts FROM found""", "found")
_E_TS = """CASE WHEN x_ts IS NULL THEN 'timestamp is required.' WHEN trim(x_ts) = '' THEN 'timestamp must not be empty.'
  WHEN ts IS NULL THEN 'timestamp must be a valid ISO-8601 value.' END"""
_E_COST = """CASE WHEN x_cost IS NULL THEN 'cost_amount is required.' WHEN cost IS NULL THEN 'cost_amount must be numeric.'
  WHEN cost < 0 THEN 'cost_amount must be non-negative.' END"""
_E_USAGE = """CASE WHEN x_usage IS NOT NULL AND usage IS NULL THEN 'usage_amount must be numeric.'
  WHEN usage < 0 THEN 'usage_amount must be non-negative.' END"""
_E_ACC = "CASE WHEN x_account IS NULL THEN 'account_id is required.' END"
_E_SVC = "CASE WHEN x_service IS NULL THEN 'service is required.' END"
_E_TAGS = "CASE WHEN NOT canonical AND label_type NOT IN ('OBJECT', 'ARRAY') THEN 'tags must be a key-value mapping.' END"
cte("checked", f"""SELECT *, CASE WHEN valid = 0 THEN 'payload is not valid JSON.' WHEN is_obj = 0 THEN 'Event payload must be a JSON object.'
  WHEN canonical THEN coalesce({_E_TS}, {_E_ACC}, {_E_SVC}, {_E_COST}, {_E_USAGE})
  WHEN prov = 'gcp' THEN coalesce({_E_COST}, {_E_USAGE}, {_E_TS}, {_E_ACC}, {_E_SVC}, {_E_TAGS})
  ELSE 'Unsupported provider ''' || prov || '''.' END AS error FROM typed""", "typed")
cte("normalized", f"""SELECT message_id, arrived_at, value, error,
  CASE WHEN error IS NULL THEN CASE WHEN trim({_j('event_id')}) <> '' THEN {_j('event_id')} ELSE sha256(value) END END AS event_id,
  CASE WHEN error IS NULL THEN ts END AS timestamp,
  CASE WHEN error IS NULL THEN 'gcp' END AS provider,
  CASE WHEN error IS NULL THEN x_account END AS account_id,
  CASE WHEN error IS NULL THEN x_service END AS service,
  CASE WHEN error IS NULL THEN x_region END AS region,
  CASE WHEN error IS NULL THEN cost END AS cost_amount,
  CASE WHEN error IS NULL THEN coalesce(usage, 0) END AS usage_amount,
  CASE WHEN error IS NULL THEN coalesce({_blank('x_unit')}, 'unit') END AS usage_unit,
  CASE WHEN error IS NULL THEN x_env END AS env,
  CASE WHEN error IS NULL THEN coalesce({_j('source_type')}, 'live') END AS source_type, canonical, prov
  FROM checked""", "checked")

# -- injected and labelled series ---------------------------------------------------------

cte("positioned", f"""SELECT *, row_number() OVER ({PART}) - 1 AS pos, count(*) OVER (PARTITION BY {K}) AS series_rows,
  md5(account_id || '|' || service || '|' || region || '|' || CAST(bucket AS STRING)) AS row_id,
  row_number() OVER (PARTITION BY {K} ORDER BY md5('backtest|' || account_id || '|' || service || '|' || region || '|' || CAST(bucket AS STRING))) - 1 AS draw
  FROM hourly""", "hourly")
cte("hits", """SELECT *, draw < 6 AS h_spike, pos >= 240 AS h_drift, pos >= 250 AS h_shift,
  pos >= least(100, series_rows - 1) AND pos < least(100, series_rows - 1) + 6 AS h_budget,
  (SELECT avg(total_cost) FROM hourly) AS budget FROM positioned""", "positioned")
cte("spiked", """SELECT *, CASE WHEN h_spike THEN total_cost * 5.0 ELSE total_cost END AS x1 FROM hits""", "hits")
cte("drifted", """SELECT *, CASE WHEN h_drift THEN x1 * greatest(0.0, 1.0 + CAST(0.02 AS DOUBLE) * (pos - 240)) ELSE x1 END AS x2 FROM spiked""", "spiked")
cte("shifted", """SELECT *, CASE WHEN h_shift THEN x2 + 40.0 ELSE x2 END AS x3 FROM drifted""", "drifted")
cte("breached", """SELECT *, CASE WHEN h_budget THEN greatest(x3, budget * 3.0) ELSE x3 END AS x4,
  CASE WHEN h_budget THEN 'budget_breach' WHEN h_shift THEN 'level_shift' WHEN h_drift THEN 'drift' WHEN h_spike THEN 'spike'
       ELSE 'normal' END AS anomaly_type FROM shifted""", "shifted")
cte("injected", f"""SELECT row_id, {K}, bucket, pos, round(greatest(x4, 0.0), 6) AS total_cost, total_usage, event_count, anomaly_type,
  CASE WHEN anomaly_type = 'normal' THEN 0 ELSE 1 END AS is_anomaly FROM breached""", "breached")
cte("account_stats", """SELECT account_id AS acct, avg(total_cost) AS mu,
  CASE WHEN stddev_samp(total_cost) > abs(avg(total_cost)) * 1e-12 THEN stddev_samp(total_cost) ELSE 1.0 END AS sd
  FROM injected GROUP BY 1""", "injected")
cte("labelled", """SELECT i.*, round(least(abs(total_cost - mu) / sd / 5.0, 1.0), 6) AS anomaly_score
  FROM injected i JOIN account_stats ON acct = account_id""", "injected", "account_stats")
cte("labelled_base", """SELECT * EXCLUDE (is_anomaly, anomaly_score), is_anomaly AS label, anomaly_score AS if_score FROM labelled""", "labelled")
forecast_cte("lab_forecast", "labelled_base", "profile")
rules_cte("lab_ruled", "lab_forecast")
cte("lab_in", "SELECT *, least(abs(z_score), 10.0) / 10.0 AS ts_signal FROM lab_ruled", "lab_ruled")
fused_cte("lab_fused", "lab_in")
cte("labelled_signals", f"""SELECT row_id, {K}, bucket, total_cost, anomaly_type, label AS is_anomaly, is_anomaly AS flagged,
  threshold_fired + jump_fired + sustained_fired AS n_rules, round(ts_signal, 6) AS ts_signal, round(if_score, 6) AS if_score,
  round(rule_score, 6) AS rule_score, round(anomaly_score, 6) AS anomaly_score FROM lab_fused""", "lab_fused")


def cooldown_cte(name: str, src: str, hours: int = 1, state: str | None = None) -> None:
    """Sequential cooldown, one recursion step per event of a series."""
    extra = f"LEFT JOIN {state} s ON s.account_id = e.account_id AND s.service = e.service AND s.region = e.region" if state else ""
    since = "s.last_alerted" if state else "CAST(NULL AS TIMESTAMP)"
    cte(f"{name}_events", f"""SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY detected_at, anomaly_id) AS rn FROM {src}""",
        *([src, state] if state else [src]))
    cool = f"e.detected_at < {{last}} + INTERVAL {hours} HOUR"
    first, later = cool.format(last=since), cool.format(last="c.last")
    cte(name, f"""SELECT e.account_id, e.service, e.region, e.anomaly_id, e.rn, coalesce({first}, false) AS suppressed,
        CASE WHEN coalesce({first}, false) THEN {since} ELSE e.detected_at END AS last FROM {name}_events e {extra} WHERE e.rn = 1
      UNION ALL SELECT e.account_id, e.service, e.region, e.anomaly_id, e.rn, {later},
        CASE WHEN {later} THEN c.last ELSE e.detected_at END FROM {name} c JOIN {name}_events e
        ON e.account_id = c.account_id AND e.service = c.service AND e.region = c.region AND e.rn = c.rn + 1""", f"{name}_events")


cte("old_alerts", "SELECT * FROM alerts WHERE created_at < TIMESTAMP '2024-01-12 00:00:00'", "alerts")
cte("alert_state", f"SELECT {K}, max(created_at) AS last_alerted FROM old_alerts WHERE status <> 'suppressed' GROUP BY {K}", "old_alerts")
cooldown_cte("cooled", "anomalies", 2)
# all anomalies against the alerts remembered so far
cooldown_cte("cooled_on", "anomalies", 2, "alert_state")
