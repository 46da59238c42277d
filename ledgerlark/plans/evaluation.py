"""Queries over labelled frames, injected series and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FP_CURVE_GRID, SENSITIVITY_GRID, AlertConfig, CalibrationConfig, InjectionConfig, TunerConfig
from ..operators import alerts as al, evaluate as ev, explain, inject
from ..sources.adapters import hourly
from . import frames
from .registry import query
from .sql import K, with_

T = 0.30  # threshold of the published evaluation
CUT = "CAST(0.30 AS DOUBLE)"
KBS = f"{K}, bucket"
KB = ["account_id", "service", "region", "bucket"]


def _grid(values) -> str:
    rows = ", ".join(f"({i}, CAST({v} AS DOUBLE))" for i, v in enumerate(values))
    return f"(VALUES {rows}) g(pos, threshold)"


def _counts(grid, src: str = "labelled", score: str = "anomaly_score") -> str:
    return f"""SELECT g.pos AS pos, threshold, count(*) AS n, count(*) FILTER (WHERE is_anomaly = 1) AS n_pos, count(*) FILTER (WHERE is_anomaly = 0) AS n_neg,
      count(*) FILTER (WHERE {score} >= threshold AND is_anomaly = 1) AS tp, count(*) FILTER (WHERE {score} >= threshold AND is_anomaly = 0) AS fp,
      count(*) FILTER (WHERE {score} >= threshold) AS n_flagged FROM {src}, {_grid(grid)} GROUP BY 1, 2"""


def _metrics(counts: str, undefined: str = "0.0") -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
      SELECT *, n_pos - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE {undefined} END AS precision,
        CASE WHEN n_pos > 0 THEN tp / CAST(n_pos AS DOUBLE) ELSE 0.0 END AS recall FROM ({counts}))"""


CAL = CalibrationConfig()
TUN = TunerConfig()

# -- sweeps ---------------------------------------------------------------------------------


@query("v1_account_zscore", with_(f"SELECT {KBS}, anomaly_score FROM labelled", "labelled"), ("anomaly_score",))
def _(spark, sf):
    return frames.labelled(spark, sf).select(*KB, "anomaly_score")


_SWEEP = f"SELECT threshold, precision, recall, f1, tp, fp, fn, n_flagged, n_flagged / CAST(n AS DOUBLE) AS flag_rate FROM ({_metrics(_counts(CAL.grid))})"
_SWEEP_D = ("threshold", "precision", "recall", "f1", "flag_rate")


@query("v2_supervised_sweep", with_(_SWEEP, "labelled"), _SWEEP_D)
def _(spark, sf):
    return ev.supervised_sweep(frames.labelled(spark, sf)).drop("pos")


@query("v3_unsupervised_sweep", with_(
    f"SELECT threshold, n_flagged, n_flagged / CAST(n AS DOUBLE) AS flag_rate FROM ({_counts(CAL.grid)})", "labelled"), ("threshold", "flag_rate"))
def _(spark, sf):
    return ev.unsupervised_sweep(frames.labelled(spark, sf)).drop("pos")


@query("v3_rate_threshold", with_(
    "SELECT least(greatest(quantile_cont(anomaly_score, 0.95), 0.01), 0.99) AS threshold FROM labelled", "labelled"), ("threshold",))
def _(spark, sf):
    return ev.rate_threshold(frames.labelled(spark, sf))


def _pick(name: str, metric: str, where: str, order: str):
    @query(name, with_(
        f"SELECT threshold, precision, recall, f1 FROM ({_SWEEP}) ORDER BY CASE WHEN {where} THEN 0 ELSE 1 END, round({metric}, 6) DESC, threshold {order} LIMIT 1",
        "labelled"), ("threshold", "precision", "recall", "f1"))
    def _(spark, sf):
        return ev.pick_threshold(ev.supervised_sweep(frames.labelled(spark, sf)), metric).select("threshold", "precision", "recall", "f1")


_pick("v4_best_threshold_f1", "f1", "true", "DESC")
_pick("v4_best_threshold_precision", "precision", "round(recall, 6) >= 0.20", "DESC")
_pick("v4_best_threshold_recall", "recall", "round(precision, 6) >= 0.10", "ASC")

_CONT = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, CAST({c} AS DOUBLE) AS c, quantile_cont(if_score, {1 - c!r}) AS cut FROM labelled_signals"
    for i, c in enumerate(TUN.contamination_grid)) + ")"
_CONT_COUNTS = f"""SELECT pos, c AS threshold, cut, count(*) AS n, count(*) FILTER (WHERE is_anomaly = 1) AS n_pos, count(*) FILTER (WHERE is_anomaly = 0) AS n_neg,
  count(*) FILTER (WHERE if_score >= cut AND is_anomaly = 1) AS tp, count(*) FILTER (WHERE if_score >= cut AND is_anomaly = 0) AS fp,
  count(*) FILTER (WHERE if_score >= cut) AS n_flagged FROM labelled_signals, ({_CONT}) GROUP BY 1, 2, 3"""


@query("v5_contamination_sweep", with_(
    f"SELECT threshold AS contamination, cut, precision, recall, f1, tp, fp, fn, n_flagged FROM ({_metrics(_CONT_COUNTS)})", "labelled_signals"),
       ("contamination", "cut", "precision", "recall", "f1"))
def _(spark, sf):
    return ev.contamination_sweep(frames.labelled_signals(spark, sf)).drop("pos", "threshold")


_TSWEEP = _metrics(_counts(TUN.threshold_grid, "labelled_signals"))


@query("v6_threshold_sweep", with_(f"SELECT threshold, precision, recall, f1, tp, fp, fn, n_flagged FROM ({_TSWEEP})", "labelled_signals"),
       ("threshold", "precision", "recall", "f1"))
def _(spark, sf):
    return ev.threshold_sweep(frames.labelled_signals(spark, sf)).drop("pos")


@query("v6_best_threshold", with_(
    f"SELECT threshold, f1 FROM ({_TSWEEP}) ORDER BY round(f1, 9) DESC, pos LIMIT 1", "labelled_signals"), ("threshold", "f1"))
def _(spark, sf):
    return ev.pick_threshold(ev.threshold_sweep(frames.labelled_signals(spark, sf)), tie="first").select("threshold", "f1")


@query("v6_unsupervised", with_(
    """SELECT CAST(0.05 AS DOUBLE) AS recommended_contamination, least(greatest(quantile_cont(anomaly_score, 0.95), 0.01), 0.99) AS recommended_threshold,
       'unsupervised' AS method FROM labelled""", "labelled"), ("recommended_contamination", "recommended_threshold"))
def _(spark, sf):
    return ev.recommend_unsupervised(frames.labelled(spark, sf))


# -- reports ------------------------------------------------------------------------------------

_SIG = "(VALUES ('ts_signal'), ('if_score'), ('rule_score'), ('anomaly_score')) v(signal)"
_SIGV = "CASE signal WHEN 'ts_signal' THEN ts_signal WHEN 'if_score' THEN if_score WHEN 'rule_score' THEN rule_score ELSE anomaly_score END"
_PCT = ("p25", "p50", "p75", "p90", "p95", "p99")


@query("v7_score_distribution", with_(
    f"""SELECT signal, count(s) AS n_valid, avg(s) AS mean, coalesce(stddev_samp(s), 0) AS std, {', '.join(f"quantile_cont(s, 0.{p[1:]}) AS {p}" for p in _PCT)},
        max(s) AS max FROM (SELECT signal, {_SIGV} AS s FROM labelled_signals, {_SIG}) WHERE s IS NOT NULL GROUP BY 1""", "labelled_signals"),
       ("mean", "std", *_PCT, "max"))
def _(spark, sf):
    return ev.score_distribution(frames.labelled_signals(spark, sf))


@query("v8_sensitivity", with_(
    f"SELECT threshold, n_flagged, n, n_flagged / CAST(n AS DOUBLE) * 100 AS pct_flagged FROM ({_counts(SENSITIVITY_GRID)})", "labelled"),
       ("threshold", "pct_flagged"))
def _(spark, sf):
    return ev.sensitivity(frames.labelled(spark, sf))


_AT = f"""SELECT threshold, n AS n_total, n_neg AS n_normal, n_pos AS n_anomaly, tp, fp, fn, n_neg - fp AS tn, precision, recall, f1,
  (tp + n_neg - fp) / CAST(n AS DOUBLE) AS accuracy, fp / CAST(n_neg AS DOUBLE) AS false_positive_rate,
  round(100.0 * n_pos / n, 4) AS true_anomaly_rate FROM ({{}})"""
_AT_D = ("threshold", "precision", "recall", "f1", "accuracy", "false_positive_rate", "true_anomaly_rate")


@query("v9_supervised_metrics", with_(_AT.format(_metrics(_counts([T]))), "labelled"), _AT_D)
def _(spark, sf):
    return ev.metrics_at(frames.labelled(spark, sf), T)


@query("v10_recall_by_type", with_(
    f"""SELECT anomaly_type, count(*) AS n_total, count(*) FILTER (WHERE anomaly_score >= {CUT}) AS n_detected,
        count(*) FILTER (WHERE anomaly_score >= {CUT}) / CAST(count(*) AS DOUBLE) AS recall FROM labelled WHERE anomaly_type <> 'normal' GROUP BY 1""",
    "labelled"), ("recall",))
def _(spark, sf):
    return ev.recall_by_type(frames.labelled(spark, sf), T)


@query("v11_signal_separation", with_(
    f"""SELECT signal, avg(CASE WHEN is_anomaly = 0 THEN s END) AS mean_normal, avg(CASE WHEN is_anomaly = 1 THEN s END) AS mean_anomaly,
        avg(CASE WHEN is_anomaly = 1 THEN s END) - avg(CASE WHEN is_anomaly = 0 THEN s END) AS separation
        FROM (SELECT is_anomaly, signal, {_SIGV} AS s FROM labelled_signals, {_SIG}) GROUP BY 1""", "labelled_signals"),
       ("mean_normal", "mean_anomaly", "separation"))
def _(spark, sf):
    return ev.signal_separation(frames.labelled_signals(spark, sf))


@query("v12_recommendation", with_(
    f"""SELECT CAST(0.05 AS DOUBLE) AS current_contamination, c.threshold AS recommended_contamination, CAST(0.55 AS DOUBLE) AS current_threshold,
        t.threshold AS recommended_threshold, t.f1 AS f1_at_recommended, 'supervised' AS method FROM
        (SELECT * FROM ({_metrics(_CONT_COUNTS)}) ORDER BY round(f1, 9) DESC, pos LIMIT 1) c,
        (SELECT * FROM ({_TSWEEP}) ORDER BY round(f1, 9) DESC, pos LIMIT 1) t""", "labelled_signals"),
       ("current_contamination", "recommended_contamination", "current_threshold", "recommended_threshold", "f1_at_recommended"))
def _(spark, sf):
    return ev.recommend(frames.labelled_signals(spark, sf))


@query("v13_headline_confusion", with_(_AT.format(_metrics(_counts([0.9999]), "1.0")), "labelled"), _AT_D)
def _(spark, sf):
    return ev.metrics_at(frames.labelled(spark, sf), 0.9999, undefined_precision=1.0)


def _cases(name: str, where: str, order: str, label: int, flagged: bool, lowest: bool = False):
    @query(name, with_(
        f"""SELECT row_id, {KBS}, round(total_cost, 4) AS total_cost, anomaly_score, anomaly_type FROM labelled WHERE is_anomaly = {label}
            AND anomaly_score {where} {CUT} ORDER BY anomaly_score {order}, row_id LIMIT 10""", "labelled"), ("total_cost", "anomaly_score"))
    def _(spark, sf):
        return ev.top_cases(frames.labelled(spark, sf), label, flagged, T, lowest=lowest)


_cases("v14_realised_false_positives", ">=", "DESC", 0, True)
_cases("v15_borderline_normals", "<", "DESC", 0, False)
_cases("v19_near_misses", "<", "DESC", 1, False)
_cases("v20_deep_misses", "<", "ASC", 1, False, lowest=True)


@query("v16_false_positive_curve", with_(
    f"""SELECT threshold, n_flagged, fp, tp, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision,
        fp / CAST(greatest(n_neg, 1) AS DOUBLE) AS fp_rate FROM ({_counts(FP_CURVE_GRID)})""", "labelled"), ("threshold", "precision", "fp_rate"))
def _(spark, sf):
    return ev.fp_curve(frames.labelled(spark, sf))


@query("v17_slice_risk", with_(
    f"""SELECT dimension, value, count(*) AS n_normal, count(*) FILTER (WHERE anomaly_score >= {CUT}) AS fp_at_current, avg(anomaly_score) AS mean_score_normal,
        quantile_cont(anomaly_score, 0.95) AS p95_score_normal, max(anomaly_score) AS max_score_normal FROM (
        SELECT anomaly_score, unnest(['account_id', 'service', 'region']) AS dimension, unnest([account_id, service, region]) AS value
        FROM labelled WHERE is_anomaly = 0) GROUP BY 1, 2""", "labelled"), ("mean_score_normal", "p95_score_normal", "max_score_normal"))
def _(spark, sf):
    return ev.slice_risk(frames.labelled(spark, sf), T, digits=12)


@query("v18_missed_by_type", with_(
    f"""SELECT anomaly_type, count(*) AS n_total, count(*) FILTER (WHERE anomaly_score < {CUT}) AS n_missed,
        count(*) FILTER (WHERE anomaly_score < {CUT}) / CAST(count(*) AS DOUBLE) AS miss_rate, avg(anomaly_score) AS mean_score,
        max(anomaly_score) AS max_score, min(anomaly_score) AS min_score FROM labelled WHERE is_anomaly = 1 GROUP BY 1""", "labelled"),
       ("miss_rate", "mean_score", "max_score", "min_score"))
def _(spark, sf):
    return ev.missed_by_type(frames.labelled(spark, sf), T)


@query("v21_threshold_resolution", with_(
    f"""SELECT 'calibration' AS source, threshold FROM (SELECT threshold FROM ({_SWEEP}) ORDER BY round(f1, 6) DESC, threshold DESC LIMIT 1)
        UNION ALL SELECT 'explicit', 0.42 UNION ALL SELECT 'fallback', 0.55""", "labelled"), ("threshold",))
def _(spark, sf):
    df = frames.labelled(spark, sf)
    best = ev.pick_threshold(ev.supervised_sweep(df))
    return (
        ev.resolve_threshold(best, None, like=df)
        .unionByName(ev.resolve_threshold(best, 0.42, like=df))
        .unionByName(ev.resolve_threshold(None, None, like=df))
    )


@query("v22_type_counts", with_("SELECT anomaly_type, count(*) AS count FROM labelled GROUP BY 1", "labelled"))
def _(spark, sf):
    return ev.type_counts(frames.labelled(spark, sf))


@query("v23_label_resolution", with_(
    """SELECT 'supervised' AS method, count(*) AS n_samples, count(*) FILTER (WHERE event_count >= 2) AS n_true_anomalies FROM labelled""", "labelled"))
def _(spark, sf):
    df = frames.labelled(spark, sf)
    external = df.select("row_id", (F.col("event_count") >= 2).cast("int").alias("label"))
    return ev.label_mode(ev.resolve_labels(df, external))


@query("v23_label_modes", with_(
    """SELECT 'supervised' AS method, count(*) AS n_samples, count(*) FILTER (WHERE is_anomaly = 1) AS n_true_anomalies FROM labelled
       UNION ALL SELECT 'unsupervised', count(*), 0 FROM labelled""", "labelled"))
def _(spark, sf):
    df = frames.labelled(spark, sf)
    return ev.label_mode(ev.resolve_labels(df)).unionByName(ev.label_mode(ev.resolve_labels(df.drop("is_anomaly"))))


@query("x5_example_cases", with_(
    """SELECT 'high_confidence_spike' AS case, * FROM (SELECT row_id, anomaly_score, anomaly_type, flagged AS is_anomaly FROM labelled_signals
         WHERE flagged = 1 AND anomaly_type = 'spike' ORDER BY anomaly_score DESC, row_id LIMIT 1)
       UNION ALL SELECT 'sustained_budget_breach', * FROM (SELECT row_id, anomaly_score, anomaly_type, flagged FROM labelled_signals
         WHERE anomaly_type = 'budget_breach' ORDER BY n_rules = 0, anomaly_score DESC, row_id LIMIT 1)
       UNION ALL SELECT 'borderline_normal', * FROM (SELECT row_id, anomaly_score, anomaly_type, flagged FROM labelled_signals
         WHERE flagged = 0 AND anomaly_type = 'normal' ORDER BY anomaly_score DESC, row_id LIMIT 1)
       UNION ALL SELECT 'calm_normal', * FROM (SELECT row_id, anomaly_score, anomaly_type, flagged FROM labelled_signals
         WHERE anomaly_type = 'normal' ORDER BY anomaly_score, row_id LIMIT 1)
       UNION ALL SELECT 'missed_anomaly', * FROM (SELECT row_id, anomaly_score, anomaly_type, flagged FROM labelled_signals
         WHERE flagged = 0 AND anomaly_type <> 'normal' ORDER BY anomaly_score, row_id LIMIT 1)""", "labelled_signals"), ("anomaly_score",))
def _(spark, sf):
    df = explain.explain_rules(frames.labelled_signals(spark, sf), frames.RULES)
    return explain.pick_examples(df.withColumn("is_anomaly", F.col("flagged")))


# -- injection ------------------------------------------------------------------------------------


def _one_kind(name: str, cfg: InjectionConfig, cost: str, hit: str, src: str = "hits"):
    @query(name, with_(
        f"SELECT {KBS}, round(greatest({cost}, 0.0), 6) AS total_cost, CASE WHEN {hit} THEN 1 ELSE 0 END AS is_anomaly FROM {src}", src), ("total_cost",))
    def _(spark, sf):
        return inject.inject(hourly(spark, sf), cfg).select(*KB, "total_cost", "is_anomaly")


_one_kind("j1_spike", InjectionConfig(spike_count=6, spike_multiplier=5.0), "CASE WHEN h_spike THEN total_cost * 5.0 ELSE total_cost END", "h_spike")
_one_kind("j2_drift", InjectionConfig(spike_count=None, drift_start=10, drift_slope=-0.05),
          "CASE WHEN pos >= 10 THEN total_cost * greatest(0.0, 1.0 + CAST(-0.05 AS DOUBLE) * (pos - 10)) ELSE total_cost END", "pos >= 10")
_one_kind("j3_level_shift", InjectionConfig(spike_count=None, shift_start=12, shift_amount=-25.0),
          "CASE WHEN pos >= 12 THEN total_cost - 25.0 ELSE total_cost END", "pos >= 12")
_one_kind("j4_budget_breach", InjectionConfig(spike_count=None, budget_start=100, budget_duration=6, budget_multiplier=3.0),
          "CASE WHEN h_budget THEN greatest(total_cost, budget * 3.0) ELSE total_cost END", "h_budget")


@query("j5_labels", with_(f"SELECT {KBS}, total_cost, is_anomaly, anomaly_type FROM injected", "injected"), ("total_cost",))
def _(spark, sf):
    return frames.injected(spark, sf).select(*KB, "total_cost", "is_anomaly", "anomaly_type")


# -- alerts -----------------------------------------------------------------------------------------

COOL = AlertConfig(cooldown_seconds=7200)
_PAIRS = "SELECT a.*, c.channel, a.anomaly_id || ':' || c.channel AS dedup_key FROM anomalies a, (VALUES ('in_app'), ('email')) c(channel)"


@query("l1_channel_expansion", with_(f"SELECT anomaly_id, channel, dedup_key FROM ({_PAIRS})", "anomalies"))
def _(spark, sf):
    return al.expand_channels(frames.anomalies(spark, sf), COOL.channels).select("anomaly_id", "channel", "dedup_key")


@query("l2_known_pairs_dropped", with_(
    f"SELECT dedup_key FROM ({_PAIRS}) WHERE dedup_key NOT IN (SELECT dedup_key FROM old_alerts)", "anomalies", "old_alerts"))
def _(spark, sf):
    known = frames.alerts(spark, sf).filter(F.col("created_at") < F.lit("2024-01-12 00:00:00").cast("timestamp"))
    return al.drop_known(al.expand_channels(frames.anomalies(spark, sf), COOL.channels), known).select("dedup_key")


@query("l3_cooldown", with_("SELECT anomaly_id, suppressed FROM cooled", "cooled"))
def _(spark, sf):
    return al.cooldown(frames.anomalies(spark, sf), COOL).select("anomaly_id", "suppressed")


def _old_alerts(spark, sf):
    return frames.alerts(spark, sf).filter(F.col("created_at") < F.lit("2024-01-12 00:00:00").cast("timestamp"))


@query("l3_cooldown_resumed", with_("SELECT anomaly_id, suppressed FROM cooled_on", "cooled_on"))
def _(spark, sf):
    return al.cooldown(frames.anomalies(spark, sf), COOL, al.last_alerted(_old_alerts(spark, sf))).select("anomaly_id", "suppressed")


@query("l4_alert_records", with_(
    """SELECT md5(dedup_key) AS alert_id, anomaly_id, channel, severity, dedup_key, status, detected_at AS created_at,
         CASE WHEN status = 'sent' THEN detected_at + INTERVAL 3 SECOND END AS sent_at, CASE WHEN status = 'failed' THEN repeat('x', 512) END AS error_detail
       FROM (SELECT a.* EXCLUDE (status), c.channel, a.anomaly_id || ':' || c.channel AS dedup_key, CASE WHEN k.suppressed THEN 'suppressed'
         WHEN c.channel = 'email' AND minute(a.detected_at) % 3 = 0 THEN 'failed' WHEN c.channel = 'email' AND minute(a.detected_at) % 3 = 1 THEN 'pending'
         ELSE 'sent' END AS status FROM anomalies a JOIN cooled_on k USING (anomaly_id), (VALUES ('in_app'), ('email')) c(channel))
       WHERE dedup_key NOT IN (SELECT dedup_key FROM old_alerts)""", "anomalies", "cooled_on", "old_alerts"))
def _(spark, sf):
    recent = frames.anomalies(spark, sf)
    tries = F.minute("detected_at") % 3
    outcomes = al.expand_channels(recent, COOL.channels).withColumn(
        "state", F.when(F.col("channel") == "in_app", F.lit(2)).otherwise(tries)).select(
        "dedup_key", F.when(F.col("state") == 2, F.col("detected_at") + F.expr("INTERVAL 3 SECONDS")).alias("delivered_at"),
        F.when(F.col("state") == 0, F.repeat(F.lit("x"), F.lit(600))).alias("error"))
    return al.derive_alerts(recent, _old_alerts(spark, sf), outcomes, COOL).drop("account_id", "service", "region")
