from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.config import AlertConfig
from ledgerlark.operators import alerts, kpis, lists
from ledgerlark.sources import csv_io, tables

T0 = datetime(2026, 1, 1)


def brute(events, seconds, last=None):
    """Straightforward sequential cooldown over (time, id) pairs of one series."""
    out = {}
    for at, eid in sorted(events):
        cooling = last is not None and (at - last).total_seconds() < seconds
        out[eid] = cooling
        if not cooling:
            last = at
    return out


def anomalies(spark, series):
    rows = [(eid, acct, "s", "r", at) for acct, events in series.items() for at, eid in events]
    return spark.createDataFrame(rows, "anomaly_id string, account_id string, service string, region string, detected_at timestamp")


@pytest.mark.parametrize("seed", range(2))
def test_cooldown_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    series = {}
    for acct, n in (("hot", 400), ("b", 60), ("c", 1)):
        at = np.cumsum(rng.choice([0, 30, 1799, 1800, 3599, 3600, 9000], n))
        series[acct] = [(T0 + timedelta(seconds=int(s)), f"{acct}{i:04d}") for i, s in enumerate(at)]
    want = {}
    for events in series.values():
        want |= brute(events, 3600)
    for chunk in (3600, 604_800):
        got = alerts.cooldown(anomalies(spark, series), AlertConfig(), chunk_seconds=chunk)
        assert {r.anomaly_id: r.suppressed for r in got.collect()} == want


def test_cooldown_boundary_and_state(spark):
    series = {"a": [(T0 + timedelta(seconds=s), f"e{s}") for s in (0, 3599, 3600, 7199, 7200)]}
    got = {r.anomaly_id: r.suppressed for r in alerts.cooldown(anomalies(spark, series)).collect()}
    assert got == {"e0": False, "e3599": True, "e3600": False, "e7199": True, "e7200": False}
    state = spark.createDataFrame([("a", "s", "r", T0 - timedelta(seconds=10))],
                                  "account_id string, service string, region string, last_alerted timestamp")
    got = {r.anomaly_id: r.suppressed for r in alerts.cooldown(anomalies(spark, series), state=state).collect()}
    assert got == brute(series["a"], 3600, T0 - timedelta(seconds=10))


@pytest.mark.parametrize("ahead", [-1000, 50_000, 400_000])
def test_cooldown_resumes_inside_the_history(spark, ahead):
    """The remembered alert may be later than many of the events."""
    at = np.cumsum(np.random.default_rng(ahead + 2000).choice([600, 1800, 3600, 5000], 300))
    events = [(T0 + timedelta(seconds=int(s)), f"e{i:04d}") for i, s in enumerate(at)]
    last = T0 + timedelta(seconds=ahead)
    state = spark.createDataFrame([("a", "s", "r", last)], "account_id string, service string, region string, last_alerted timestamp")
    for chunk in (7200,):
        got = alerts.cooldown(anomalies(spark, {"a": events}), state=state, chunk_seconds=chunk)
        assert {r.anomaly_id: r.suppressed for r in got.collect()} == brute(events, 3600, last)


def test_rerun_creates_no_duplicates(spark):
    df = anomalies(spark, {"a": [(T0, "x"), (T0 + timedelta(hours=2), "y")]}).withColumn("severity", F.lit("low"))
    first = alerts.derive_alerts(df)
    assert first.count() == 4
    assert alerts.derive_alerts(df, first).count() == 0


def test_upsert_keeps_identity(spark):
    schema = ("anomaly_id string, account_id string, service string, region string, bucket timestamp, anomaly_score double, "
              "severity string, score_breakdown string, status string, detected_at timestamp")
    old = spark.createDataFrame([("id1", "a", "s", "r", T0, 0.6, "low", "old", "resolved", T0)], schema)
    scored = spark.createDataFrame(
        [("a", "s", "r", T0, 0.9, 1, "high"), ("a", "s", "r", T0 + timedelta(hours=1), 0.7, 1, "medium"), ("b", "s", "r", T0, 0.1, 0, "none")],
        "account_id string, service string, region string, bucket timestamp, anomaly_score double, is_anomaly int, severity string")
    fresh = tables.new_anomalies(scored, F.lit("2026-02-01").cast("timestamp"))
    nxt = {(r.account_id, r.bucket): r for r in tables.upsert_anomalies(old, fresh).collect()}
    assert len(nxt) == 2
    kept = nxt[("a", T0)]
    assert (kept.anomaly_id, kept.status, kept.detected_at) == ("id1", "resolved", T0)
    assert (kept.anomaly_score, kept.severity, kept.score_breakdown) == (0.9, "high", None)
    assert nxt[("a", T0 + timedelta(hours=1))].status == "open"
    again = tables.upsert_anomalies(tables.upsert_anomalies(old, fresh), fresh)
    assert again.count() == 2


def test_append_first_arrival_wins(spark):
    rows = [("e1", T0 + timedelta(seconds=5), 2, 9.0), ("e1", T0, 1, 1.0), ("e1", T0, 0, 0.5), ("e2", T0, 3, 2.0)]
    batch = spark.createDataFrame(rows, "event_id string, ingested_at timestamp, seq long, cost_amount double")
    out = {r.event_id: r.cost_amount for r in tables.append_events(None, batch).collect()}
    assert out == {"e1": 0.5, "e2": 2.0}
    assert tables.append_events(batch.filter("event_id = 'e1'"), batch).count() == 1
    r = tables.append_receipt(batch, tables.append_events(None, batch)).first()
    assert (r.accepted, r.duplicate, r.total) == (2, 2, 4)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, root)
    a = tables.write_version(spark.range(1), root, "v20260101_000000")
    tables.write_version(spark.range(2), root, "v20260102_000000")
    assert tables.read_version(spark, root).count() == 2
    assert tables.read_version(spark, root, a).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, root, "v1")
    with pytest.raises(ValueError):
        tables.prune_models(spark.range(1), 0)


def test_lists(spark):
    df = spark.range(7).selectExpr(
        "cast(id as string) as anomaly_id", "element_at(array('none','low','medium','high'), cast(id % 4 + 1 as int)) as severity",
        "timestamp '2026-01-01' as detected_at", "timestamp '2026-01-01' + make_dt_interval(0, cast(id as int)) as bucket", "id / 10 as anomaly_score")
    assert [r.anomaly_id for r in lists.list_anomalies(df, sort="severity", size=3).collect()] == ["3", "2", "6"]
    assert [r.anomaly_id for r in lists.list_anomalies(df, sort="nonsense", order="sideways", size=2, page=2).collect()] == ["2", "3"]
    assert [r.anomaly_id for r in lists.list_anomalies(df, from_bucket="2026-01-01 02:00:00", to_bucket="2026-01-01 03:00:00").collect()] == ["2", "3"]
    t = lists.totals(df.filter("false"), 50).first()
    assert (t.total, t.pages) == (0, 0)
    assert lists.totals(df.filter("false"), 50, at_least=1).first().pages == 1
    with pytest.raises(ValueError):
        lists.list_anomalies(df, size=500)


def test_acknowledge_pick(spark):
    rows = [(f"a{i}", "acknowledged", T0 - timedelta(seconds=i + 1)) for i in range(10)]
    df = spark.createDataFrame(rows, "anomaly_id string, status string, detected_at timestamp")
    r = kpis.time_to_acknowledge(df, str(T0)).first()
    assert (r.mtt_ack_p50_seconds, r.mtt_ack_p95_seconds) == (5.0, 9.0)
    assert kpis.time_to_acknowledge(df.filter("false"), str(T0)).first().mtt_ack_p50_seconds is None


def test_plain_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "Timestamp,account_id,service,region,cost_amount,usage_amount,cost_type\n"
        "2026-01-01T00:00:00,a,s,r,1.23456789,2,tax\n2026-13-01,a,s,r,1,2,\n2026-01-01,a,s,r,x,2,\n")
    load = csv_io.load_billing_csv(spark, str(tmp_path / "x.csv"))
    assert not load.provider_export
    row = load.accepted().first()
    assert (row.provider, row.usage_unit, row.cost_amount, row.source_type) == ("custom", "units", 1.234568, "training_uploaded")
    s = load.summary().first()
    assert (s.accepted, s.failed, s.total, len(s.errors)) == (1, 2, 3, 2)
    (tmp_path / "y.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        csv_io.load_billing_csv(spark, str(tmp_path / "y.csv"))
