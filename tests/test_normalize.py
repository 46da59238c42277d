import json

from ledgerlark.config import CANONICAL_FIELDS
from ledgerlark.sources import messages, normalize

FLAT = {
    "billing_account_id": "acct-001", "service_description": "BigQuery", "location_region": "us-central1",
    "usage_start_time": "2026-01-01T00:00:00Z", "cost": 5.0, "usage_amount": 100.0, "usage_unit": "core-hours",
}
NESTED = {
    "service": {"description": "Compute Engine"}, "project": {"id": "proj-123"}, "location": {"region": "europe-west1"},
    "usage_start_time": "2026-01-01T00:00:00Z", "cost": 9.5, "usage": {"amount": 42.0, "unit": "byte-seconds"},
    "labels": [{"key": "env", "value": "prod"}, {"key": "team", "value": "data"}],
}


def one(spark, payload, drop=()):
    body = payload if isinstance(payload, (str, bytes)) else json.dumps({k: v for k, v in payload.items() if k not in drop})
    kind = "binary" if isinstance(body, bytes) else "string"
    return normalize.normalize(spark.createDataFrame([("m", body)], f"message_id string, value {kind}")).first()


def test_flat_and_nested(spark):
    r = one(spark, FLAT)
    assert (r.account_id, r.service, r.region, r.cost_amount, r.usage_amount, r.usage_unit, r.source_type, r.tags) == (
        "acct-001", "BigQuery", "us-central1", 5.0, 100.0, "core-hours", "live", None)
    r = one(spark, NESTED)
    assert (r.account_id, r.service, r.region, r.usage_amount, r.usage_unit) == (
        "proj-123", "Compute Engine", "europe-west1", 42.0, "byte-seconds")
    assert r.tags == {"env": "prod", "team": "data"}


def many(spark, payloads):
    """Normalise several payloads in one job, in order."""
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return normalize.normalize(spark.createDataFrame(rows, "message_id int, value string")).orderBy("message_id").collect()


REJECTS = [
    ({"cost": -1}, "cost_amount must be non-negative."),
    ({"cost": "abc"}, "cost_amount must be numeric."),
    ({"cost": "NaN"}, "cost_amount must be numeric."),
    ({"cost": None}, "cost_amount is required."),
    ({"usage_amount": -3}, "usage_amount must be non-negative."),
    ({"usage_start_time": "yesterday"}, "timestamp must be a valid ISO-8601 value."),
    ({"usage_start_time": " "}, "timestamp must not be empty."),
    ({"usage_start_time": None}, "timestamp is required."),
    ({"billing_account_id": "  "}, "account_id is required."),
    ({"service_description": ""}, "service is required."),
    ({"provider": "AWS"}, "Unsupported provider 'aws'."),
    ({"labels": "oops"}, "tags must be a key-value mapping."),
    ({"cost": -1, "usage_start_time": "bad", "service_description": ""}, "cost_amount must be non-negative."),
]


def test_rejects(spark):
    got = [r.error for r in many(spark, [{**FLAT, **change} for change, _ in REJECTS])]
    assert got == [error for _, error in REJECTS]


def test_undecodable(spark):
    bodies = ['{"cost": ', "", "[1, 2]", "null"]
    assert [r.error for r in many(spark, bodies)] == [
        "payload is not valid JSON.", "payload is not valid JSON.",
        "Event payload must be a JSON object.", "Event payload must be a JSON object."]
    assert one(spark, b"\xff\xfe{}").error == "payload is not valid UTF-8."


def test_fallbacks(spark):
    labels = [{"key": "a", "value": 1}, {"key": "a", "value": 2}, {"value": "x"}, 3, {"key": "b"}]
    bare = {k: v for k, v in FLAT.items() if k != "service_description"}
    r = many(spark, [
        {**FLAT, "cost": None, "cost_amount": "7.25"}, {**FLAT, "location_region": " "}, {**bare, "service": "Storage"},
        {**FLAT, "export_time": "2026-02-01", "usage_start_time": None}, {**FLAT, "labels": labels},
        {**FLAT, "labels": [], "tags": {"x": 2.5}}, {**FLAT, "labels": []}])
    assert (r[0].cost_amount, r[1].region, r[2].service, r[3].timestamp.month) == (7.25, "global", "Storage", 2)
    assert r[4].tags == {"a": "2", "b": ""}
    assert r[5].tags == {"x": "2.5"} and r[6].tags is None


def test_event_id_is_stable(spark):
    a, b = one(spark, FLAT), one(spark, {**FLAT, "event_id": "  "})
    assert a.event_id == one(spark, FLAT).event_id and len(a.event_id) == 64 and a.event_id != b.event_id
    assert one(spark, {**FLAT, "event_id": "e-1"}).event_id == "e-1"


def test_canonical_record(spark):
    full = {f: "x" for f in CANONICAL_FIELDS if f != "tags"} | {
        "timestamp": "2026-01-01T02:00:00+02:00", "cost_amount": 1, "usage_amount": None, "provider": "aws", "region": " "}
    r = one(spark, full)
    assert (r.provider, r.region, r.usage_amount, r.timestamp.hour, r.error) == ("aws", "global", 0.0, 0, None)
    # a missing key makes it a provider record, whose provider is then checked
    assert one(spark, full, drop=("usage_unit",)).error == "Unsupported provider 'aws'."
    assert one(spark, {**full, "tags": [1]}).error == "tags must be a key-value mapping."


def test_dead_letters_round_trip(spark, tmp_path):
    rows = [("1", json.dumps(FLAT)), ("2", "{broken"), ("3", json.dumps({**FLAT, "cost": -1}))]
    from pyspark.sql import functions as F

    out = normalize.normalize(spark.createDataFrame(rows, "message_id string, value string"))
    assert normalize.accepted(out).columns == list(CANONICAL_FIELDS)
    path = str(tmp_path / "dead")
    messages.write_dead_letters(normalize.rejected(out, F.lit("2026-01-01").cast("timestamp")), path)
    lines = messages.read_lines(spark, path)
    assert messages.count_lines(lines).first().records == 2
    assert messages.count_lines(messages.read_lines(spark, str(tmp_path / "none"))).first().records == 0
    again = messages.replay(lines)
    assert {(r.stream, r.message_id) for r in again.collect()} == {("billing-events", "2"), ("billing-events", "3")}
    assert normalize.normalize(again).filter("error IS NULL").count() == 0


def test_dead_letter_tail_before_skip(spark):
    good = [json.dumps({f: f"2026-01-0{i}" if f == "failed_at" else "x" for f in messages.DEAD_LETTER_FIELDS}) for i in (1, 2, 3)]
    lines = spark.createDataFrame([(g,) for g in good] + [("[]",), ("{bad",)], "value string")
    assert [r.failed_at for r in messages.tail(lines, 2).orderBy("failed_at").collect()] == ["2026-01-02", "2026-01-03"]
    assert messages.tail(lines).count() == 3


def test_ingest_contract(spark):
    rows = [("2026-01-01 00:05:00", "gcp", 1.5, {"a": "b"}, "live"), ("2026-01-01 00:05:01", "ibm", 0.1234567, {"k" * 65: "v"}, "demo"),
            ("2026-01-01 00:00:00", "aws", -1.0, {str(i): "v" for i in range(51)}, "synthetic")]
    df = spark.createDataFrame(
        [(t, p, "a", "s", "r", c, 1.0, "u", tags, src) for t, p, c, tags, src in rows],
        "ts string, provider string, account_id string, service string, region string, cost_amount double, usage_amount double, "
        "usage_unit string, tags map<string,string>, source_type string").selectExpr("*", "cast(ts as timestamp) as timestamp")
    got = [r.violations for r in normalize.ingest_errors(df, "2026-01-01 00:00:00").collect()]
    assert got == [[], ["timestamp", "provider", "cost_amount", "tags", "source_type"], ["cost_amount", "tags"]]


def test_work_per_message(spark):
    """Fields that nobody asks for are not computed, and labels are read through once, not once per key."""
    df = normalize.normalize(spark.createDataFrame([("m", "{}")], "message_id string, value string"))

    def plan(*columns):
        return df.filter("error IS NULL").select(*columns)._jdf.queryExecution().optimizedPlan().toString()

    assert "sha2(" not in plan("service") and "sha2(" in plan("event_id")
    assert "filter(l_tags" not in plan("service") and plan("tags").count("filter(l_tags") == 1
    labels = [{"key": "a", "value": "1"}, {"value": "x"}, {"key": "b"}, {"key": "a", "value": None}]
    body = json.dumps({"cost": 1, "account_id": "a", "service": "s", "timestamp": "2024-01-01", "labels": labels})
    rows = normalize.normalize(spark.createDataFrame([(body,), (body + body,)], "value string")).orderBy("error").collect()
    assert rows[0]["error"] is None and list(rows[0]["tags"].items()) == [("a", "None"), ("b", "")]
    assert rows[1]["error"] == "payload is not valid JSON."
