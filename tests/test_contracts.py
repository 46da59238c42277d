"""The payload contract field by field, and the dead-letter tail by line."""

import json

from pyspark.sql import functions as F

from helpers import frame, series_rows
from ledgerlark.operators import baseline, explain, scoring
from ledgerlark.sources import messages


def payloads(spark):
    df = frame(spark, series_rows([100.0] * 5 + [400.0]))
    scored = scoring.score_series(df, baseline.fit_profile(df))
    return explain.explanation_payload(explain.explain_rules(explain.explain_forecast(scored)))


def test_every_broken_field_is_named(spark):
    """One field is broken at a time, also by NULL, and exactly its path is reported."""
    df = payloads(spark).orderBy(F.desc("bucket")).limit(1).select("exp_breakdown").cache()
    none = F.lit(None)

    def broken(path, value):
        *outer, last = path.split(".")
        column = F.col("exp_breakdown")
        if not outer:
            return column.withField(last, value(column[last]))
        inner = column[".".join(outer)] if len(outer) == 1 else column[outer[0]][outer[1]]
        if outer == ["components"]:
            return column.withField("components", F.transform(inner, lambda c: c.withField(last, value(c[last]))))
        changed = inner.withField(last, value(inner[last]))
        return column.withField(outer[0], changed) if len(outer) == 1 else column.withField(
            outer[0], column[outer[0]].withField(outer[1], changed))

    cases = {
        "anomaly_score": [F.lit(1.5), F.lit(-0.1), F.lit(float("nan")), none.cast("double")], "anomaly_threshold": [F.lit(2.0), none.cast("double")],
        "is_anomaly": [none.cast("boolean")], "severity": [F.lit("grave")], "components.label": [none.cast("string")],
        "components.active": [none.cast("boolean")], "components.configured_weight": [none.cast("double")],
        "components.weighted_contribution": [none.cast("double")], "components.effective_weight": [F.lit(1.2), none.cast("double")],
        "forecast_explanation.actual": [none.cast("double")], "forecast_explanation.summary": [none.cast("string")],
        "forecast_explanation.direction": [F.lit("sideways"), none.cast("string")],
        "forecast_explanation.ci_breaches": [F.create_map(F.lit("95"), none.cast("boolean"))],
        "rule_explanation.summary": [none.cast("string")], "rule_explanation.triggered_rules": [none.cast("array<string>")],
        "rule_explanation.sudden_jump.score": [F.lit(1.01), none.cast("double")], "rule_explanation.sudden_jump.reason": [none.cast("string")],
        "rule_explanation.threshold_breach.fired": [none.cast("boolean")], "rule_explanation.sustained_increase.rule": [none.cast("string")],
    }
    wanted, columns = [], []
    for path, values in cases.items():
        for v in values:
            wanted.append([path])
            columns.append(F.struct(broken(path, lambda _, v=v: v).alias("p")))
    bad = df.select(F.posexplode(F.array(*columns)).alias("i", "row")).select("i", F.col("row.p").alias("exp_breakdown"))
    got = {r.i: r.e for r in bad.select("i", explain.payload_errors().alias("e")).collect()}
    assert [got[i] for i in range(len(wanted))] == wanted
    order = df.select(F.col("exp_breakdown").withField("components", F.reverse("exp_breakdown.components")).alias("exp_breakdown"))
    assert order.select(explain.payload_errors().alias("e")).first().e == ["components"]


def test_parts_may_be_absent(spark):
    rows = payloads(spark)
    for part in ("forecast_explanation", "rule_explanation"):
        gone = F.col("exp_breakdown")
        kind = rows.schema["exp_breakdown"].dataType[part].dataType
        without = rows.select(gone.withField(part, F.lit(None).cast(kind)).alias("exp_breakdown"))
        assert {tuple(r.e) for r in without.select(explain.payload_errors().alias("e")).collect()} == {()}
    bare = rows.select(F.col("exp_breakdown").dropFields("forecast_explanation", "rule_explanation").alias("exp_breakdown"))
    assert {tuple(r.e) for r in bare.select(explain.payload_errors(parts=()).alias("e")).collect()} == {()}


def test_tail_is_the_last_lines_of_the_file(spark, tmp_path):
    """Malformed lines count towards the limit where they stand; times out of order do not matter."""
    def line(i, day):
        return json.dumps({f: f"2026-01-{day:02d}" if f == "failed_at" else str(i) for f in messages.DEAD_LETTER_FIELDS})

    lines = [line(0, 9), line(1, 30), "", line(2, 1), "{broken", line(3, 8), "[]", line(4, 2), "not json", "  "]
    (tmp_path / "dead.jsonl").write_text("\n".join(lines) + "\n")
    solid = [x for x in lines if x.strip()]
    stored = messages.read_lines(spark, str(tmp_path / "dead.jsonl"))
    for limit in range(len(solid) + 2):
        want = []
        for raw in (solid[-limit:] if limit else []):
            try:
                record = json.loads(raw)
            except json.JSONDecodeError:
                continue
            if isinstance(record, dict):
                want.append(record["message_id"])
        assert sorted(r.message_id for r in messages.tail(stored, limit).collect()) == want
    assert messages.count_lines(stored).first().records == len(solid)


def test_tail_of_many_blocks(spark, tmp_path):
    n = 4000
    (tmp_path / "big.jsonl").write_text("".join(
        json.dumps({f: str(i) if f == "message_id" else "x" * 50 for f in messages.DEAD_LETTER_FIELDS}) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        stored = messages.read_lines(spark, str(tmp_path / "big.jsonl"))
        assert stored.rdd.getNumPartitions() > 3
        assert sorted(int(r.message_id) for r in messages.tail(stored, 700).collect()) == list(range(n - 700, n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
