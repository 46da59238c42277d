"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlark.config import GrowthConfig, VolatilityConfig  # noqa: E402
from ledgerlark.operators import baseline, evaluate, explain, features, scoring  # noqa: E402
from ledgerlark.plans import catalog, frames  # noqa: E402
from ledgerlark.session import build_session  # noqa: E402
from ledgerlark.sources.adapters import billing, daily, raw_records  # noqa: E402
from ledgerlark.sources import normalize  # noqa: E402


def daily_features(spark, sf):
    df = features.rolling_features(daily(spark, sf))
    df = features.volatility_features(features.growth_features(df, GrowthConfig()), VolatilityConfig())
    return features.calendar_features(df)


def daily_scoring(spark, sf):
    series = daily(spark, sf)
    return scoring.score_series(series, baseline.fit_profile(series))


def daily_explained(spark, sf):
    df = explain.explain_rules(explain.explain_forecast(daily_scoring(spark, sf)))
    return explain.explanation_payload(df).select("account_id", "service", "region", "bucket", explain.payload_json().alias("payload"))


def event_zscore_sweep(spark, sf):
    """Per-account score of every event, then all thresholds in one pass."""
    from pyspark.sql import functions as F

    df = evaluate.zscore_score(billing(spark, sf), target="cost_amount")
    return evaluate.supervised_sweep(df.withColumn("is_anomaly", (F.col("cost_amount") > 250).cast("int")))


def full_normalize(spark, sf):
    # the test table is one small file; a real stream arrives in many partitions
    return normalize.normalize(raw_records(spark, sf).repartition(spark.sparkContext.defaultParallelism))


HEADLINE = {
    "normalize_messages": full_normalize,
    "daily_rollup": lambda s, d: daily(s, d),
    "daily_features": daily_features,
    "daily_scoring": daily_scoring,
    "daily_explained": daily_explained,
    "event_zscore_sweep": event_zscore_sweep,
    "rolling_mad": catalog.QUERIES["f17_rolling_mad"],
    "hourly_rule_scoring": catalog.QUERIES["e6_rule_scoring"],
    "hourly_ensemble": catalog.QUERIES["e6_ensemble_scoring"],
    "isolation_forest": catalog.QUERIES["m10_isolation_forest_score"],
    "reconstruction": catalog.QUERIES["m12_reconstruction_score"],
    "kpi_summary": catalog.QUERIES["a3_kpi_summary"],
    "detection_lag_p95": catalog.QUERIES["a8_detection_lag_p95"],
    "event_append": catalog.QUERIES["io12_event_append"],
    "anomaly_upsert": catalog.QUERIES["io14_anomaly_upsert"],
    "alert_cooldown": catalog.QUERIES["l3_cooldown"],
    "slice_risk": catalog.QUERIES["v17_slice_risk"],
    "threshold_sweep": catalog.QUERIES["v2_supervised_sweep"],
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["a2_training_counts"](spark, sf).collect()  # start the JVM's machinery
    times = {}
    for name, fn in HEADLINE.items():
        start = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
