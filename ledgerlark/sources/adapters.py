"""Billing tables as views over the generic test tables.

There is no billing table on disk, so the same definitions are given once as
SQL text both Spark and an ANSI engine accept. Nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import KEYS
from ..operators.series import bucket_rollup

# Fixed "as of" moment of the test data.
NOW = "2024-01-31 00:00:00"

EVENT_COLUMNS = """
  CAST(event_id AS STRING) AS event_id,
  CAST(ts AS TIMESTAMP) AS timestamp,
  'gcp' AS provider,
  'acct-' || CAST(user_id % 3 AS STRING) AS account_id,
  event_type AS service,
  'r' || CAST(event_id % 2 AS STRING) AS region,
  value AS cost_amount,
  CAST(regexp_replace(props, '[^0-9]', '', 'g') AS DOUBLE) AS usage_amount,
  'unit' AS usage_unit,
  CASE event_id % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'live'
       WHEN 2 THEN 'training_generated' ELSE 'training_uploaded' END AS source_type,
  event_id AS seq
"""

# Raw provider records as JSON text: nested and flat by parity, faults by
# other moduli so that every rejection occurs at every scale.
RAW_TEXT = """
CASE
 WHEN event_id % 29 = 6 THEN '{"event_id": "' || CAST(event_id AS STRING) || '", "cost": '
 WHEN event_id % 31 = 7 THEN '[' || CAST(event_id AS STRING) || ', 1]'
 WHEN event_id % 41 = 9 THEN '{"event_id": "' || CAST(event_id AS STRING) || '", "timestamp": "'
   || replace(CAST(ts AS STRING), ' ', 'T') || 'Z", "provider": " gcp ", "account_id": "acct-'
   || CAST(user_id % 3 AS STRING) || '", "service": " ' || event_type || ' ", "region": "", "cost_amount": '
   || CAST(value AS STRING) || ', "usage_amount": null, "usage_unit": " ", "source_type": "live"'
   || CASE WHEN event_id % 3 = 0 THEN ', "tags": {"env": "prod"}' ELSE '' END || '}'
 ELSE '{"event_id": ' || CASE WHEN event_id % 61 = 13 THEN '"' || CAST(event_id - 1 AS STRING) || '"'
       WHEN event_id % 71 = 14 THEN 'null' ELSE '"' || CAST(event_id AS STRING) || '"' END
   || CASE WHEN event_id % 37 = 8 THEN ', "provider": " AWS "' ELSE '' END
   || CASE WHEN event_id % 23 = 5 THEN ', "usage_start_time": "yesterday"'
           WHEN event_id % 73 = 15 THEN ', "export_time": "' || replace(CAST(ts AS STRING), ' ', 'T') || '+02:00"'
           WHEN event_id % 79 = 16 THEN ''
           ELSE ', "usage_start_time": "' || replace(CAST(ts AS STRING), ' ', 'T') || 'Z"' END
   || CASE WHEN event_id % 19 = 4 THEN ', "cost": -1.5'
           WHEN event_id % 43 = 10 THEN ', "cost": "abc"'
           WHEN event_id % 83 = 17 THEN ''
           WHEN event_id % 5 = 0 THEN ', "cost": null, "cost_amount": "' || CAST(value AS STRING) || '"'
           ELSE ', "cost": ' || CAST(value AS STRING) END
   || CASE WHEN event_id % 59 = 12 THEN ', "account_id": " "'
           WHEN event_id % 2 = 0 THEN ', "project": {"id": "acct-' || CAST(user_id % 3 AS STRING) || '"}'
           ELSE ', "billing_account_id": "acct-' || CAST(user_id % 3 AS STRING) || '"' END
   || CASE WHEN event_id % 17 = 3 THEN ', "service": "  "'
           WHEN event_id % 2 = 0 THEN ', "service": {"description": "' || event_type || '"}'
           WHEN event_id % 3 = 0 THEN ', "service": "' || event_type || '"'
           ELSE ', "service_description": " ' || event_type || '"' END
   || CASE WHEN event_id % 11 = 2 THEN ''
           WHEN event_id % 2 = 0 THEN ', "location": {"region": "", "location": "r' || CAST(event_id % 2 AS STRING) || '"}'
           ELSE ', "location_region": "r' || CAST(event_id % 2 AS STRING) || '"' END
   || CASE WHEN event_id % 67 = 18 THEN ', "usage_amount": -3'
           WHEN event_id % 2 = 0 THEN ', "usage": {"amount": ' || regexp_replace(props, '[^0-9]', '', 'g') || ', "unit": "hours"}'
           ELSE ', "usage_amount": ' || regexp_replace(props, '[^0-9]', '', 'g') END
   || CASE WHEN event_id % 47 = 11 THEN ', "labels": {"env": "prod", "team": "data"}'
           WHEN event_id % 53 = 20 THEN ', "labels": "oops"'
           WHEN event_id % 2 = 0 THEN ', "labels": [{"key": "env", "value": "dev"}, {"key": "env", "value": "prod"}, {"value": "x"}]'
           ELSE '' END
   || '}'
END
"""


def _spark_sql(text: str) -> str:
    """Spark's regexp_replace always replaces all matches and takes no flag."""
    return text.replace(", 'g')", ")")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_text(df: DataFrame, columns: str) -> DataFrame:
    """Project a comma-separated SQL select list (shared with the oracle text)."""
    df.createOrReplaceTempView("_ledgerlark_src")
    return df.sparkSession.sql(f"SELECT {_spark_sql(columns)} FROM _ledgerlark_src")


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical billing events (without tags) from ``events``."""
    return select_text(table(spark, sf_dir, "events"), EVENT_COLUMNS)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_rollup(billing(spark, sf_dir), "hour")


DAILY_COLUMNS = """
  CAST(l_shipdate AS TIMESTAMP) AS timestamp,
  CAST(l_suppkey % 20 AS STRING) AS account_id,
  l_returnflag AS service,
  l_linestatus AS region,
  l_extendedprice AS cost_amount,
  l_quantity AS usage_amount
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily buckets from ``lineitem``: the larger series for benchmarks."""
    return bucket_rollup(select_text(table(spark, sf_dir, "lineitem"), DAILY_COLUMNS), "day")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``message_id, value`` provider messages as they arrive on a stream."""
    return select_text(
        table(spark, sf_dir, "events"),
        f"CAST(event_id AS STRING) AS message_id, CAST(ts AS TIMESTAMP) AS arrived_at, {RAW_TEXT} AS value")


__all__ = ["KEYS", "NOW", "billing", "daily", "hourly", "raw_records", "select_text", "table"]
