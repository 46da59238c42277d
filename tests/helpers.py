"""Small literal frames and pandas references."""

from datetime import datetime, timedelta

START = datetime(2026, 1, 6, 9)


def series_rows(costs, account="a", service="compute", region="r", start=START, step=timedelta(minutes=1)):
    return [(start + i * step, account, service, region, float(c) if c is not None else None, 1.0, 1) for i, c in enumerate(costs)]


SCHEMA = "bucket timestamp, account_id string, service string, region string, total_cost double, total_usage double, event_count long"


def frame(spark, *series):
    return spark.createDataFrame([r for s in series for r in s], SCHEMA)


def by_bucket(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("account_id", "service", "region", "bucket").collect()]
