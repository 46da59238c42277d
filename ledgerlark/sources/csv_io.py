"""Billing CSV in and training CSV / JSON lines out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import CANONICAL_FIELDS, TRAINING_SOURCES
from ..functions.exprs import iso_text, iso_timestamp, number

# Fixed header mapping of provider exports.
EXPORT_COLUMNS = {
    "usage_start_time": "timestamp",
    "project.id": "account_id",
    "project_id": "account_id",
    "service.description": "service",
    "service_description": "service",
    "location.region": "region",
    "location_region": "region",
    "cost": "cost_amount",
    "usage.amount": "usage_amount",
    "usage.unit": "usage_unit",
}
EXPORT_SIGNS = {"usage_start_time", "project.id", "service.description", "cost"}
UPLOAD_REQUIRED = ("timestamp", "account_id", "service", "region", "cost_amount", "usage_amount")


@dataclass
class CsvLoad:
    """``rows`` holds every data row; ``error`` is NULL for accepted ones."""

    rows: DataFrame
    provider_export: bool

    def accepted(self) -> DataFrame:
        return self.rows.filter(F.col("error").isNull()).select(*CANONICAL_FIELDS)

    def summary(self, max_errors: int = 10) -> DataFrame:
        """One row: accepted, failed, total and up to ``max_errors`` messages.

        The messages kept are the first by text, so repeated runs agree.
        """
        counts = self.rows.agg(
            F.count_if(F.col("error").isNull()).alias("accepted"),
            F.count_if(F.col("error").isNotNull()).alias("failed"),
            F.count(F.lit(1)).alias("total"),
        )
        kept = (
            self.rows.filter(F.col("error").isNotNull()).select("error").orderBy("error").limit(max_errors)
            .agg(F.array_sort(F.collect_list("error")).alias("errors"))
        )
        one = F.lit(1).alias("_one")
        return counts.select("*", one).join(F.broadcast(kept.select("*", one)), "_one").drop("_one")


def header_map(columns: list[str]) -> tuple[dict[str, str], bool]:
    """Name each CSV column is used under, and whether it is a provider export."""
    lowered = {c: c.strip().lower() for c in columns}
    export = len(set(lowered.values()) & EXPORT_SIGNS) >= 2
    return ({c: EXPORT_COLUMNS.get(k, k) if export else k for c, k in lowered.items()}, export)


def _occurrence(df: DataFrame):
    """The frame and the number (from 0) of each row among those of its ``_key``.

    Rows are numbered inside their input partition and the earlier partitions'
    counts added, so many equal rows are not numbered in one task.
    """
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = placed.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_key", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_at")) - 1
    return placed.join(counts, ["_key", "_part"]).withColumn("_nth", F.col("_ahead") + inside), F.col("_nth")


def load_billing_csv(spark: SparkSession, path: str, multi_line: bool = False) -> CsvLoad:
    """Read billing CSV files; bad rows are marked, not dropped.

    Rows of a provider export whose ``cost_type`` is given and not ``regular``
    (tax, adjustments) are skipped, as they are not usage. Rows of equal
    content are usage of their own and get ids by occurrence. With
    ``multi_line`` quoted fields may hold line breaks; a file is then one task.
    """
    # files are read by position, so a file whose header differs is refused
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', enforceSchema=False, multiLine=multi_line)
    names, export = header_map(raw.columns)
    missing = sorted(set(UPLOAD_REQUIRED) - set(names.values()))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    wanted: dict[str, str] = {}
    for original, target in names.items():
        wanted[target] = original  # a later duplicate header wins
    df = raw.select(*[F.col(f"`{o}`").alias(t) for t, o in wanted.items()])
    if export and "cost_type" in df.columns:
        kind = F.lower(F.trim(F.coalesce("cost_type", F.lit(""))))
        df = df.filter(kind.isin("", "regular"))

    def optional(name: str, default: str, blank: str):
        if name not in df.columns:
            return F.lit(default)
        text = F.trim(F.coalesce(F.col(name), F.lit("")))
        return F.when(text == "", F.lit(blank)).otherwise(text)

    ts = iso_timestamp(F.trim("timestamp"))
    cost, usage = number(F.col("cost_amount")), number(F.col("usage_amount"))
    error = (
        F.when(ts.isNull(), F.concat(F.lit("bad timestamp: "), F.coalesce("timestamp", F.lit(""))))
        .when(F.col("account_id").isNull() | F.col("service").isNull() | F.col("region").isNull(), F.lit("missing field"))
        .when(cost.isNull(), F.concat(F.lit("bad cost_amount: "), F.coalesce("cost_amount", F.lit(""))))
        .when(usage.isNull(), F.concat(F.lit("bad usage_amount: "), F.coalesce("usage_amount", F.lit(""))))
    )
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns])
    df, nth = _occurrence(df.withColumn("_key", F.sha2(key, 256)))
    rows = df.select(
        F.when(nth == 0, F.col("_key")).otherwise(F.sha2(F.concat_ws("|", "_key", nth), 256)).alias("event_id"),
        ts.alias("timestamp"),
        optional("provider", "gcp" if export else "custom", "custom").alias("provider"),
        F.trim("account_id").alias("account_id"),
        F.trim("service").alias("service"),
        F.trim("region").alias("region"),
        F.round(cost, 6).alias("cost_amount"),
        F.round(usage, 6).alias("usage_amount"),
        optional("usage_unit", "units", "units").alias("usage_unit"),
        F.create_map().cast("map<string,string>").alias("tags"),
        F.lit("training_uploaded").alias("source_type"),
        error.alias("error"),
    )
    return CsvLoad(rows, export)


def training_export(events: DataFrame) -> DataFrame:
    """Training rows in time order as exported, sources by their short names."""
    source = F.when(F.col("source_type") == "training_generated", F.lit("generated")).otherwise(F.lit("uploaded"))
    return (
        events.filter(F.col("source_type").isin(*TRAINING_SOURCES))
        .orderBy("timestamp", "event_id")
        .select(
            iso_text(F.col("timestamp")).alias("timestamp"), "provider", "account_id", "service", "region",
            F.col("cost_amount").cast("double").alias("cost_amount"),
            F.col("usage_amount").cast("double").alias("usage_amount"),
            "usage_unit", source.alias("source"))
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls included, files in parallel."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
