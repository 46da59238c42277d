"""Tables kept as immutable versions, and the merges that make a new version.

Plain parquet has no row updates, so every change is a function from the
current table to the next one; ``write_version`` publishes it under a new
folder and readers take the newest complete one. A lost executor or a retried
job therefore never leaves a half-changed table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import KEYS, STATUSES, TRAINING_SOURCES
from . import day_table
from .day_table import file_system

ANOMALY_KEY = (*KEYS, "bucket")


# -- versioned folders -------------------------------------------------------------


def list_versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions in ascending order; unfinished ones lack the marker, or the manifest of a table kept by day."""
    by_day = day_table.versions(spark, root)
    if by_day is not None:
        return by_day
    fs, hroot = file_system(spark, root)
    if not fs.exists(hroot):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hroot)]
    return sorted(n for n in names if fs.exists(file_system(spark, f"{root}/{n}/_SUCCESS")[1]))


def version_tag() -> str:
    """Tags sort by time."""
    return datetime.now(timezone.utc).strftime("v%Y%m%d_%H%M%S_%f")


def write_version(df: DataFrame, root: str, version: str | None = None) -> str:
    tag = version or version_tag()
    df.write.mode("errorifexists").parquet(f"{root}/{tag}")
    return tag


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    known = list_versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version or 'at all'} in {root}; known: {known}")
    if day_table.versions(spark, root) is not None:
        return day_table.read(spark, root, version or known[-1])
    return spark.read.parquet(f"{root}/{version or known[-1]}")


# -- appends and merges --------------------------------------------------------------


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. An aggregate, not a window: copies of one key are
    reduced before the shuffle, so a key with very many copies stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def append_events(table_ids: DataFrame | None, batch: DataFrame, arrived: str = "ingested_at",
                  tie: str = "seq") -> DataFrame:
    """Rows of ``batch`` to append: first arrival per id, ids not stored yet."""
    fresh = first_per_key(batch, ["event_id"], [F.col(arrived), F.col(tie)])
    return fresh if table_ids is None else fresh.join(table_ids.select("event_id"), "event_id", "left_anti")


def append_receipt(batch: DataFrame, appended: DataFrame) -> DataFrame:
    """One row: accepted, duplicate and total counts."""
    total = batch.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("_one"))
    kept = appended.agg(F.count(F.lit(1)).alias("accepted"), F.lit(1).alias("_one"))
    # both sides are single rows
    return total.join(F.broadcast(kept), "_one").select(
        "accepted", (F.col("total") - F.col("accepted")).alias("duplicate"), "total")


def anomaly_id() -> Column:
    """A digest of key and bucket. Parts that are NULL or hold the separator are told apart by their JSON."""
    parts = [*[F.col(k) for k in KEYS], F.col("bucket").cast("string")]
    plain = F.lit(True)
    for p in parts:
        plain = plain & F.coalesce(~F.contains(p, F.lit("|")), F.lit(False))
    named = F.to_json(F.struct(*[p.alias(c) for p, c in zip(parts, ANOMALY_KEY)]))
    return F.md5(F.when(plain, F.concat_ws("|", *parts)).otherwise(named))


def new_anomalies(scored: DataFrame, detected_at: Column, breakdown: str | None = None) -> DataFrame:
    """Anomaly records of a scored frame: flagged rows, one per key and bucket."""
    rows = scored.filter(F.col("is_anomaly") == 1).select(
        *ANOMALY_KEY,
        F.round(F.col("anomaly_score"), 6).alias("anomaly_score"),
        (F.col("severity") if "severity" in scored.columns else F.lit("none")).alias("severity"),
        (F.col(breakdown) if breakdown else F.lit(None).cast("string")).alias("score_breakdown"),
    )
    single = first_per_key(rows, ANOMALY_KEY, [-F.col("anomaly_score"), F.col("severity"), F.col("score_breakdown")])
    return single.select(
        anomaly_id().alias("anomaly_id"),
        *ANOMALY_KEY, "anomaly_score", "severity", "score_breakdown",
        F.lit("open").alias("status"), detected_at.alias("detected_at"))


def upsert_anomalies(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next version of the anomaly table.

    A known key takes the incoming score, severity and breakdown and keeps its
    id, status and detection time; an unknown key is inserted as given.
    """
    keep = ("anomaly_id", "status", "detected_at")
    take = ("anomaly_score", "severity", "score_breakdown")
    t = table.withColumn("_old", F.lit(True)).alias("t")
    i = incoming.withColumn("_new", F.lit(True)).alias("i")
    joined = t.join(i, [F.col(f"t.{k}").eqNullSafe(F.col(f"i.{k}")) for k in ANOMALY_KEY], "full_outer")

    def value(c: str) -> Column:
        if c in keep:
            return F.when(F.col("t._old"), F.col(f"t.{c}")).otherwise(F.col(f"i.{c}"))
        if c in take:
            return F.when(F.col("i._new"), F.col(f"i.{c}")).otherwise(F.col(f"t.{c}"))
        if c in ANOMALY_KEY:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"i.{c}"))
        return F.col(c)

    return joined.select(*[value(c).alias(c) for c in table.columns])


def change_status(table: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next table version and audit rows for ``(anomaly_id, new_status, actor)`` updates.

    Any of the four states may follow any other. Of several updates of one
    anomaly the table takes the newest, the audit has all. Unknown ids are
    ignored.
    """
    valid = updates.filter(F.col("new_status").isin(*STATUSES)).select("anomaly_id", "new_status", "actor", "changed_at")
    newest = valid.groupBy("anomaly_id").agg(F.max_by("new_status", F.struct("changed_at", "new_status")).alias("_status"))
    nxt = table.join(newest, "anomaly_id", "left").withColumn("status", F.coalesce("_status", "status")).select(*table.columns)
    joined = table.join(valid, "anomaly_id")
    audit = joined.filter(F.col("new_status").isNotNull()).select(
        F.md5(F.concat_ws("|", F.lit("status"), "anomaly_id", F.col("changed_at").cast("string"))).alias("audit_id"),
        F.lit("anomaly").alias("event_type"),
        F.lit("status_change").alias("action"),
        F.lit("success").alias("outcome"),
        F.col("actor").alias("user_id"),
        F.lit("anomaly").alias("target_type"),
        F.col("anomaly_id").alias("target_id"),
        F.to_json(F.struct("new_status")).alias("meta"),
        F.col("changed_at").alias("created_at"),
    )
    return nxt, audit


def purge(events: DataFrame, anomalies: DataFrame, alerts: DataFrame, mode: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables after a purge and one row of deleted counts.

    ``training`` removes generated and uploaded events only; any other mode
    removes synthetic events and all anomalies and alerts.
    """
    if mode == "training":
        doomed = F.col("source_type").isin(*TRAINING_SOURCES)
        kept = {"events": events.filter(~doomed), "anomalies": anomalies, "alerts": alerts}
        return kept, events.agg(
            F.count_if(doomed).alias("events_deleted"),
            F.lit(0).cast("long").alias("anomalies_deleted"), F.lit(0).cast("long").alias("alerts_deleted"))
    doomed = F.col("source_type") == "synthetic"
    kept = {"events": events.filter(~doomed), "anomalies": anomalies.limit(0), "alerts": alerts.limit(0)}
    parts = (
        events.agg(F.count_if(doomed).alias("n")).select(F.lit("events").alias("t"), "n")
        .unionAll(anomalies.agg(F.count(F.lit(1)).alias("n")).select(F.lit("anomalies"), "n"))
        .unionAll(alerts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("alerts"), "n"))
    )
    counts = parts.agg(*[
        F.max(F.when(F.col("t") == t, F.col("n"))).alias(f"{t}_deleted") for t in ("events", "anomalies", "alerts")])
    return kept, counts


# -- model versions ------------------------------------------------------------------


def register_model(registry: DataFrame | None, profile: DataFrame, version: str,
                   params: Mapping[str, float | int | str] | None = None) -> DataFrame:
    """Registry with one more model version; settings travel with the rows."""
    meta = F.to_json(F.create_map(*[x for k, v in sorted((params or {}).items()) for x in (F.lit(k), F.lit(str(v)))])) \
        if params else F.lit("{}")
    rows = profile.withColumns({"model_version": F.lit(version), "config": meta})
    return rows if registry is None else registry.unionByName(rows)


def model_versions(registry: DataFrame) -> DataFrame:
    """Version tags, oldest first, with their training row counts."""
    pooled = F.max(F.when(F.col("hour_of_day") == -1, F.col("n")))
    return registry.groupBy("model_version").agg(pooled.alias("train_rows")).orderBy("model_version")


def load_model(registry: DataFrame, version: str | None = None) -> DataFrame:
    """Rows of one version, the newest unless named. Tags sort by time."""
    if version is not None:
        return registry.filter(F.col("model_version") == version)
    newest = registry.agg(F.max("model_version").alias("model_version"))
    return registry.join(F.broadcast(newest), "model_version", "left_semi")


def prune_models(registry: DataFrame, keep: int = 5) -> DataFrame:
    """Registry with only the newest ``keep`` versions (169 rows each)."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    newest = registry.select("model_version").distinct().orderBy(F.col("model_version").desc()).limit(keep)
    return registry.join(F.broadcast(newest), "model_version", "left_semi")


