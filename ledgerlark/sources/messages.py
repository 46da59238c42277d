"""Published events, anomaly messages and the dead-letter store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import CANONICAL_FIELDS, REQUIRED_FIELDS
from ..functions.exprs import iso_text

DEAD_LETTER_FIELDS = ("failed_at", "stream", "message_id", "error", "raw_payload")
DEAD_LETTER_SCHEMA = ", ".join(f"{f} STRING" for f in DEAD_LETTER_FIELDS)
ANOMALY_FIELDS = (
    "anomaly_id", "account_id", "service", "region", "bucket", "anomaly_score", "severity", "status", "detected_at",
)


def missing_fields(events: DataFrame) -> Column:
    """Comma list of required canonical fields without a value, in order."""
    have = set(events.columns)
    return F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f).isNull(), F.lit(f)) if f in have else F.lit(f) for f in REQUIRED_FIELDS])), ", ")


def event_json(events: DataFrame) -> Column:
    fields = [
        iso_text(F.col(f)).alias(f) if f == "timestamp" else F.col(f) if f in events.columns
        else F.lit(None).cast("map<string,string>").alias(f)
        for f in CANONICAL_FIELDS
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def route_events(events: DataFrame, base: str = "billing-events",
                 scopes: tuple[str, ...] = ("global", "provider", "account")) -> DataFrame:
    """``route, event_id, value``: each valid event once per requested scope."""
    routes = {
        "global": F.lit(base),
        "provider": F.concat(F.lit(f"{base}.provider."), F.col("provider")),
        "account": F.concat(F.lit(f"{base}.account."), F.col("account_id")),
    }
    valid = events.filter(missing_fields(events) == "").withColumn("value", event_json(events))
    return valid.select(F.explode(F.array(*[routes[s] for s in scopes])).alias("route"), "event_id", "value")


def write_routes(routed: DataFrame, path: str) -> None:
    """File sink, one folder per route. For a broker, alias ``route`` to its topic column."""
    routed.write.mode("append").partitionBy("route").json(path)


def anomaly_messages(anomalies: DataFrame, include_breakdown: bool = False) -> DataFrame:
    """``anomaly_id, value``: one JSON message per anomaly, ISO UTC times."""
    fields = [
        iso_text(F.col(f)).alias(f) if f in ("bucket", "detected_at")
        else F.col(f).cast("double").alias(f) if f == "anomaly_score" else F.col(f)
        for f in ANOMALY_FIELDS
    ]
    if include_breakdown and "score_breakdown" in anomalies.columns:
        fields.append(F.col("score_breakdown"))
    else:
        fields.append(F.lit(None).cast("string").alias("score_breakdown"))
    return anomalies.select("anomaly_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


# -- dead letters -----------------------------------------------------------------


def write_dead_letters(records: DataFrame, path: str) -> None:
    records.select(*DEAD_LETTER_FIELDS).write.mode("append").option("ignoreNullFields", "false").json(path)


#: Where a line stands: when its file was written, the file, the block of it that a task reads, the order there.
POSITION = ("_written", "_file", "_block", "_line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty dead-letter lines and their positions; a folder that does not exist has none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "value STRING, _written TIMESTAMP, _file STRING, _block LONG, _line LONG")
    lines = spark.read.text(path).select(
        F.trim("value").alias("value"), F.col("_metadata.file_modification_time").alias("_written"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return lines.filter(F.col("value") != "")


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("value") != "").agg(F.count(F.lit(1)).alias("records"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Decoded object records with ``missing`` (absent required fields); others skipped."""
    obj = F.when(F.ltrim("value").startswith("{"), F.from_json("value", "map<string,string>"))
    df = lines.select("value", obj.alias("_o")).filter(F.col("_o").isNotNull())
    missing = F.array_compact(F.array(*[
        F.when(~F.map_contains_key("_o", f), F.lit(f)) for f in DEAD_LETTER_FIELDS]))
    return df.select(
        *[F.try_element_at("_o", F.lit(f)).alias(f) for f in DEAD_LETTER_FIELDS],
        F.array_join(missing, ",").alias("missing"))


def tail(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest records. The tail is taken over all lines, malformed ones
    included, and only then are malformed lines dropped. Lines of
    :func:`read_lines` have a place in their files, and newest means last; for
    others it means ``failed_at`` then ``message_id``."""
    if limit is not None:
        if set(POSITION) <= set(lines.columns):
            newest = [F.col(c).desc() for c in POSITION]
        else:
            newest = [F.get_json_object("value", "$.failed_at").desc_nulls_last(),
                      F.get_json_object("value", "$.message_id").desc_nulls_last(), F.col("value").desc()]
        lines = lines.orderBy(*newest).limit(limit)
    return parse_lines(lines)


def replay(lines: DataFrame, limit: int | None = None, stream_override: str | None = None) -> DataFrame:
    """``stream, message_id, value`` of the complete records, ready to normalise again."""
    records = tail(lines, limit).filter(F.col("missing") == "")
    stream = F.lit(stream_override) if stream_override else F.col("stream")
    return records.select(stream.alias("stream"), "message_id", F.col("raw_payload").alias("value"))
