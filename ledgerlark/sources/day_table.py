"""A table kept by day: each version is a manifest that names one folder per day.

A merge reads and writes the days it touches and nothing else; the next version's
manifest takes over all other days as they are. The manifest is put in place by
one rename, so a reader sees a version whole or not at all, and a job that is run
again finds its version committed. Folders that no kept manifest names any more
are deleted with the manifests that go.

    root/_manifests/<version>.json      {"schema": ..., "days": {"2024-01-07": "data/<folder>/day=2024-01-07"}}
    root/data/<folder>/day=<day>/...    rows, without the day
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"
#: Rows whose time is NULL have a day of their own.
NO_DAY = "none"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def versions(spark: SparkSession, root: str) -> list[str] | None:
    """Committed versions in ascending order; None where there is no table of this kind."""
    fs, folder = file_system(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, root: str, version: str) -> dict:
    fs, path = file_system(spark, f"{root}/{MANIFESTS}/{version}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, version: str, schema: StructType, days: dict[str, str]) -> bool:
    """Puts a version's manifest in place; False where another writer has done so."""
    fs, target = file_system(spark, f"{root}/{MANIFESTS}/{version}.json")
    _, draft = file_system(spark, f"{root}/{MANIFESTS}/_{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "days": days}).encode()))
    finally:
        out.close()
    if not fs.exists(target) and fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False


def read(spark: SparkSession, root: str, version: str, days: Sequence[str] | None = None) -> DataFrame:
    """A version, or some of its days. Only the named days' folders are listed."""
    m = manifest(spark, root, version)
    schema = StructType.fromJson(m["schema"])
    folders = [f"{root}/{f}" for d, f in sorted(m["days"].items()) if days is None or d in days]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def day_of(column: Column) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit(NO_DAY))


def merge(spark: SparkSession, root: str, version: str, incoming: DataFrame, time: str, apply: Callable[[DataFrame, DataFrame], DataFrame],
          keep: int = 5) -> list[str]:
    """Commits ``apply(table, incoming)`` as ``version``; the days it wrote.

    ``apply`` must not move rows between days. A version that is committed, or
    older than the newest one, is left as it is, so a replayed batch does
    nothing. The days (one row each) pass through the driver.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    known = versions(spark, root) or []
    touched = sorted(r["day"] for r in incoming.select(day_of(F.col(time)).alias("day")).distinct().collect())
    if known and version <= known[-1]:
        return []
    days = manifest(spark, root, known[-1])["days"] if known else {}
    current = read(spark, root, known[-1], touched) if known else spark.createDataFrame([], incoming.schema)
    nxt = apply(current, incoming) if known else incoming
    folder = f"data/{version}-{uuid.uuid4().hex[:8]}"
    if touched:
        nxt.withColumn("day", day_of(F.col(time))).repartition("day").write.partitionBy("day").parquet(f"{root}/{folder}")
    if commit(spark, root, version, nxt.schema, {**days, **{d: f"{folder}/day={d}" for d in touched}}):
        prune(spark, root, keep)
        return touched
    return []


def prune(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Deletes all but the newest ``keep`` manifests, and the day folders only they named."""
    known = versions(spark, root) or []
    gone, kept = known[:-keep], known[-keep:]
    used = {f for v in kept for f in manifest(spark, root, v)["days"].values()}
    for v in gone:
        for f in set(manifest(spark, root, v)["days"].values()) - used:
            fs, path = file_system(spark, f"{root}/{f}")
            fs.delete(path, True)
        fs, path = file_system(spark, f"{root}/{MANIFESTS}/{v}.json")
        fs.delete(path, False)
    return gone
