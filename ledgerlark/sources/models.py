"""Fitted detectors in a versioned table, one nested record per version.

A version is a folder with one JSON line, written by Spark and complete once its
marker is there, like every version of ``tables``. The folder is a table: Spark
reads any number of versions with ``MODEL_SCHEMA``. A scoring job that needs one
model reads its line straight through the file system, so that building the
scoring plan starts no Spark job; a record is bounded by the detector's own
limits (trees x nodes, features x components), never by the training rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.detectors import KINDS, MODEL_SCHEMA, IsolationForest, Reconstruction
from . import tables


def save(spark: SparkSession, model: IsolationForest | Reconstruction, root: str, version: str | None = None) -> str:
    """Writes the model as a new version; a version that exists is never written again."""
    tag = version or tables.version_tag()
    if tag in tables.list_versions(spark, root):
        raise FileExistsError(f"version {tag} is in {root} already")
    rows = spark.createDataFrame([model.record(tag)], MODEL_SCHEMA)
    # an unfinished attempt of the same name has no marker and may be replaced
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/{tag}")
    return tag


def records(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The table: a row for each complete version, or for one of them."""
    known = tables.list_versions(spark, root)
    wanted = known if version is None else [v for v in known if v == version]
    if not wanted:
        return spark.createDataFrame([], MODEL_SCHEMA)
    return spark.read.schema(MODEL_SCHEMA).json([f"{root}/{v}" for v in wanted])


def load(spark: SparkSession, root: str, version: str | None = None) -> IsolationForest | Reconstruction:
    """The newest version unless one is named, without a Spark job."""
    known = tables.list_versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version or 'at all'} in {root}; known: {known}")
    fs, folder = tables.file_system(spark, f"{root}/{version or known[-1]}")
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("part-") and status.getLen():
            stream = fs.open(status.getPath())
            try:
                text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
            finally:
                stream.close()
            r = json.loads(text)
            return KINDS[r["kind"]].from_record(r)
    raise FileNotFoundError(f"version {version or known[-1]} of {root} holds no record")


def prune(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Deletes all but the newest ``keep`` versions; the tags that went."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    gone = tables.list_versions(spark, root)[:-keep]
    for tag in gone:
        fs, folder = tables.file_system(spark, f"{root}/{tag}")
        fs.delete(folder, True)
    return gone


def versions(spark: SparkSession, root: str) -> DataFrame:
    """model_version, kind, train_rows, oldest first."""
    return records(spark, root).select("model_version", "kind", "train_rows").orderBy(F.col("model_version"))
