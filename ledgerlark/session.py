"""Session defaults and the shared folder used for checkpoints and tables."""

from __future__ import annotations

import importlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def build_session(app: str = "ledgerlark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session with the settings the library relies on.

    Shuffle partitions are left to the cluster (and to AQE coalescing) unless
    given; master is left to spark-submit unless given.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder on this machine.
    """
    configured = spark.conf.get(SHARED_DIR_CONF, None)
    if not configured:
        configured = spark.sparkContext.getConf().get(SHARED_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="ledgerlark-")
    spark.conf.set(SHARED_DIR_CONF, local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return os.path.join(shared_dir(spark), label, uuid.uuid4().hex)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so a worker
    must be able to import the package from any working folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ledgerlark-zip-")) / "ledgerlark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
        if (pipeline := root.parent / "corpus_pipeline.py").exists():
            z.write(pipeline, pipeline.name)
    sc.addPyFile(str(archive))
    # a stateful stream also starts a Python process that added files do not reach
    for name in ("config", "functions", "operators", "streaming"):
        cloudpickle.register_pickle_by_value(importlib.import_module(f"ledgerlark.{name}"))
    _shipped.add(sc.applicationId)
