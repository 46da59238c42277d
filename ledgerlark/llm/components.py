"""Connected components and class links, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written below the shared folder and read back: lineage ends there, and
    the files outlive any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    Its cleaner follows the driver's garbage collection, which may be half an
    hour away; a step that writes large shuffles one after the other would hold
    them all on disk till then.
    """
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(id, comp): the smallest id of the component of every id in an edge.

    Alternating star contraction: each round every node points its larger
    neighbours, then its smaller ones, at its least neighbour, until every edge
    points at a root. Only minima are aggregated, so a node with many
    neighbours costs its own edges and no group is gathered. Edges with a NULL
    end or equal ends are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "components")
    before = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stored(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        discard(last)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots)
