"""Centroid clustering of integer vectors by equal-average equal-variance search.

Lloyd's rounds over quantised vectors: every vector goes to its nearest
centroid, every centroid to the floor of its vectors' mean. The nearest centroid
is found without measuring all of them. Centroids lie sorted by component mean;
a vector starts at its own mean and scans outward on both sides. With d
components, means m and deviations s,

    distance >= d * (m_x - m_c)^2                          (equal average)
    distance >= d * (m_x - m_c)^2 + d * (s_x - s_c)^2      (equal variance)

so the scan of a vector ends where the first bound passes its best distance,
and skips centroids whose second bound does. Both bounds are taken in floating
point with a margin that only ever lets too much through; what is not rejected
is measured in exact integers, so the answer is that of a full search, ties
going to the smaller centroid number.

A round is one scan of the stored integer table: tasks add up their vectors per
centroid, Spark adds the tasks, and k x d sums reach the driver, whatever the
table's size. The centroids travel in the task closure (k x d numbers).

Defined results: a vector takes part if it has exactly ``dims`` components, none
NULL or non-finite. Rows without an id take part and are seeds only where too
few others exist; rows that share an id are separate vectors, ties between
their seeds going to the smaller components. With fewer vectors than centroids
every vector is a seed. An empty table gives no rows. A component that reaches
2^27 once quantised cannot have its distance held in a long and is an error.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import stored

#: Quantised components stay below this, so that a squared distance fits a long.
REACH = 1 << 27


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    #: Seeds are the vectors with the smallest SHA-256 of this text and their id.
    seed: str = "3:"


@dataclass
class Clustering:
    """``rows`` has vec_id, cluster, distance; ``inertia`` sums distances by cluster."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: dict[int, int]


class Searcher:
    """Exact nearest centroids of batches of integer vectors."""

    def __init__(self, centroids: np.ndarray):
        c = np.asarray(centroids, np.int64)
        sums = c.sum(1)
        #: Original numbers in order of the component mean.
        self.number = np.argsort(sums, kind="stable")
        self.c, self.sums = c[self.number], sums[self.number]
        self.deviation = _deviation(self.c, self.sums)
        self.top = np.abs(self.c).max(1, initial=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid number, squared distance) of each vector, and how many distances were measured."""
        n, d = x.shape
        k = len(self.c)
        sums = x.sum(1)
        deviation = _deviation(x, sums)
        top = np.abs(x).max(1, initial=0)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k, np.int64)
        measured = 0
        scanning = np.arange(n)
        for _ in range(k):
            r, l, s = right[scanning], left[scanning], sums[scanning]
            ahead = np.where(r < k, self.sums[np.minimum(r, k - 1)] - s, np.iinfo(np.int64).max)
            behind = np.where(l >= 0, s - self.sums[np.maximum(l, 0)], np.iinfo(np.int64).max)
            to_right = ahead <= behind
            right[scanning] += to_right
            left[scanning] -= ~to_right
            at = np.where(to_right, r, l)
            # equal average: the nearer side is out of reach, so the farther is too
            average = np.minimum(ahead, behind).astype(np.float64) ** 2 / d
            reach = best[scanning].astype(np.float64)
            inside = average * (1 - 1e-12) <= reach
            scanning, at, average, reach = scanning[inside], at[inside], average[inside], reach[inside]
            if not len(scanning):
                break
            # equal variance
            margin = 1e-9 * (1.0 + top[scanning] + self.top[at])
            apart = np.maximum(np.abs(deviation[scanning] - self.deviation[at]) - margin, 0.0)
            near = (average + apart * apart) * (1 - 1e-12) <= reach
            v, a = scanning[near], at[near]
            gap = x[v] - self.c[a]
            distance = np.einsum("ij,ij->i", gap, gap)
            measured += len(v)
            who = self.number[a]
            better = (distance < best[v]) | ((distance == best[v]) & (who < number[v]))
            best[v[better]], number[v[better]] = distance[better], who[better]
        return number, best, measured


def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Root of the summed squared distances from the own mean."""
    centred = x - (sums / x.shape[1])[:, None]
    return np.sqrt(np.einsum("ij,ij->i", centred, centred))


def _usable(column, cfg: ClusterConfig) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their quantised components) of a list column."""
    offsets = column.offsets.to_numpy()
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == cfg.dims)
    rows = np.flatnonzero(ok)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a NULL component becomes NaN
    x = values[offsets[:-1][rows][:, None] + np.arange(cfg.dims)] if len(rows) else np.zeros((0, cfg.dims))
    finite = np.isfinite(x).all(1)
    x = np.floor(cfg.scale * x[finite])
    if len(x) and np.abs(x).max() >= REACH:
        raise ValueError(f"a component is beyond {REACH / cfg.scale}: its squared distance does not fit a long")
    return rows[finite], x.astype("<i4")


def quantised(df: DataFrame, cfg: ClusterConfig = ClusterConfig(), id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id and x, the components as little-endian 32-bit integers, of every vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _usable(b.column(1), cfg)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "x"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id bigint, x binary")


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def seeds(rows: DataFrame, cfg: ClusterConfig) -> np.ndarray:
    """The first centroids: at most k vectors, in ascending order of their id's hash."""
    digest = F.sha2(F.concat(F.lit(cfg.seed), F.col("vec_id").cast("string")), 256)
    picked = [np.frombuffer(bytes(r["x"]), "<i4") for r in rows.select("x", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(cfg.k).collect()]
    return np.array(picked, np.int64).reshape(-1, cfg.dims)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; one that no vector chose stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(centroids)
        # the last column counts the vectors
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            number, _, _ = search.nearest(x)
            np.add.at(total, number, np.column_stack([x, np.ones(len(x), np.int64)]))
        cluster, dim = np.divmod(np.arange(total.size), dims + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(total.ravel())], names=["cluster", "dim", "total"])

    sums = rows.select("x").mapInArrow(run, "cluster int, dim int, total bigint").where("total <> 0")
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.groupBy("cluster", "dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = centroids.copy()
    for j in range(k):
        if count := found.get((j, dims), 0):
            out[j] = [found.get((j, i), 0) // count for i in range(dims)]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(centroids)
        for b in batches:
            number, distance, _ = search.nearest(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(df: DataFrame, cfg: ClusterConfig = ClusterConfig(), id_col: str = "vec_id", vec: str = "embedding") -> Clustering:
    """All rounds, then a last assignment."""
    rows = stored(quantised(df, cfg, id_col, vec), "quantised")
    centroids = seeds(rows, cfg)
    if not len(centroids):
        return Clustering(assigned(rows, centroids), centroids, {})
    for _ in range(cfg.rounds):
        nxt = moved(rows, centroids)
        if (nxt == centroids).all():
            break  # every further round would repeat this one
        centroids = nxt
    out = stored(assigned(rows, centroids), "clusters")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    return Clustering(out, centroids, {r["cluster"]: int(r["s"]) for r in sums.collect()})


def digests(c: Clustering) -> DataFrame:
    """Every vector with its cluster's and the whole inertia and its centroid's hash.

    The joined side has one row for each centroid.
    """
    spark = c.rows.sparkSession
    whole = sum(c.inertia.values())
    about = [(j, s, whole, hashlib.sha256(",".join(map(str, c.centroids[j].tolist())).encode()).hexdigest()) for j, s in sorted(c.inertia.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return c.rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
