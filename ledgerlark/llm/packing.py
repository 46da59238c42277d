"""Conflict-constrained best-fit packing into sequences of a fixed capacity.

Open bins are ordered by residual. Each carries what it holds as bitmaps: one
per duplicate cluster, and per source one of the bins where that source has
reached its limit. For an item the search starts at the smallest residual that
holds it and goes to the successor until some bin of that residual conflicts
neither with the item's source nor its cluster: the tightest compatible bin.
Items come by falling size (then id), as best-fit-decreasing.

Bins never cross cells. A cell is a hash class of documents of bounded
expected size, so all bins of a cell fit one task at any input size, while the
number of cells grows with the input. A source or cluster that holds a third
of all rows is spread over all cells like any other.

Defined results: a NULL or empty text has size 0 and takes a place in a bin; a
text longer than the capacity is cut into full bins of its own and one
remainder that is packed; NULL sources and clusters conflict with nothing;
equal rows are packed one by one, ties by row order in the cell's sort; an
empty table gives no placement.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

CELL_ITEMS = 4096


@dataclass(frozen=True)
class PackingConfig:
    capacity: int = 2048
    #: Most items of one source in a bin; one of each duplicate cluster.
    per_source: int = 4
    cell_items: int = CELL_ITEMS


class Bins:
    """Bins of one cell by residual, with conflict bitmaps over bin numbers."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residual: list[int] = []
        self.at: dict[int, int] = {}  # residual -> bitmap of bins
        self.present = 0  # bitmap of residuals that some bin has
        self.full_source: dict = {}  # source -> bitmap of bins at its limit
        self.in_bin: dict = {}  # (source, bin) -> items
        self.cluster: dict = {}  # cluster -> bitmap of bins

    def _move(self, b: int, old: int | None, new: int) -> None:
        if old is not None:
            self.at[old] &= ~(1 << b)
            if not self.at[old]:
                self.present &= ~(1 << old)
        self.at[new] = self.at.get(new, 0) | 1 << b
        self.present |= 1 << new
        self.residual[b] = new

    def open(self) -> int:
        self.residual.append(self.capacity)
        self._move(len(self.residual) - 1, None, self.capacity)
        return len(self.residual) - 1

    def best(self, size: int, source, cluster) -> int | None:
        """Tightest bin that holds the size and conflicts with neither."""
        taken = (self.full_source.get(source, 0) if source is not None else 0) | (self.cluster.get(cluster, 0) if cluster is not None else 0)
        left = self.present >> size
        r = size
        while left:
            step = (left & -left).bit_length() - 1
            r, left = r + step, left >> step
            free = self.at[r] & ~taken
            if free:
                return (free & -free).bit_length() - 1
            left &= ~1
        return None

    def put(self, b: int, size: int, source, cluster) -> int:
        """Place an item; gives its offset in the bin."""
        old = self.residual[b]
        self._move(b, old, old - size)
        if source is not None:
            n = self.in_bin[source, b] = self.in_bin.get((source, b), 0) + 1
            if n >= self.per_source:
                self.full_source[source] = self.full_source.get(source, 0) | 1 << b
        if cluster is not None:
            self.cluster[cluster] = self.cluster.get(cluster, 0) | 1 << b
        return self.capacity - old


def pack_cell(items: list[tuple[int, object, object]], config: PackingConfig) -> list[tuple[int, int, int, int]]:
    """(item number, first token, bin, offset in the bin) of every placed piece.

    Items are (size, source, cluster) in packing order. Bins of cut texts come
    after the shared ones.
    """
    bins = Bins(config.capacity, config.per_source)
    out, whole = [], []
    for i, (size, source, cluster) in enumerate(items):
        cut = size // config.capacity if size > config.capacity else 0
        whole += [(i, k * config.capacity) for k in range(cut)]
        rest = size - cut * config.capacity
        if cut and not rest:
            continue
        b = bins.best(rest, source, cluster)
        if b is None:
            b = bins.open()
        out.append((i, cut * config.capacity, b, bins.put(b, rest, source, cluster)))
    n = len(bins.residual)
    return out + [(i, first, n + k, 0) for k, (i, first) in enumerate(whole)]


def pack(docs: DataFrame, size: str, source: str | None, cluster: str | None, id_col: str = "doc_id",
         config: PackingConfig = PackingConfig()) -> DataFrame:
    """Placements: doc_id, piece, n_tokens, cell, bin, position.

    Only ids, sizes, sources and clusters are shuffled, never texts. Rows are
    counted once to set the number of cells.
    """
    capacity = config.capacity
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(size).cast("long").alias("size"),
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"),
        (F.col(cluster).cast("long") if cluster else F.lit(None).cast("long")).alias("cluster"))
    cells = max(1, -(-docs.count() // config.cell_items))
    # rows without an id spread by their place in the input
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "source", "cluster", place), F.lit(cells)))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_id=group["doc_id"].fillna(-1)).sort_values(["size", "_id"], ascending=[False, True], kind="stable")
        ids, sizes = group["doc_id"].tolist(), group["size"].astype("int64").tolist()
        some = lambda x: None if pd.isna(x) else x
        items = list(zip(sizes, map(some, group["source"].tolist()), map(some, group["cluster"].tolist())))
        placed = pack_cell(items, config)
        return pd.DataFrame({
            "doc_id": pd.array([some(ids[i]) for i, *_ in placed], "Int64"), "piece": [first // capacity for _, first, _, _ in placed],
            "n_tokens": [min(capacity, sizes[i] - first) for i, first, _, _ in placed], "cell": int(key[0]),
            "bin": [b for _, _, b, _ in placed], "position": [p for *_, p in placed]})

    return rows.groupBy("cell").applyInPandas(run, "doc_id bigint, piece int, n_tokens bigint, cell bigint, bin int, position int")
