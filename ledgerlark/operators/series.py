"""Bucket rollup and the windows over bucketed series.

Rolling operators use bounded row frames only, so a long series can be cut
into blocks that carry a few neighbour rows ("halo") and be computed in
parallel with identical results. ``date_trunc`` to an hour or coarser bounds a
series by the calendar (a century of hours is under 900 000 rows) and is run
uncut; finer grains and raw events are cut, so one hot account never becomes
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..config import KEYS
from ..functions.exprs import join_on

COARSE_UNITS = ("hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class SplitConfig:
    """Rows are placed per time segment, then cut into blocks of equal length."""

    segment_seconds: int = 60
    block_rows: int = 100_000


def bucket_rollup(
    events: DataFrame,
    unit: str = "hour",
    keys: Sequence[str] = KEYS,
    ts: str = "timestamp",
    cost: str = "cost_amount",
    usage: str = "usage_amount",
) -> DataFrame:
    """Sum of cost and usage and the event count per truncated time and key.

    Partial aggregation runs before the one shuffle, so a key holding a large
    share of the raw rows arrives as one row per bucket and map task. Sums are
    kept at the six decimals money is stored with.
    """
    return events.groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket"), *keys).agg(
        F.round(F.sum(cost), 6).alias("total_cost"),
        F.round(F.sum(usage), 6).alias("total_usage"),
        F.count(F.lit(1)).alias("event_count"),
    )


def needs_split(unit: str) -> bool:
    return unit not in COARSE_UNITS


def split_for(unit: str) -> SplitConfig | None:
    """How series rolled up to ``unit`` are cut: not at all where the calendar bounds them."""
    return SplitConfig() if needs_split(unit) else None


def tag_segments(df: DataFrame, order: str = "bucket", seconds: int = 86_400) -> DataFrame:
    """Adds ``_segment``, the number of the time segment a row lies in."""
    return df.withColumn("_segment", F.floor(F.unix_micros(F.col(order).cast("timestamp")) / (seconds * 1_000_000)))


def segment_counts(tagged: DataFrame, keys: Sequence[str] = KEYS, **sums: Column) -> DataFrame:
    """One row per key and segment: ``_rows`` in it, ``_ahead`` in earlier segments, ``_total`` in the series, and sums of columns."""
    keys = list(keys)
    series = Window.partitionBy(*keys)
    earlier = series.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return counts.withColumns({"_ahead": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_total": F.sum("_rows").over(series)})


def place(tagged: DataFrame, counts: DataFrame, name: str = "pos", keys: Sequence[str] = KEYS, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """0-based position in the series, and ``_total``, from the counts of its segments."""
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    joined = join_on(tagged, counts.select(*keys, "_segment", "_ahead", "_total"), [*keys, "_segment"])
    return joined.withColumn(name, F.col("_ahead") + F.row_number().over(inside) - 1).drop("_ahead", "_segment")


def with_positions(df: DataFrame, name: str = "pos", keys: Sequence[str] = KEYS, order: Sequence[str] = ("bucket",),
                   segment_seconds: int = 86_400) -> DataFrame:
    """0-based position of every row in its series, without one task per series.

    Rows are numbered inside a time segment; the rows of all earlier segments
    are added from a table of one count per key and segment.
    """
    tagged = tag_segments(df, order[0], segment_seconds)
    return place(tagged, segment_counts(tagged, keys), name, keys, order).select(*df.columns, name)


def over_series(
    df: DataFrame,
    fn: Callable[[DataFrame, Sequence[str]], DataFrame],
    before: int,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("bucket",),
    split: SplitConfig | None = None,
) -> DataFrame:
    """Apply ``fn(frame, partition_keys)`` per series, cut into blocks if asked.

    ``fn`` may look at most ``before`` rows back and ``after`` rows ahead and
    must keep all columns. ``order[0]`` is a timestamp.
    """
    if split is None:
        return fn(df, list(keys))
    size = split.block_rows
    if max(before, after) > size:
        raise ValueError("block_rows must be at least the halo")
    keys = list(keys)
    placed = with_positions(df, "_pos", keys, order, split.segment_seconds)
    block = F.floor(F.col("_pos") / size)
    own = F.struct(block.alias("_block"), F.lit(False).alias("_halo"))
    to_next = F.when(
        F.col("_pos") >= (block + 1) * size - before,
        F.struct((block + 1).alias("_block"), F.lit(True).alias("_halo")))
    to_prev = F.when(
        (block > 0) & (F.col("_pos") < block * size + after),
        F.struct((block - 1).alias("_block"), F.lit(True).alias("_halo")))
    blocks = (
        placed.withColumn("_b", F.explode(F.array_compact(F.array(own, to_next, to_prev))))
        .select(*df.columns, "_b._block", "_b._halo")
    )
    return fn(blocks, [*keys, "_block"]).filter(~F.col("_halo")).drop("_block", "_halo")


def series_window(keys: Sequence[str] = KEYS, order: Sequence[str] = ("bucket",)):
    return Window.partitionBy(*keys).orderBy(*order)
