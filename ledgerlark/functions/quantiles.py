"""Exact quantiles that never sort a whole column in one task.

A mergeable sketch first brackets each wanted rank. The bracket is then cut into
equal bins, rows are counted per bin, and only the bins that hold the rank stay.
What is left is ranked, after equal values were counted together map-side. Each
step only narrows where the rank can be, so the result is the exact order
statistic, not an estimate, and the last step sees a few rows whatever the
table's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exprs import join_on

ACCURACY = 10_000
BINS = 4_096


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array column."""
    pos = F.lit(float(p)) * (F.size(ordered) - 1)
    low = F.floor(pos).cast("int")
    a = F.get(ordered, low)
    b = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, a + (b - a) * (pos - low))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    how: str = "linear",
) -> DataFrame:
    """One row per group with one column per name in ``probs``.

    ``how='linear'`` interpolates between neighbours; ``how='ceil'`` takes the
    element at position ``ceil(p*n)`` (1-based, at least 1).
    """
    by = list(by)
    slack = 2.0 / ACCURACY
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    names = list(probs)
    points = [min(1.0, max(0.0, probs[n] + d)) for n in names for d in (-slack, slack)]
    sketch = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", points, ACCURACY).alias("_q"),
    )
    # Below ACCURACY rows the bracket is the whole (bounded) group; above it the
    # slack is worth more than one rank, so both neighbours are inside.
    small = F.col("_n") <= ACCURACY
    wanted = sketch.select(
        *by, "_n", "_min", "_max",
        F.explode(F.array(*[
            F.struct(
                F.lit(n).alias("_name"),
                F.lit(float(probs[n])).alias("_p"),
                F.when(small, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("_lo"),
                F.when(small, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("_hi"),
            )
            for i, n in enumerate(names)
        ])).alias("_w"),
    ).select(*by, "_n", "_w.*")
    if how == "linear":
        pos = F.col("_p") * (F.col("_n") - 1)
        wanted = wanted.withColumn("_k", F.floor(pos) + 1).withColumn("_frac", pos - F.floor(pos))
    else:
        wanted = (
            wanted.withColumn("_k", F.greatest(F.lit(1), F.ceil(F.round(F.col("_p") * F.col("_n"), 9))).cast("long"))
            .withColumn("_frac", F.lit(0.0))
        )
    named = rows.withColumn("_name", F.explode(F.array(*[F.lit(n) for n in names])))
    joined = _met(named, narrowed(named, wanted, by), by)
    counted = (
        joined.filter(F.col("_v") <= F.col("_hi"))
        .withColumn("_at", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(*by, "_name", "_at", "_k", "_frac", "_n")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cell = Window.partitionBy(*by, "_name").orderBy(F.col("_at").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_c").over(cell.rowsBetween(Window.unboundedPreceding, 0)))
    picked = ranked.groupBy(*by, "_name").agg(
        F.min(F.when(F.col("_at").isNotNull() & (F.col("_upto") >= F.col("_k")), F.col("_at"))).alias("_a"),
        F.min(F.when(F.col("_at").isNotNull() & (F.col("_upto") >= F.least(F.col("_k") + 1, F.col("_n"))),
                     F.col("_at"))).alias("_b"),
        F.first("_frac").alias("_frac"),
        F.first("_k").alias("_k"),
        F.coalesce(F.max(F.when(F.col("_at").isNull(), F.col("_upto"))), F.lit(0)).alias("_below"),
    )
    # the sketch's error bound keeps the rank inside the bracket; were it outside, no neighbour is passed off as it
    inside = (F.col("_below") < F.col("_k")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    result = F.when(F.col("_frac") == 0, F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")
    )
    return picked.groupBy(*by).agg(*[
        F.max(F.when(F.col("_name") == n, F.when(inside, result).otherwise(F.raise_error(F.lit("quantile rank outside its bracket"))))).alias(n)
        for n in names
    ])


def _met(rows: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their group's brackets; NULL groups meet too.

    Without groups there are as many bracket rows as wanted quantiles; with
    groups the join strategy is left to the sizes AQE measures.
    """
    return join_on(rows, brackets if by else F.broadcast(brackets), [*by, "_name"])


def narrowed(named: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brackets ``_lo, _hi`` cut down to the bins that hold ranks ``_k`` and ``_k + 1``.

    A bin's number rises with the value, so counts of whole bins locate a rank
    exactly. At most ``BINS`` counts of a bracket come together.
    """
    part = [*by, "_name"]
    width = F.col("_hi") - F.col("_lo")
    share = (F.col("_v") - F.col("_lo")) / F.when(width > 0, width)
    # a bracket of one value, or too wide for a double, stays one bin
    bin_of = F.when(F.col("_v") < F.col("_lo"), F.lit(-1)).otherwise(
        F.coalesce(F.floor(F.when(share < float("inf"), share) * F.lit(float(BINS))).cast("int"), F.lit(0)))
    carried = ("_k", "_frac", "_n", "_lo", "_hi")
    counts = (
        _met(named, wanted, by).filter(F.col("_v") <= F.col("_hi")).withColumn("_bin", bin_of)
        .groupBy(*part, "_bin", *carried).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))
    upto = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_c").over(upto))
    last = F.least(F.col("_k") + 1, F.col("_n"))
    holds = (F.col("_bin") >= 0) & (F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < last)
    cut = placed.groupBy(*part, "_k", "_frac", "_n").agg(
        F.min(F.when(holds, F.col("_least"))).alias("_least"), F.max(F.when(holds, F.col("_most"))).alias("_most"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return cut.select(*part, "_k", "_frac", "_n", F.coalesce("_least", "_lo").alias("_lo"), F.coalesce("_most", "_hi").alias("_hi"))


def score_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), scale: int = 6,
                    alias: str = "quantiles") -> DataFrame:
    """Quantiles of a [0, 1] score held at ``scale`` decimals.

    Equal scores are counted first, so each group's final state has at most
    ``10**scale + 1`` entries whatever the row count.
    """
    by = list(by)
    counts = (
        df.select(*by, F.round(F.col(value), scale).alias("_s"))
        .filter(F.col("_s").isNotNull())
        .groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c"))
    )
    return counts.groupBy(*by).agg(
        F.percentile("_s", F.array(*[F.lit(float(p)) for p in probs]), F.col("_c")).alias(alias)
    )
