"""Column helpers shared by all operators. Missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_div(num: Column, den: Column) -> Column:
    """NULL instead of an error when the divisor is zero."""
    return num / F.when(den != 0, den)


def staged(df: DataFrame, keep: Sequence[str], cols: Mapping[str, Column]) -> DataFrame:
    """Keep columns plus computed ones, each computed exactly once per row.

    The one-element ``inline`` is a plan boundary: later filters and
    projections refer to its output instead of copying the expressions, which
    for deep parsing chains would grow exponentially.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of equal name where NULL equals NULL; the left keys are kept."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(named[f"_right_{k}"])
    return left.join(named, cond, how).drop(*(f"_right_{k}" for k in keys))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp that keeps NULL (least/greatest alone would drop it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(c.isNotNull(), out)


def nonzero_std(std: Column, mean: Column) -> Column:
    """NULL for a constant window, whose computed deviation may be tiny noise."""
    return F.when(std > F.abs(mean) * F.lit(1e-12), std)


def text_or_null(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    t = F.trim(c)
    return F.when(t != "", t)


def first_text(*cols: Column) -> Column:
    return F.coalesce(*[text_or_null(c) for c in cols])


def flag(c: Column) -> Column:
    """0/1 int flag; an unknown condition counts as 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


_DATE = r"^\d{4}-\d{2}-\d{2}$"
_ZONE = r"(Z|[+-]\d{2}(:?\d{2})?)$"
_EXTENDED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(\d{2})(\d{2}))?(Z|[+-]\d{2}:?\d{2})?$"


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; text without an offset is UTC; else NULL."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    compact = F.regexp_replace(
        F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), r"[T ](\d{2})(\d{2})(\d{2})", "T$1:$2:$3")
    # no text has two of these shapes; the usual one comes first and is matched once
    zoned = (
        F.when(text.rlike(_EXTENDED + _ZONE), dotted)
        .when(text.rlike(_EXTENDED + "$"), F.concat(dotted, F.lit("Z")))
        .when(text.rlike(_DATE), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(_COMPACT), F.when(F.length(text) == 8, F.concat(compact, F.lit("T00:00:00Z")))
              .when(compact.rlike(_ZONE) & F.contains(compact, F.lit(":")), compact).otherwise(F.concat(compact, F.lit("Z"))))
    )
    return zoned.try_cast("timestamp")


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """Text to DOUBLE; anything but a plain finite number is NULL."""
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def iso_text(ts: Column) -> Column:
    """TIMESTAMP as ISO-8601 UTC text, microseconds only when present."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(
        base,
        F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")),
        F.lit("+00:00"),
    )
