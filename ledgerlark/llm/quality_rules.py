"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps the
measurements and one BIGINT whose bit r is set when rule r failed. A policy is
a versioned mask over those bits, so another policy, or the effect of leaving
one rule out, is answered from the ledger by bitwise aggregation and never
reads a text again. Only DataFrame functions are used.

Defined results: a NULL or empty text has zero words and fails ``few_words``;
repeated rows are judged one by one; an empty table gives an empty ledger;
columns of the input whose names clash with the ledger's are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is a Spark SQL condition over the measurements."""

    name: str
    fails: str


#: Bit r of ``fail_bits`` belongs to the r-th rule; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("doubled_words", "100 * n_doubled_words > 20 * n_words"),
    Rule("short_words", "2 * n_words > word_chars"),
    Rule("long_words", "word_chars > 25 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject a document.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbols", "duplicate_lines"),
    "v2": tuple(r.name for r in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_doubled_words", "n_repeat_words")


def mask_of(names, rules=RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in set(names))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each whole text.

    ``n_repeat_words`` counts the words inside a five-word window that the text
    holds at least twice. Windows are compared by 64-bit hash; only a text with
    an equal pair sorts its (hash, position) list to find what is covered.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = body
    for s in SYMBOLS:
        plain = F.replace(plain, F.lit(s), F.lit(""))
    # the given columns travel in one struct, so that no name of theirs meets one of these
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]).alias("_given")
    out = docs.select(
        given,
        F.array_remove(F.split(body, WORD_GAP), "").alias("_words"),
        (F.octet_length(body) - F.octet_length(plain)).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    w, n = F.col("_words"), F.size("_words")
    # get() and not element_at: one past the end is NULL, positions count from 0
    window = F.transform(
        F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    out = out.select(
        *(c for c in out.columns if c not in ("_words", "_lines")),
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long").alias("n_doubled_words"),
        window.alias("_hash"))
    h = F.col("_hash")
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.withColumn("_placed", placed).drop("_hash")
    p = F.col("_placed")
    twice = F.transform(p, lambda x, i: F.when((x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]), x["i"]))
    out = out.withColumn("_twice", F.sort_array(F.array_compact(twice))).drop("_placed")
    t = F.col("_twice")
    covered = F.aggregate(
        F.transform(t, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(t, i + 1) - x, F.lit(WINDOW))).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x)
    measured = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_twice")
    return measured.select("_given.*", *[c for c in measured.columns if c != "_given"])


def ledger(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Measurements and ``fail_bits`` of every document, other columns kept."""
    out = measure(docs.drop("fail_bits"), text)
    bits: Column = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def passes(policy: str = "v2") -> Column:
    """Whether a ledger row is kept under a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """Per policy and rule: failures, and documents that only this rule rejects.

    The ledger is first counted by its bits (at most 2^rules rows, whatever the
    input), so policies and rules multiply only that histogram.
    """
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = [(v, mask_of(names), r.name, 1 << i) for v, names in POLICIES.items() for i, r in enumerate(RULES) if r.name in names]
    plan = F.explode(F.array(*(F.struct(
        F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, r, b in grid)))
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return counts.select("fail_bits", "n", plan.alias("p")).select("fail_bits", "n", "p.*").groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_by_this_rule"))
