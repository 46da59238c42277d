"""Source divergence audit: how far the sources of a language are apart in their terms.

Every (language, source) group has a smoothed share of each kept term of its
language. Two groups are compared by the summed absolute differences of their
shares, a group and its language by the terms it uses more.

The comparison is a sparse matrix product in Gustavson's row order. Kept terms
are dealt into blocks; a block holds whole terms with the counts of all their
groups, as a term-major index of each language. Each group in turn scatters its own terms
through that index into one dense accumulator with a cell for each peer, so no
pair of postings is ever a row: a block hands on one sum for each pair of
groups. A term that a group lacks still has the share of a zero count there, its
baseline z, which the sparse index does not hold. So with V terms of a language
in the block

    sum |p - q| = V |z_p - z_q|
                + sum over the one's terms of |p - z_q| - |z_p - z_q|
                + sum over the other's terms of |z_p - q| - |z_p - z_q|
                + sum over common terms of |p - q| - |p - z_q| - |z_p - q| + |z_p - z_q|,

where the last line is what is scattered and the middle ones come from sorted
shares and running sums. Everything is whole numbers in 64 bits; shares of
counts too large for that are computed in Python's integers.

Size: term counts are added up in the tasks before they are shuffled, so a
source with a third of all rows is no hot key; a block holds whole terms, at
most one posting for each group and term; the only output that grows with the
square of the groups is the asked one.

Defined results: NULL text, language and source are ''. Every row is a document,
repeated rows and rows without an id too. A language without kept terms gives
its pairs the value 0. An empty table gives no rows. Equal values are ordered by
the item's UTF-8 bytes. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .components import stored

ONE = 10**9


@dataclass(frozen=True)
class AuditConfig:
    #: Documents of a language that a kept term is in, at least.
    min_docs: int = 30
    #: Added to every count.
    smooth: int = 5
    #: Terms reported for a group.
    top: int = 50
    #: Postings to a block.
    block: int = 1 << 18
    #: Distinct (group, term) pairs that a task adds up before it hands them on.
    held: int = 400_000


class _Counts:
    """Occurrences and documents of (group, term), added up over many documents."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[int, str] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, groups: list[tuple[str, str]], texts: list[str]) -> None:
        number = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        for first, last, cp, offsets in W.chunks(texts):
            low = cp + ((cp >= 65) & (cp <= 90)).astype(np.uint32) * np.uint32(32)
            start, end = W.runs((low >= 0x80) | ((low >= 97) & (low <= 122)), offsets)
            if not len(start):
                continue
            h, at, term = np.unique(W.span_hash(low, start, end), return_index=True, return_inverse=True)
            for i in np.flatnonzero([x not in self.terms for x in h.tolist()]).tolist():
                self.terms[int(h[i])] = low[start[at[i]]:end[at[i]]].tobytes().decode("utf-32-le")
            doc = np.repeat(np.arange(last - first), np.diff(W.per_text(start, offsets)))
            # one key for each document and term, then for each group and term
            pair, n = np.unique(doc * len(h) + term, return_counts=True)
            key = number[first + pair // len(h)] * len(h) + pair % len(h)
            key, back = np.unique(key, return_inverse=True)
            self.parts.append(np.column_stack([
                key // len(h), h[key % len(h)].view(np.int64), np.bincount(back, n).astype(np.int64), np.bincount(back)]))
            self.size += len(key)

    def merge(self) -> int:
        """Adds up equal keys; how many are left."""
        if len(self.parts) > 1:
            x = np.concatenate(self.parts)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            new = np.flatnonzero(np.append(True, (np.diff(x[:, 0]) != 0) | (np.diff(x[:, 1]) != 0)))
            self.parts = [np.column_stack([x[new, 0], x[new, 1], np.add.reduceat(x[:, 2], new), np.add.reduceat(x[:, 3], new)])]
        self.size = len(self.parts[0]) if self.parts else 0
        return self.size

    def rows(self) -> pa.RecordBatch:
        self.merge()
        x = self.parts[0] if self.parts else np.zeros((0, 4), np.int64)
        names = list(self.groups)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[g][0] for g in x[:, 0].tolist()], pa.string()), pa.array([names[g][1] for g in x[:, 0].tolist()], pa.string()),
             pa.array([self.terms[h] for h in x[:, 1].view(np.uint64).tolist()], pa.string()), pa.array(x[:, 2]), pa.array(x[:, 3])],
            names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, held: int = AuditConfig.held) -> DataFrame:
    """lang, source, term, n and docs; a task hands on few rows for a group and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for b in batches:
            lang, source, text = (b.column(i).to_pylist() for i in range(3))
            counts.add(list(zip(lang, source)), text)
            if counts.size > held and counts.merge() > held // 2:
                yield counts.rows()
                counts = _Counts()
        yield counts.rows()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(docs: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """lang, source, term, n of terms in enough documents; ``lead`` marks one row of each term.

    Dealt out by (lang, term) once; a term's rows are as many as it has sources.
    """
    per = term_counts(docs, cfg.held).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = per.withColumns({"_in": F.sum("docs").over(term), "_first": F.min("source").over(term)})
    return marked.where(F.col("_in") >= cfg.min_docs).select(
        "lang", "source", "term", "n", (F.col("source") == F.col("_first")).cast("long").alias("lead"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring group: its and its language's occurrences, and the language's terms."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("lead").alias("lead"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0)
    lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("lead").alias("v"))
    return groups.join(lang, "lang").select("lang", "source", "n", "lang_n", "v")


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int, smooth: int) -> np.ndarray:
    """1 + floor(10^9 (count + smooth) / (total + smooth * terms)), elementwise."""
    if not len(counts):
        return np.zeros(0, np.int64)
    big = int(counts.max()) + smooth > 9 * 10**9
    top = (counts.astype(object) if big else counts) + smooth
    return (1 + ONE * top // (total + smooth * terms)).astype(np.int64)


def _baselines(p: np.ndarray, z: np.ndarray, own: int) -> np.ndarray:
    """For each peer, the sum over a group's terms of |p - z_peer| - |z_own - z_peer|."""
    p = np.sort(p)
    run = np.concatenate([[0], np.cumsum(p)])
    below = np.searchsorted(p, z)
    return z * below - run[below] + (run[-1] - run[below]) - z * (len(p) - below) - len(p) * np.abs(own - z)


def compare_block(term: np.ndarray, group: np.ndarray, count: np.ndarray, totals: np.ndarray, lang_total: int, terms: int,
                  smooth: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair sums over this block's terms, share above the language's of each posting).

    ``term`` numbers the block's terms and is sorted; ``group`` numbers the
    language's groups, whose occurrences are ``totals``.
    """
    size = len(totals)
    z = np.array([1 + ONE * smooth // (int(n) + smooth * terms) for n in totals], np.int64) if terms else np.zeros(size, np.int64)
    p = shares(count, totals[group], terms, smooth)
    index = np.flatnonzero(np.append(True, np.diff(term) != 0)) if len(term) else np.zeros(0, np.int64)
    index = np.append(index, len(term))
    width = np.diff(index)
    own = np.add.reduceat(count, index[:-1]) if len(term) else count
    excess = p - shares(own, lang_total, terms, smooth)[term] if len(term) else p
    by_group = np.argsort(group, kind="stable")
    rows = np.searchsorted(group[by_group], np.arange(size + 1))
    apart = np.zeros((size, size), np.int64)
    common = np.zeros((size, size), np.int64)
    for g in range(size):
        mine = by_group[rows[g]:rows[g + 1]]
        apart[g] = _baselines(p[mine], z, int(z[g]))
        # postings of the group's terms, by way of the index
        n = width[term[mine]]
        peers = np.repeat(index[term[mine]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        mp, q, h = np.repeat(p[mine], n), p[peers], group[peers]
        np.add.at(common[g], h, np.abs(mp - q) - np.abs(mp - z[h]) - np.abs(z[g] - q) + np.abs(z[g] - z[h]))
    return (len(index) - 1) * np.abs(z[:, None] - z[None, :]) + apart + apart.T + common, excess


def _compare(lang: str, peers: pa.Table, rows: pa.Table, cfg: AuditConfig) -> pa.Table:
    """Pair sums, and the best terms of each group, over one language's postings in a block."""
    names = peers.column("source").to_pylist()
    number = {s: i for i, s in enumerate(names)}
    rows = rows.sort_by("term")
    spelled = rows.column("term").to_pylist()
    term = np.cumsum([i == 0 or t != spelled[i - 1] for i, t in enumerate(spelled)], dtype=np.int64) - 1
    group = np.array([number[s] for s in rows.column("source").to_pylist()], np.int64)
    apart, excess = compare_block(term, group, rows.column("n").to_numpy(), peers.column("n").to_numpy(),
                                  peers.column("lang_n")[0].as_py(), peers.column("v")[0].as_py(), cfg.smooth)
    one, other = np.nonzero(~np.eye(len(names), dtype=bool))
    # terms are in the order of their bytes, so equal shares are too
    above = np.flatnonzero(excess > 0)
    order = above[np.lexsort((above, -excess[above], group[above]))]
    order = order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < cfg.top]
    source = [names[g] for g in np.concatenate([one, group[order]]).tolist()]
    item = [names[g] for g in other.tolist()] + [spelled[i] for i in order.tolist()]
    return pa.table(
        [pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()),
         pa.array(["pair"] * len(one) + ["term"] * len(order), pa.string()), pa.array(item, pa.string()),
         pa.array(np.concatenate([apart[one, other], excess[order]]), pa.int64())], names=["lang", "source", "part", "item", "value"])


def audit_blocks(kept: DataFrame, groups: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """lang, source, part, item, value of every block: pair sums, and the block's best terms of each group.

    Blocks mix all languages, so one that holds most of the postings is no hot
    key. The few rows of ``groups`` go to every block.
    """
    blocks = max(1, math.ceil(kept.count() / cfg.block))
    postings = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int").alias("block"), "lang", "source", "term", "n")
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(peers: pa.Table, rows: pa.Table) -> pa.Table:
        return pa.concat_tables(
            _compare(lang, peers.filter(pc.equal(peers.column("lang"), lang)), rows.filter(pc.equal(rows.column("lang"), lang)), cfg)
            for lang in pc.unique(peers.column("lang")).to_pylist())

    return every.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(
        run, "lang string, source string, part string, item string, value bigint")


def audit(docs: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of groups, and each group's terms above its language."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    docs = docs.select(*text.values())
    kept = stored(kept_terms(docs, cfg), "audit_terms")
    parts = audit_blocks(kept, group_totals(docs, kept), cfg)
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return whole.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= cfg.top))
