"""Substring dedup by difference-cover anchors.

A window of ``window`` words of a document goes if the same words also start in
a document with a smaller id. Not every window is hashed and shuffled: anchors
are. An anchor is ``window - period + 1`` words that start at a position whose
remainder by ``period`` is in a difference cover, i.e. a set in which every
difference of two remainders occurs. Wherever two equal windows start, some
common shift below the period brings both to cover positions, so they share an
anchor there. An anchor that nothing else has therefore rules out every window
it would have to be shared by; the windows that hold a shared anchor are
extended to their full length, hashed in 64 bits and compared.

How it runs: documents are dealt into groups of texts. A group sends, for each
bucket of hash values, one row with the sorted distinct values packed; a bucket
sees all groups and answers each row with one bit for each value. This is done
twice: anchors ask "does another group hold this?" (32 bits of a value are sent,
since a chance agreement only lets a window through to the exact comparison),
then extended windows ask "does a smaller id hold this?" and send their least id
along. Within a group the same questions are answered in place. The texts are
shuffled once and read three times.

Size: a value is sent once for each group, however often it is repeated there,
so a passage that a third of all documents share is one entry for each group. The
numbers of groups and buckets grow with the text, first as its square root (so
that a packed row stays worth its overhead), from some size on in proportion (so
that a group and a bucket stay small). Groups are drawn at random when the texts
are written, so no id, source or copy gathers in one.

Defined results: NULL text has no words. A document without an id has no place
in the order: nothing in it is removed, and it removes nothing. Rows that share
an id do not remove each other's words. Every row gives a row, repeated ones too;
an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import stored

_A = np.uint64(0xD6E8FEB86659FD93)
CELLS = "grp int, bucket int, n int, keys binary, ids binary"
BITS = "grp int, step int, bucket int, n int, bits binary"
ANCHORS, WINDOWS = 1, 2


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 13
    period: int = 7
    #: Remainders by the period that hold every difference.
    cover: tuple[int, ...] = (0, 1, 3)
    #: Code points to a group, squared, at small sizes; and at most.
    balance: int = 1 << 14
    group_chars: int = 1 << 26

    def __post_init__(self):
        if {(a - b) % self.period for a in self.cover for b in self.cover} != set(range(self.period)):
            raise ValueError(f"{self.cover} is no difference cover of {self.period}")
        if self.period > self.window:
            raise ValueError("the period must not exceed the window")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    def parts(self, chars: int) -> int:
        """Groups, and buckets, for so much text."""
        return max(1, math.ceil(math.sqrt(chars / self.balance)), math.ceil(chars / self.group_chars))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes from each position that has them."""
    n = max(len(h) - width + 1, 0)
    out = h[:n].copy()
    for k in range(1, width):
        out = out * _A + h[k:k + n]
    return W.mix(out)


class Group:
    """The texts of one group as word spans, and the sorted values it asks about."""

    def __init__(self, ids: list[int | None], texts: list[str | None], cfg: SubstringConfig):
        self.cfg = cfg
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.known = np.array([i is not None for i in ids], bool)
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []
        hashes = [np.zeros(0, np.uint64)]
        counts = [np.zeros(0, np.int64)]
        for first, last, cp, offsets in W.chunks(texts):
            start, end = W.runs(~((cp == 0x20) | ((cp >= 0x09) & (cp <= 0x0D))), offsets)
            hashes.append(W.span_hash(cp, start, end))
            border = W.per_text(start, offsets)
            counts.append(np.diff(border))
            self.spans += [(start[a:b] - o, end[a:b] - o) for a, b, o in zip(border[:-1], border[1:], offsets[:-1])]
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        #: Each word's place in its document, and how many words follow it there, itself included.
        self.place = np.arange(len(self.doc)) - self.first[self.doc]
        self.left = self.counts[self.doc] - self.place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(word positions, values) at cover positions of documents with an id."""
        cfg = self.cfg
        at = np.flatnonzero(np.isin(self.place % cfg.period, cfg.cover) & (self.left >= cfg.anchor) & self.known[self.doc])
        return at, _rolled(self.hashes, cfg.anchor)[at]

    def extended(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word positions, values) of the full windows that hold an anchor at a position in ``shared``."""
        cfg = self.cfg
        flag = np.zeros(len(self.doc) + cfg.period + 1, np.int64)
        flag[shared + 1] = 1
        run = np.cumsum(flag)
        n = len(self.doc)
        held = run[cfg.period:cfg.period + n] - run[:n] > 0
        at = np.flatnonzero(held & (self.left >= cfg.window))
        return at, _rolled(self.hashes, cfg.window)[at]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the value; all buckets take equal ranges of values."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _short(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the value's low 32 bits, as one ascending key."""
    return (_bucket(values, buckets).astype(np.uint64) << np.uint64(32)) | (values & np.uint64(0xFFFFFFFF))


def _pack_ids(ids: np.ndarray) -> bytes:
    """Least id, then distances from it in as few bytes as the largest needs."""
    least = ids.min()
    far = (ids - least).view(np.uint64)  # exact even where the difference wraps
    kind = "<u2" if far.max() < 1 << 16 else "<u4" if far.max() < 1 << 32 else "<u8"
    return np.array([least, int(kind[2])], "<i8").tobytes() + far.astype(kind).tobytes()


def _unpack_ids(cell: bytes) -> np.ndarray:
    least, width = np.frombuffer(cell, "<i8", 2)
    return np.frombuffer(cell, f"<u{width}", offset=16).astype(np.uint64).view(np.int64) + least


def _cells(grp: int, bucket: np.ndarray, keys: np.ndarray, ids: np.ndarray | None) -> pa.Table:
    """One row for each bucket that the ascending keys reach."""
    which, first = np.unique(bucket, return_index=True)
    last = np.append(first[1:], len(bucket))
    return pa.table(
        [pa.array([grp] * len(which), pa.int32()), pa.array(which, pa.int32()), pa.array(last - first, pa.int32()),
         pa.array([keys[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
         pa.array([None if ids is None else _pack_ids(ids[a:b]) for a, b in zip(first, last)], pa.binary())],
        names=["grp", "bucket", "n", "keys", "ids"])


def _answer(table: pa.Table, step: int) -> pa.Table:
    """One bit for each value of each row: held by another row, or by one with a smaller id."""
    sizes = table.column("n").to_numpy()
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u4" if step == ANCHORS else "<u8")
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[:len(ranked)]
    run = np.cumsum(new) - 1
    if step == ANCHORS:
        held = np.bincount(run)[run] > 1
    else:
        ids = np.concatenate([_unpack_ids(x) for x in table.column("ids").to_pylist()])[order]
        held = np.minimum.reduceat(ids, np.flatnonzero(new))[run] < ids
    bits = np.zeros(len(keys), bool)
    bits[order] = held
    end = np.cumsum(sizes)
    return pa.table(
        [table.column("grp"), pa.array([step] * len(sizes), pa.int32()), table.column("bucket"), table.column("n"),
         pa.array([np.packbits(bits[b - n:b]).tobytes() for b, n in zip(end, sizes)], pa.binary())],
        names=["grp", "step", "bucket", "n", "bits"])


def _bits(answers: pa.Table, step: int) -> np.ndarray:
    """The answers to a group's sorted distinct values, end to end."""
    rows = sorted((b, n, x) for s, b, n, x in zip(*(answers.column(c).to_pylist() for c in ("step", "bucket", "n", "bits"))) if s == step)
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for _, n, x in rows)])


def _group(texts: pa.Table, cfg: SubstringConfig) -> Group:
    return Group(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), cfg)


def _ask_anchors(texts: pa.Table, cfg: SubstringConfig, buckets: int) -> pa.Table:
    _, values = _group(texts, cfg).anchors()
    keys = np.unique(_short(values, buckets))
    return _cells(texts.column("grp")[0].as_py(), (keys >> np.uint64(32)).astype(np.int64), keys.astype("<u4"), None)


def _candidates(g: Group, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window positions, number of each one's value, sorted distinct values, their least ids here)."""
    at, values = g.anchors()
    _, where, times = np.unique(_short(values, buckets), return_inverse=True, return_counts=True)
    shared = at[(_bits(answers, ANCHORS) | (times > 1))[where]]
    at, values = g.extended(shared)
    distinct, where = np.unique(values, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, where, g.ids[g.doc[at]])
    return at, where, distinct, least


def _ask_windows(texts: pa.Table, answers: pa.Table, cfg: SubstringConfig, buckets: int) -> pa.Table:
    _, _, distinct, least = _candidates(_group(texts, cfg), answers, buckets)
    return _cells(texts.column("grp")[0].as_py(), _bucket(distinct, buckets), distinct.astype("<u8"), least)


def _removed(g: Group, answers: pa.Table, buckets: int) -> np.ndarray:
    """Whether each word is covered by a window that a smaller id holds."""
    at, where, _, least = _candidates(g, answers, buckets)
    gone = at[_bits(answers, WINDOWS)[where] | (g.ids[g.doc[at]] > least[where])]
    cover = np.zeros(len(g.doc) + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + g.cfg.window, -1)
    return np.cumsum(cover)[:-1] > 0


def dedup_substrings(docs: DataFrame, cfg: SubstringConfig = SubstringConfig(), id_col: str = "doc_id", text: str = "text",
                     digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space), or its SHA-256.

    The texts are written once below the shared folder with the group each is in.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = cfg.parts(chars)
    grouped = stored(rows.select("doc_id", "text", F.floor(F.rand() * n).cast("int").alias("grp")), "substring_texts")
    by_group = grouped.groupBy("grp")

    def first(t: pa.Table) -> pa.Table:
        return _ask_anchors(t, cfg, n)

    def second(t: pa.Table, answers: pa.Table) -> pa.Table:
        return _ask_windows(t, answers, cfg, n)

    def last(t: pa.Table, answers: pa.Table) -> pa.Table:
        g = _group(t, cfg)
        gone = _removed(g, answers, n)
        kept = []
        for (start, end), a, b, body in zip(g.spans, g.first[:-1], g.first[1:], t.column("text").to_pylist()):
            stay = np.flatnonzero(~gone[a:b])
            kept.append(" ".join([body[i:j] for i, j in zip(start[stay].tolist(), end[stay].tolist())]))
        removed = np.bincount(g.doc[gone], minlength=len(g.ids))
        return pa.table(
            [t.column("doc_id"), pa.array(g.counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept] if digest else kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", out])

    def answered(cells: DataFrame, step: int) -> DataFrame:
        return cells.groupBy("bucket").applyInArrow(lambda t: _answer(t, step), BITS)

    out = "kept_sha256" if digest else "kept_text"
    anchors = answered(by_group.applyInArrow(first, CELLS), ANCHORS)
    windows = answered(by_group.cogroup(anchors.groupBy("grp")).applyInArrow(second, CELLS), WINDOWS)
    both = anchors.unionAll(windows).groupBy("grp")
    return by_group.cogroup(both).applyInArrow(last, f"doc_id bigint, n_words bigint, n_removed bigint, {out} string")
