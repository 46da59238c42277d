"""Secret scans: patterns, and two character Markov models compared.

One model is trained on random strings, the values that the patterns find, the
other on the ordinary words and identifiers of the same texts; both are counts
of character pairs over all documents, summed by Spark into two small tables.
A further string is a secret when it is likelier under the first model by a
log-likelihood ratio, in sum and per character.

Defined results: NULL and empty texts have no spans; repeated rows are scanned
one by one; without any labelled string of a class its model is uniform, so an
empty table trains to a model that adds nothing; other columns are kept as they
are. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

#: The three patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
VALUE_CHARS, ACCESS_CHARS = 6, 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Random by nature and no secret.
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SIZE = len(ALPHABET) + 1  # 0: outside the alphabet, and a word's border
ORDINARY_CHARS = 8
CANDIDATE_CHARS = 20
#: Uniform share of the ordinary model: with it a pair's ratio has the same bound on a table of any size.
UNIFORM = 0.02

Span = tuple[str, int, int, int, float]  # kind, start, end, start of the value, score


@dataclass(frozen=True)
class Thresholds:
    """Log-likelihood ratio that a candidate needs in all and per character."""

    total: float = 20.0
    per_char: float = 1.2
    distinct: int = 8


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("assign", m.start(), m.end(), m.start(2), 0.0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= VALUE_CHARS]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [("hex", m.start(), m.end(), m.start(), 0.0) for m in HEX.finditer(text)]
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_symbols = np.zeros(0x110000, np.uint8)
_symbols[[ord(c) for c in ALPHABET]] = np.arange(1, SIZE)


def pair_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of character pairs: [0] in values of secrets, [1] in ordinary words.

    A word with a digit trains the ordinary model up to the length from which it
    may itself be a secret that no pattern finds.
    """
    out = np.zeros((2, SIZE * SIZE), np.int64)
    for first, last, cp, offsets in W.chunks(texts):
        sym = _symbols[cp]
        secret = np.zeros(len(cp), bool)
        for i in range(first, last):
            if t := texts[i]:
                for _, _, end, value, _ in base_spans(t):
                    a = int(offsets[i - first])
                    secret[a + value:a + end] = True
        start, end = W.runs(sym > 0, offsets)
        inside = np.zeros(len(cp) + 1, np.int8)
        digits = np.concatenate([[0], np.cumsum((cp >= 48) & (cp <= 57))])
        long = (end - start >= ORDINARY_CHARS) & ((digits[end] == digits[start]) | (end - start < CANDIDATE_CHARS))
        np.add.at(inside, start[long], 1)
        np.add.at(inside, end[long], -1)
        word = np.cumsum(inside[:-1]).astype(bool)
        # a pair belongs to the class of both its characters
        both = word[1:] & word[:-1] & (sym[1:] > 0) & (sym[:-1] > 0)
        pair = sym[:-1].astype(np.int64) * SIZE + sym[1:]
        for k, label in enumerate((secret[1:] & secret[:-1], ~secret[1:] & ~secret[:-1])):
            pick = label if k == 0 else label & both
            out[k] += np.bincount(pair[pick], minlength=SIZE * SIZE)
    return out


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of every character pair, from all documents.

    The driver gets at most 2 x 69 x 69 summed counts, whatever the input.
    """

    def run(batches):
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for b in batches:
            total += pair_counts(b.column(0).to_pylist())
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(total[label, pair], pa.int64())], names=["label", "pair", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "label int, pair int, n bigint").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE, SIZE))
    for r in rows:
        counts[r["label"], r["pair"] // SIZE, r["pair"] % SIZE] = r["n"]
    return ratio(counts)


def ratio(counts: np.ndarray) -> np.ndarray:
    """Rows of few pairs fall back to uniform for random strings, to the single
    characters' shares for ordinary words. Half of the random model's mass is
    uniform, so that a few labelled formats do not rule others out, and a fixed
    share of the ordinary one's, so that unseen pairs do not count the more the
    larger the table is."""
    n = SIZE - 1
    random, ordinary = counts[0][1:, 1:], counts[1][1:, 1:]
    single = (ordinary.sum(0) + 0.5) / (ordinary.sum() + 0.5 * n)
    p = 0.5 * (random + 5.0 / n) / (random.sum(1, keepdims=True) + 5.0) + 0.5 / n
    q = (1 - UNIFORM) * (ordinary + 5.0 * single) / (ordinary.sum(1, keepdims=True) + 5.0) + UNIFORM / n
    out = np.zeros((SIZE, SIZE))
    if ordinary.any():
        out[1:, 1:] = np.log(p) - np.log(q)
    return out


def scan(text: str | None, model: np.ndarray | None = None, limits: Thresholds = Thresholds()) -> list[Span]:
    """All spans of a text in order."""
    if not text:
        return []
    spans = base_spans(text)
    if model is None:
        return in_order(spans)
    covered = [(s[3], s[2]) for s in spans]
    for m in CANDIDATE.finditer(text):
        word = m[0].strip("=-_/+")
        kinds = (any(c.islower() for c in word)) + (any(c.isupper() for c in word)) + (any(c.isdigit() for c in word))
        if len(word) < CANDIDATE_CHARS or kinds < 2 or len(set(word)) < limits.distinct or UUID.fullmatch(word):
            continue
        if any(a < m.end() and m.start() < b for a, b in covered):
            continue
        sym = _symbols[np.frombuffer(word.encode("utf-32-le"), np.uint32)].astype(np.int64)
        score = float(model[sym[:-1], sym[1:]].sum())
        if score >= limits.total and score >= limits.per_char * (len(word) - 1):
            spans.append(("markov", m.start(), m.end(), m.start(), score))
    return in_order(spans)


SPANS = "array<struct<kind:string,start:int,stop:int,value_start:int,score:double>>"


def find(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """Per row the id and its spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value_start", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            rows = [[dict(zip(("kind", "start", "stop", "value_start", "score"), (s[0], s[1], s[2], s[3], s[4]))) for s in scan(t, model, limits)]
                    for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["id", "spans"])

    return docs.select(id_col, F.col(text).cast("string")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def masked(text: str | None, spans: list[Span], mask: str) -> str | None:
    """The text with every secret value replaced; overlapping values become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((s[3], s[2]) for s in spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: np.ndarray, text: str = "text", mask: str = "[REDACTED]", limits: Thresholds = Thresholds()) -> DataFrame:
    """The same rows and columns with secret values replaced in the text."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            texts = [masked(t, scan(t, model, limits), mask) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
