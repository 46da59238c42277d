"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words. Training weighs all
segmentations too: each word of the labelled texts spreads its count over the
pieces by their posterior under equal piece probabilities (forward-backward),
and Spark sums these expected counts over all training rows.

Defined results: a text that is NULL or has no letter is ``und`` with score 0,
as is every text when nothing could be learned; letters outside the vocabulary
cost the same in every language; a run of letters is one word at any length;
ties go to the language first in order of its name; rows without a label never
train; repeated rows count each time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W

UNKNOWN = "und"
#: Positions between two rescalings of the forward variables, which would otherwise underflow in long words.
RESCALE = 24
#: Probability of a letter that no piece holds.
FLOOR = 1e-7
#: Added to each expected count, so that no piece is impossible.
SMOOTHING = 0.5
_START = 0x2581  # the vocabulary's mark of a word's start


@dataclass(frozen=True)
class Model:
    """``prob[piece, language]``; pieces by row of the sorted vocabulary."""

    languages: tuple[str, ...]
    prob: np.ndarray


@lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, int]:
    """Hashes of the vocabulary's lower-case letter pieces in order, and the longest piece's length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    kind = W.classes()
    pieces = sorted(p for p in names if p and p == p.lower() and p != chr(_START) and all(kind[ord(c)] == W.LETTER for c in p.removeprefix(chr(_START))))
    cp = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(lens)
    return np.sort(W.span_hash(cp, end - lens, end)), int(lens.max(initial=1))


def lattice(words: list[str], hashes: np.ndarray, longest: int):
    """Words of equal length together: (row numbers, length, pieces), where
    pieces[b, l - 1] is the piece that ends at position b after l characters.

    A piece number of len(hashes) is an unknown single letter, above it none.
    """
    marked = [chr(_START) + w for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    cp = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(lens) - lens
    for n in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == n)
        own = cp[begin[rows][:, None] + np.arange(n)].reshape(-1)
        base = np.arange(len(rows)) * n
        pieces = np.full((n + 1, min(longest, n), len(rows)), len(hashes) + 1, np.int32)
        for size in range(1, pieces.shape[1] + 1):
            start = (np.arange(n - size + 1)[:, None] + base).reshape(-1)
            key = W.span_hash(own, start, start + size)
            at = np.searchsorted(hashes, key)
            at[at == len(hashes)] = 0
            pieces[size:, size - 1] = np.where(hashes[at] == key, at, len(hashes) + (size > 1)).reshape(-1, len(rows))
        yield rows, n, pieces


def word_likelihoods(words: list[str], hashes: np.ndarray, prob: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Log likelihood of each word per language, all segmentations of the whole word summed."""
    k = prob.shape[1]
    table = np.concatenate([prob, np.full((1, k), FLOOR), np.zeros((1, k))])
    out = np.zeros((len(words), k))
    for rows, n, pieces in lattice(words, hashes, longest or max(map(len, words), default=0) + 1):
        width = pieces.shape[1]
        ring = np.zeros((width, len(rows), k))  # forward variables of the last positions, nearest first
        ring[0] = 1.0
        log = np.zeros((len(rows), k))
        for b in range(1, n + 1):
            now = np.einsum("lrk,lrk->rk", ring[:min(b, width)], table[pieces[b, :b]])
            ring[1:] = ring[:-1]
            ring[0] = now
            if b % RESCALE == 0:
                ring /= now
                log += np.log(now)
        out[rows] = log + np.log(ring[0])
    return out


def word_posteriors(words: list[str], hashes: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(piece, expected count) of each word under equal piece probabilities.

    Forward variables are kept as ratios to the last position's, so that each
    position gives the posterior of the piece that ends there; the backward
    pass hands a position's share on to where its pieces begin.
    """
    v = len(hashes)
    table = np.concatenate([np.full(v, 1.0 / v), [FLOOR, 0.0]])
    row_all, piece_all, weight_all = [], [], []
    for rows, n, pieces in lattice(words, hashes, longest or max(map(len, words), default=0) + 1):
        width = pieces.shape[1]
        share = np.zeros((n + 1, width, len(rows)))  # of the pieces that end at a position
        ring = np.zeros((width, len(rows)))
        ring[0] = 1.0
        for b in range(1, n + 1):
            share[b] = ring * table[pieces[b]]
            total = share[b].sum(0)
            share[b] /= total
            ring[1:] = ring[:-1] / total
            ring[0] = 1.0
        through = np.zeros((n + 1, len(rows)))
        through[n] = 1.0
        for b in range(n, 0, -1):
            share[b] *= through[b]
            few = min(b, width)
            through[b - few:b] += share[b, :few][::-1]
        known = np.nonzero((share > 0) & (pieces < v))
        row_all.append(rows[known[2]])
        piece_all.append(pieces[known])
        weight_all.append(share[known])
    row = np.concatenate(row_all) if row_all else np.zeros(0, np.int64)
    order = np.argsort(row, kind="stable")
    flat = np.zeros(len(row), [("piece", np.int32), ("weight", np.float32)])
    if len(row):
        flat["piece"] = np.concatenate(piece_all)[order]
        flat["weight"] = np.concatenate(weight_all)[order]
    return flat, np.bincount(row, minlength=len(words))


def letter_words(texts: list[str | None]):
    """Per run of texts: (first, last, code points, offsets, starts, ends) of its lower-case words."""
    lowered = [t.lower() if t else t for t in texts]
    for first, last, cp, offsets in W.chunks(lowered):
        start, end = W.runs(W.classes()[cp] == W.LETTER, offsets)
        yield first, last, cp, offsets, start, end


_caches: dict[tuple, W.WordCache] = {}


def train(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", labelled: Column | None = None) -> Model:
    """Expected piece counts per language over all labelled rows.

    The driver gets one row per language and piece: bounded by the vocabulary
    times the number of languages, whatever the input.
    """
    rows = docs.where(F.col(lang).isNotNull() if labelled is None else F.col(lang).isNotNull() & labelled)

    def run(batches):
        hashes, longest = vocabulary(path)
        cache = _caches.setdefault(("train", path), W.WordCache(lambda w: word_posteriors(w, hashes, longest)))
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for name in set(langs):
                counts.setdefault(name, np.zeros(len(hashes)))
                part = b.filter(pa.array([x == name for x in langs]))
                for _, _, cp, _, start, end in letter_words(part.column(0).to_pylist()):
                    row, n = np.unique(cache.lookup(cp, start, end), return_counts=True)
                    flat, lens = cache.expand(row)
                    if len(flat):
                        counts[name] += np.bincount(flat["piece"], flat["weight"] * np.repeat(n, lens), len(hashes))
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.float64())], names=["lang", "piece", "n"])

    sums = rows.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "lang string, piece int, n double")
    got = sums.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    size = len(vocabulary(path)[0])
    counts = np.zeros((size, len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    counts[got.column("piece").to_numpy(), [index[x] for x in names]] = got.column("n").to_numpy()
    counts += SMOOTHING
    return Model(languages, counts / counts.sum(0))


def predict(docs: DataFrame, model: Model, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred and score (the language's posterior under equal priors)."""
    kind = docs.schema[id_col].dataType.simpleString()
    key = ("score", path, model.languages, float(model.prob[:1].sum()) if model.languages else 0.0, float(np.square(model.prob).sum()))

    def run(batches):
        hashes, longest = vocabulary(path)
        k = len(model.languages)

        def compute(words):
            return word_likelihoods(words, hashes, model.prob, longest), np.ones(len(words), np.int64)

        if key not in _caches:
            for old in [x for x in _caches if x[0] == "score"]:
                del _caches[old]
            _caches[key] = W.WordCache(compute)
        cache = _caches[key]
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for first, last, cp, offsets, start, end in letter_words(texts if k else []):
                rows = cache.lookup(cp, start, end)
                total = np.zeros((len(start) + 1, k))
                if len(rows):
                    np.cumsum(cache.flat[cache.off[rows]], axis=0, out=total[1:])
                border = W.per_text(start, offsets)
                logs = total[border[1:]] - total[border[:-1]]
                best = logs.argmax(1)
                weight = np.exp(logs - logs.max(1, keepdims=True))
                p = weight[np.arange(len(best)), best] / weight.sum(1)
                for i in np.flatnonzero(border[1:] > border[:-1]).tolist():
                    pred[first + i], score[first + i] = model.languages[best[i]], p[i]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select(id_col, F.col(text).cast("string")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
