"""Shingle sets of whole texts, hashed in numpy passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import words as W

_A = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as uint64.

    A-Z are lower-cased; words lie between spaces and control white space. A
    text of fewer words than the width has its whole sequence as one shingle,
    one without words has none.
    """
    for first, last, cp, offsets in W.chunks(texts):
        low = cp + ((cp >= 65) & (cp <= 90)).astype(np.uint32) * np.uint32(32)
        start, end = W.runs(~((cp == 0x20) | ((cp >= 0x09) & (cp <= 0x0D))), offsets)
        h = W.span_hash(low, start, end)
        rolled = h.copy()
        for k in range(1, width):
            rolled[: len(h) - k] = rolled[: len(h) - k] * _A + h[k:]
        rolled = W.mix(rolled)
        border = W.per_text(start, offsets)
        for i in range(last - first):
            a, b = border[i], border[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = W.mix(whole * _A + h[k:k + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    """64 bits over a whole set and its size."""
    if not len(s):
        return 0
    x = W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _A
    return int(W.mix(x).view(np.int64)[0])
