"""Vectorised splitting and hashing of whole texts inside Arrow batches.

Texts of a batch are laid end to end as code points. A word is a (start, end)
pair, its identity a 64-bit polynomial hash, so splitting, hashing and
per-document sums are numpy passes and no Python loop touches a word.
``WordCache`` maps words to rows computed once per distinct word; it is bounded
and starts again when full, so memory does not grow with the input.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Code points per pass; a longer text is a pass of its own.
CHUNK = 1 << 19
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The Unicode White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_P = 0x9E3779B97F4A7C55 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


@lru_cache(1)
def classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n at least."""
    if "n" not in _powers or len(_powers["n"]) < n:
        size = max(n, CHUNK * 2)
        for key, base in (("n", _P), ("inv", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["n"], _powers["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def span_hash(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the code points of each span, the same wherever the span stands."""
    p, inv = powers(len(cp) + 1)
    x = (cp.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(32)
    x *= p[: len(cp)]
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, code points, offsets) of runs of whole texts; NULL is empty."""
    lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + lens[last] <= size):
            total += lens[last]
            last += 1
        cp = np.frombuffer("".join(t for t in texts[first:last] if t).encode("utf-32-le"), np.uint32)
        yield first, last, cp, np.concatenate([[0], np.cumsum(lens[first:last])])
        first = last


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of consecutive true positions that do not cross a text's border."""
    padded = np.zeros(len(flag) + 2, np.int8)
    padded[1:-1] = flag
    edge = np.diff(padded)
    start = edge == 1
    end = edge == -1
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flag))]
    both = inner[flag[inner] & flag[inner - 1]]
    start[both] = True
    end[both] = True
    return np.flatnonzero(start), np.flatnonzero(end)


class WordCache:
    """Rows of values per distinct word, found by hash."""

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.flat: np.ndarray | None = None
        self.used = 0
        self.off = np.zeros(1, np.int64)

    def _add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        need = self.used + len(flat)
        if self.flat is None or need > len(self.flat):
            grown = np.zeros((max(need * 2, 1 << 16), *flat.shape[1:]), flat.dtype)
            if self.flat is not None:
                grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used:need] = flat
        self.off = np.concatenate([self.off, self.used + np.cumsum(lens)])
        self.used = need

    def lookup(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row number of each span."""
        keys, first, where = np.unique(span_hash(cp, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit and len(self.keys):
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            s, e = start[first[new]], end[first[new]]
            text = cp.tobytes().decode("utf-32-le")
            words = [text[a:b] for a, b in zip(s.tolist(), e.tolist())]
            flat, lens = self.compute(words)
            row = len(self.off) - 1 + np.arange(len(new))
            self._add(flat, lens)
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.rows = np.insert(self.rows, at[new], row)
            at = np.searchsorted(self.keys, keys)
        return self.rows[at][where]

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all rows end to end, and how many each has."""
        lens = self.off[rows + 1] - self.off[rows]
        if not len(rows):
            return np.zeros(0, np.int64 if self.flat is None else self.flat.dtype), lens
        shift = np.concatenate([[0], np.cumsum(lens)[:-1]])
        return self.flat[np.repeat(self.off[rows] - shift, lens) + np.arange(int(lens.sum()))], lens


def per_text(start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Borders in a sorted list of span starts: texts i has [b[i], b[i+1])."""
    return np.searchsorted(start, offsets)
