"""Byte-level BPE as a deterministic automaton over tokens.

Compiling starts from the automaton whose only state loops over all bytes and
adds one gadget per merge (u, v) -> w, in order of rank: the state that u enters
loses the arc v, and an arc w is added wherever u could be read, entering the
state that v entered. Tokens share a state until a gadget tells them apart, and
share a kind (the states at which they may be read) until one takes an arc of
only one of them; so some thousands of states and kinds and one bit for each
pair of them hold all arcs (some 14 600 and 10 600 for a vocabulary of 50 000). The
accepted token strings are exactly BPE's outputs, and every byte string has
one. Byte transitions over the tokens' strings say which tokens end at a
position; a word is encoded by one pass over its bytes that keeps, for each end
position, the one token that an accepted path ends with. Decoding emits the
arcs' byte labels.

Defined results: NULL and empty texts have no tokens and decode to the empty
text; the strings of special tokens in a text become those tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

#: Contractions that the pre-splitter cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_chars() -> dict[str, int]:
    """The vocabulary file's printable stand-in of every byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled automaton: states, arcs between them, byte transitions."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = special or {}
        self.label = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self._gadgets(vocab, [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges])
        self._transitions({b: i for b, i in vocab.items() if self.state[i] >= 0})

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """From a tokenizer file in JSON with a byte-level BPE model."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_chars()
        raw = lambda s: bytes(of[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(vocab, [(raw(a), raw(b)) for a, b in pairs], special)

    def _gadgets(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]) -> None:
        """``state`` and ``kind`` of every token and the bit table of arcs.

        ``state[t]`` is entered by reading t; tokens of one kind have arcs at the
        same states. A gadget gives the left part a state, and the right part a
        kind, of their own where others share them, and takes their arc away;
        the merged token enters the state that the right part entered before,
        and is of the kind that the left part is of now.
        """
        size = max(self.label) + 1
        state, kind = [-1] * size, [-1] * size
        for b, i in vocab.items():
            if len(b) == 1:
                state[i] = kind[i] = 0
        singles = sum(len(b) == 1 for b in vocab)
        in_state, of_kind = [singles], [singles]
        gone = np.zeros((256, 256), np.uint8)  # bit k & 7 of [state, k >> 3]: the arc was taken away
        for u, v, w in merges:
            # no arc to replace, no gadget: the token can never be read
            if state[u] < 0 or state[v] < 0 or state[w] >= 0 or gone[state[u], kind[v] >> 3] >> (kind[v] & 7) & 1:
                continue
            entered = state[v]
            if in_state[state[u]] > 1 or u == v:  # what (u, u) merges to enters the state as it was
                new = len(in_state)
                if new == len(gone):
                    gone = np.concatenate([gone, np.zeros_like(gone)])
                gone[new] = gone[state[u]]
                in_state[state[u]] -= 1
                in_state.append(1)
                state[u] = new
            if of_kind[kind[v]] > 1:
                old, new, n = kind[v], len(of_kind), len(in_state)
                if new >> 3 == gone.shape[1]:
                    gone = np.concatenate([gone, np.zeros_like(gone)], axis=1)
                gone[:n, new >> 3] |= (gone[:n, old >> 3] >> (old & 7) & 1) << (new & 7)
                of_kind[old] -= 1
                of_kind.append(1)
                kind[v] = new
            gone[state[u], kind[v] >> 3] |= 1 << (kind[v] & 7)
            state[w], kind[w] = entered, kind[u]
            in_state[entered] += 1
            of_kind[kind[u]] += 1
        self.state, self.kind = state, kind
        self.states, self.kinds = len(in_state), len(of_kind)
        self.width = (self.kinds + 7) >> 3
        self.gone = gone[:self.states, :self.width].tobytes()

    def _transitions(self, tokens: dict[bytes, int]) -> None:
        """Byte transitions: a node is the longest string read last that begins a
        token. ``longest[node]`` is the longest token that ends there, and
        ``shorter[token]`` the next shorter one that ends with it."""
        self.goto: dict[int, int] = {}
        own, parents = [-1], [(0, 0)]
        for b, i in tokens.items():
            node = 0
            for c in b:
                key = node << 8 | c
                after = self.goto.get(key)
                if after is None:
                    after = self.goto[key] = len(own)
                    own.append(-1)
                    parents.append((node, c))
                node = after
            own[node] = i
        depth = [0] * len(own)
        for node in range(1, len(own)):  # a parent's number is smaller
            depth[node] = depth[parents[node][0]] + 1
        self.back, self.longest = [0] * len(own), own[:]
        self.shorter, self.size = [-1] * len(self.state), [0] * len(self.state)
        for node in sorted(range(1, len(own)), key=depth.__getitem__):
            parent, c = parents[node]
            if parent:
                self.back[node] = self._next(self.back[parent], c)
            below = self.longest[self.back[node]]
            if own[node] >= 0:
                self.shorter[own[node]], self.size[own[node]] = below, depth[node]
            else:
                self.longest[node] = below

    def _next(self, node: int, c: int) -> int:
        """The node after reading a byte."""
        after = self.goto.get(node << 8 | c)
        while after is None and node:
            node = self.back[node]
            after = self.goto.get(node << 8 | c)
        return after or 0

    def arc(self, a: int, b: int) -> bool:
        """Whether token b may be read after token a."""
        k = self.kind[b]
        return not self.gone[self.state[a] * self.width + (k >> 3)] >> (k & 7) & 1

    def read(self, word: bytes) -> list[int]:
        """For each byte the token that an accepted path ends with after it.

        There is one path at most to a position, so of the tokens that end at it
        one has an arc from the state at its own beginning. No position is
        visited again.
        """
        last, node = [-1], 0
        size, shorter, longest, kind, state, gone, width = self.size, self.shorter, self.longest, self.kind, self.state, self.gone, self.width
        for i, c in enumerate(word, 1):
            node = self._next(node, c)
            t = longest[node]
            while t >= 0:
                begin = last[i - size[t]] if size[t] < i else -1
                k = kind[t]
                if begin < 0 or not gone[state[begin] * width + (k >> 3)] >> (k & 7) & 1:
                    break
                t = shorter[t]
            if t < 0:
                raise ValueError(f"byte {c} is no token of the vocabulary")
            last.append(t)
        return last[1:]

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: the path that reads it, from its end."""
        last, at, out = self.read(word), len(word), []
        while at:
            out.append(last[at - 1])
            at -= self.size[out[-1]]
        return out[::-1]

    def decode(self, ids) -> bytes:
        """The arcs' byte labels."""
        return b"".join(map(self.label.__getitem__, ids))


def split(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-split words: a run of letters, of numbers or of
    other signs with one space before it, or white space. Of white space before
    a word the last character stands apart. Offsets are borders of texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = W.classes()[cp]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == W.SPACE
    # last white character before a word of the same text
    tail = np.flatnonzero(white[:-1] & ~white[1:] & ~border[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[tail] = True
    joined = tail[cp[tail] == 0x20] + 1
    start[joined] = False
    contractions(cp, kind, start, border)
    at = np.flatnonzero(start)
    return at, np.append(at[1:], n)


def contractions(cp: np.ndarray, kind: np.ndarray, start: np.ndarray, border: np.ndarray) -> None:
    """An apostrophe that begins a word takes the letters of a contraction."""
    n = len(cp)
    quote = np.flatnonzero((cp == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == W.LETTER) & ~border[quote + 1]]
    for c in CONTRACTIONS:
        q = quote[quote + len(c) < n]
        for i, ch in enumerate(c):
            q = q[(cp[q + 1 + i] == ord(ch)) & ~border[q + 1 + i]]
        start[q + 1] = False
        after = q + 1 + len(c)
        start[after[after < n]] = True


class Encoder:
    """Whole texts to token ids by an automaton, with distinct words cached."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.cache = W.WordCache(self._words)
        names = sorted(automaton.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, names))) if names else None

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.automaton.encode(w.encode()) for w in words]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((t for x in ids for t in x), np.uint32, int(lens.sum())), lens

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for first, last, cp, offsets in W.chunks(texts):
            marks = []
            if self.marks:
                for i, t in enumerate(texts[first:last]):
                    if t and "<" in t:
                        marks += [(int(offsets[i]) + m.start(), int(offsets[i]) + m.end(), self.automaton.special[m[0]]) for m in self.marks.finditer(t)]
            cuts = np.unique(np.concatenate([offsets, [x for m in marks for x in m[:2]]]).astype(np.int64)) if marks else offsets
            start, end = split(cp, np.unique(cuts))
            taken = np.zeros(len(start), bool)
            for a, b, _ in marks:  # one word or more stand where the mark does
                taken[np.searchsorted(start, a):np.searchsorted(start, b)] = True
            rows = np.empty(len(start), np.int64)
            rows[~taken] = self.cache.lookup(cp, start[~taken], end[~taken])
            keep = np.flatnonzero(~taken)
            flat, lens = self.cache.expand(rows[keep])
            total = np.zeros(len(start) + 1, np.int64)
            total[keep + 1] = lens
            bounds = np.cumsum(total)[W.per_text(start, offsets)]
            if not marks:
                for i in range(last - first):
                    yield flat[bounds[i]:bounds[i + 1]]
                continue
            places = np.cumsum(total)[W.per_text(start, np.array([m[0] for m in marks]))]
            for i in range(last - first):
                own = [k for k, m in enumerate(marks) if offsets[i] <= m[0] < offsets[i + 1]]
                yield np.insert(flat[bounds[i]:bounds[i + 1]], places[own] - bounds[i], [marks[k][2] for k in own]) if own else flat[bounds[i]:bounds[i + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Automaton.from_file(path))
    return _encoders[path]


class Labels:
    """Byte labels of all arcs in one buffer, for emitting many at once."""

    def __init__(self, automaton: Automaton):
        size = max(automaton.label) + 1
        parts = [automaton.label.get(i, b"") for i in range(size)]
        self.lens = np.fromiter(map(len, parts), np.int64, size)
        self.off = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def emit(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lens = self.lens[ids]
        shift = np.concatenate([[0], np.cumsum(lens)[:-1]])
        return self.data[np.repeat(self.off[ids] - shift, lens) + np.arange(int(lens.sum()))].tobytes()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, token ids (array of int) and the text decoded from them."""

    def run(batches):
        e = encoder(path)
        labels = Labels(e.automaton)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = list(e.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    pa.array([labels.emit(x).decode("utf-8", "replace") for x in ids], pa.string())], names=[id_col, "token_ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests made where the ids are, so that ids leave no worker."""

    def run(batches):
        e = encoder(path)
        labels = Labels(e.automaton)
        for b in batches:
            n, a, d = [], [], []
            for x in e.encode(b.column(1).to_pylist()):
                n.append(len(x))
                a.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(labels.emit(x).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                             names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
