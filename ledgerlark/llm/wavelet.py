"""Token ids in wavelet-matrix shards.

A shard is one self-contained compressed file image: documents in id order,
their ids end to end as a wavelet matrix. Each bit-plane holds one bit of every
id, ordered by the higher bits; ones counted before every 512th position are in
the file, and planes are compressed in blocks of their own. So a token is read, a
symbol counted in a range or its k-th occurrence found in one step per plane,
and only the blocks that these steps touch are decompressed.

Shards are rows of a Parquet table (one binary cell each), since only Spark's
writers reach every store; a cell written to a file of its own is read by
``WaveletMatrix.from_bytes`` just the same.

Defined results: NULL and empty texts hold the end id alone; rows with equal
ids follow each other, ordered by text; rows without an id come first; an empty
table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from . import words as W
from .bpe_automaton import contractions

MAGIC = b"WMX2"
#: Positions between two counts of ones, and bytes of a plane compressed together.
BLOCK = 512
PLANE_BYTES = 1 << 15
SHARD_TOKENS = 1 << 21
#: Words of letters that go to the library as one text.
JOINED = 64
#: Fixed value: the pre-splitting pattern for which distinct words may be encoded apart.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class StoredPlane:
    """A bit-plane in compressed blocks, each decompressed when first read."""

    def __init__(self, blob: bytes, borders: list[int], size: int):
        self.blob, self.borders, self.size = blob, borders, size
        self.decoded: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> np.ndarray:
        if k not in self.decoded:
            raw = zstandard.ZstdDecompressor().decompress(self.blob[self.borders[k]:self.borders[k + 1]])
            self.decoded[k] = np.frombuffer(raw, np.uint8)
        return self.decoded[k]

    def __getitem__(self, key):
        """A byte, or a slice that lies within one block."""
        if not isinstance(key, slice):
            return self._block(key // PLANE_BYTES)[key % PLANE_BYTES]
        k = key.start // PLANE_BYTES
        if key.start >= min(key.stop, self.size):
            return np.zeros(0, np.uint8)
        return self._block(k)[key.start - k * PLANE_BYTES:key.stop - k * PLANE_BYTES]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.concatenate([self._block(k) for k in range(len(self.borders) - 1)] or [np.zeros(0, np.uint8)])


class WaveletMatrix:
    """Succinct sequence with access, rank, count and select."""

    def __init__(self, n: int, planes: list[np.ndarray | StoredPlane], zeros: list[int], ranks: np.ndarray | None = None):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits):
            b = ((x >> x.dtype.type(bits - 1 - level)) & x.dtype.type(1)).view(np.uint16 if bits <= 16 else np.uint32).astype(bool)
            planes.append(np.packbits(b, bitorder="little"))
            low = x[~b]
            zeros.append(len(low))
            x = np.concatenate([low, x[b]])
        return cls(len(ids), planes, zeros)

    def _index(self) -> np.ndarray:
        """Ones before every BLOCK-th position, a row per plane."""
        if self.ranks is None:
            blocks = -(-self.n // BLOCK)
            padded = np.zeros((len(self.planes), blocks * BLOCK // 8), np.uint8)
            for row, p in zip(padded, self.planes):
                row[: len(p)] = p
            self.ranks = np.zeros((len(self.planes), blocks + 1), np.uint32)
            ones = np.bitwise_count(padded).reshape(len(self.planes), blocks, BLOCK // 8).sum(2, dtype=np.uint32)
            np.cumsum(ones, axis=1, out=self.ranks[:, 1:])
        return self.ranks

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        part = np.unpackbits(self.planes[level][block * BLOCK // 8:-(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(self._index()[level][block]) + int(part.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            b, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | b
            i = self.zeros[level] + ones if b else i - ones
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        bits = len(self.planes)
        for level in range(bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences in positions [lo, hi)."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        ranks = self._index()[level]
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks.astype(np.int64)
        block = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def occurrence(self, symbol: int, k: int) -> int | None:
        """Position of the symbol's k-th occurrence, from 0."""
        lo, hi = self._range(symbol, 0, self.n)
        if k < 0 or lo + k >= hi:
            return None
        i, bits = lo + k, len(self.planes)
        for level in reversed(range(bits)):
            bit = symbol >> (bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """The whole sequence, planes undone from the last to the first."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in reversed(range(bits)):
            b = np.unpackbits(np.asarray(self.planes[level]), count=self.n, bitorder="little").astype(bool)
            up = np.empty(self.n, kind)
            up[~b] = x[: self.zeros[level]]
            up[b] = x[self.zeros[level]:] | kind(1 << (bits - 1 - level))
            x = up
        return x.astype(np.uint32)

    def to_bytes(self, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        """Magic, JSON header, then compressed document lengths, counts of ones and blocks of planes."""
        pack = zstandard.ZstdCompressor(level=1).compress
        # counts are kept as differences, which are small
        parts = [pack(np.asarray(lengths, "<u4").tobytes()), pack(np.diff(self._index(), axis=1).astype("<u2").tobytes())]
        for p in self.planes:
            raw = np.asarray(p).tobytes()
            parts += [pack(raw[at:at + PLANE_BYTES]) for at in range(0, len(raw), PLANE_BYTES)]
        head = json.dumps({"n": self.n, "zeros": self.zeros, "sizes": [len(p) for p in parts], "docs": doc_ids}).encode()
        head = pack(head)
        return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        """The matrix, the document ids and their lengths; planes stay compressed."""
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        unpack = zstandard.ZstdDecompressor().decompress
        at = 8 + struct.unpack_from("<I", blob, 4)[0]
        head = json.loads(unpack(blob[8:at]))
        borders = [at, *(at + np.cumsum(head["sizes"])).tolist()]
        lengths, steps = (np.frombuffer(unpack(blob[borders[i]:borders[i + 1]]), kind) for i, kind in ((0, "<u4"), (1, "<u2")))
        n, bits, size = head["n"], len(head["zeros"]), -(-head["n"] // 8)
        ranks = np.zeros((bits, -(-n // BLOCK) + 1), np.uint32)
        np.cumsum(steps.reshape(bits, -1), axis=1, out=ranks[:, 1:], dtype=np.uint32)
        each = -(-size // PLANE_BYTES)
        planes = [StoredPlane(blob, borders[2 + k * each:3 + (k + 1) * each], size) for k in range(bits)]
        return cls(n, planes, head["zeros"], ranks), head["docs"], lengths


class LibraryEncoder:
    """Token ids as the tokenizers library gives them.

    Where the file's pre-splitting is the known one, the library encodes each
    distinct word once and texts are put together from its answers; else it
    encodes whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        names = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = steps[0].get("pattern") == {"Regex": WORDS} and names == ["NFC", "Replace", "Lowercase"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        suffix = spec["model"].get("end_of_word_suffix")
        self.last: np.ndarray | None = None  # whether a token ends a word
        if self.by_word and suffix:
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.cache = W.WordCache(self._words, limit=1_000_000)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has.

        Words of letters only are one unit of the pre-splitting each, so many
        go to the library as one text with spaces between; a unit's last token
        carries the end-of-word suffix and shows where the word ends.
        """
        alpha = np.fromiter((w.isalpha() for w in words), bool, len(words))
        if self.last is None or not alpha.any():
            return self._encoded(words)
        letters = [w for w, x in zip(words, alpha) if x]
        flat, _ = self._encoded([" ".join(letters[i:i + JOINED]) for i in range(0, len(letters), JOINED)])
        ends = np.flatnonzero(self.last[flat])
        if len(ends) != len(letters):  # the library knows other letters than Python
            return self._encoded(words)
        rest, rest_lens = self._encoded([w for w, x in zip(words, alpha) if not x])
        lens = np.zeros(len(words), np.int64)
        lens[alpha], lens[~alpha] = np.diff(ends, prepend=-1), rest_lens
        out, of_letters = np.zeros(len(flat) + len(rest), np.uint32), np.repeat(alpha, lens)
        out[of_letters], out[~of_letters] = flat, rest
        return out, lens

    @staticmethod
    def _plain(text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter, so no final sigma

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if not self.by_word:
            for t in texts:
                yield np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32)
            return
        # a text with marks of special tokens is cut there, each piece a text of its own
        pieces: list[str] = []
        plan: list[list[int] | None] = []
        for t in texts:
            cut = self.marks.split(t) if t and self.marks and "<|" in t else [t or ""]
            plan.append([self.special.get(x, -1) for x in cut] if len(cut) > 1 else None)
            pieces += ["" if x in self.special and len(cut) > 1 else self._plain(x) for x in cut]
        ids = self._pieces(pieces)
        for p in plan:
            if p is None:
                yield next(ids)
            else:
                yield np.concatenate([x if mark < 0 else np.array([mark], np.uint32) for x, mark in [(next(ids), mark) for mark in p]])

    def _pieces(self, texts: list[str]) -> Iterator[np.ndarray]:
        for first, last, cp, offsets in W.chunks(texts):
            n = len(cp)
            kind = W.classes()[cp]
            start = np.zeros(n, bool)
            start[offsets[offsets < n]] = True
            if n:
                start[1:] |= kind[1:] != kind[:-1]
            start |= kind == W.NUMBER
            border = np.zeros(n + 1, bool)
            border[offsets] = True
            contractions(cp, kind, start, border)
            at = np.flatnonzero(start)
            end = np.append(at[1:], n)
            word = kind[at] != W.SPACE
            at, end = at[word], end[word]
            flat, lens = self.cache.expand(self.cache.lookup(cp, at, end))
            bounds = np.concatenate([[0], np.cumsum(lens)])[W.per_text(at, offsets)]
            for i in range(last - first):
                yield flat[bounds[i]:bounds[i + 1]]


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


SHARDS = "part int, part_start bigint, n_docs bigint, n_tokens bigint, shard binary"


def encode_shards(docs: DataFrame, path: str, end_id: int, bits: int, id_col: str = "doc_id", text: str = "text",
                  shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard; shards of a range partition follow each other.

    A task holds one shard's ids at a time (a longer document is a shard of its
    own), so memory does not grow with the partition.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        e = library_encoder(path)
        held, names, size, done, part = [], [], 0, 0, 0

        def shard():
            nonlocal held, names, size, done
            x = WaveletMatrix.build(np.concatenate(held), bits)
            blob = x.to_bytes(names, [len(h) for h in held])
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([done], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([x.n], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "part_start", "n_docs", "n_tokens", "shard"])
            done, held, names, size = done + size, [], [], 0
            return out

        for b in batches:
            if b.num_rows:
                part = b.column(2)[0].as_py()
            for doc_id, ids in zip(b.column(0).to_pylist(), e.encode(b.column(1).to_pylist())):
                if held and size + len(ids) + 1 > shard_tokens:
                    yield shard()
                held.append(np.append(ids, np.uint32(end_id)).astype(np.uint32))
                names.append(doc_id)
                size += len(ids) + 1
        if held:
            yield shard()

    return ordered.mapInArrow(run, SHARDS)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of every document of stored shards.

    The running start is summed over partition totals only: one row for each
    range partition of the writer.
    """
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_base"))
    based = shards.join(starts, shards["part"] == starts["_part"]).select((F.col("_base") + F.col("part_start")).alias("start"), "shard")

    def run(batches):
        for b in batches:
            for base, blob in zip(b.column(0).to_pylist(), b.column(1)):
                x, names, lengths = WaveletMatrix.from_bytes(blob.as_py())
                data = x.all().astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                crc = [zlib.crc32(data[a:z]) for a, z in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(base + begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
