"""The shard file: what stands in it, and how little of it a lookup decompresses."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlark.llm import wavelet


def test_lookups_touch_few_blocks():
    n, bits = 3 * wavelet.PLANE_BYTES * 8 + 777, 10
    x = np.random.default_rng(3).integers(0, 1 << bits, n).astype(np.uint32)
    blob = wavelet.WaveletMatrix.build(x, bits).to_bytes([7], [n])
    w, docs, lengths = wavelet.WaveletMatrix.from_bytes(blob)
    assert docs == [7] and lengths.tolist() == [n] and not any(p.decoded for p in w.planes)
    at = n // 2
    assert w.access(at) == x[at]
    assert all(len(p.decoded) == 1 for p in w.planes)
    for i in (0, 1, wavelet.PLANE_BYTES * 8 - 1, wavelet.PLANE_BYTES * 8, n - 1):
        assert w.access(i) == x[i]
    for lo, hi in ((0, n), (511, 513), (wavelet.PLANE_BYTES * 8, n), (5, 5)):
        assert w.count(int(x[0]), lo, hi) == int((x[lo:hi] == x[0]).sum())
    spots = np.flatnonzero(x == x[at])
    for k in (0, len(spots) // 2, len(spots) - 1):
        assert w.occurrence(int(x[at]), k) == spots[k]
    assert w.occurrence(int(x[at]), len(spots)) is None
    assert np.array_equal(w.all(), x)


def test_counts_of_ones_are_in_the_file():
    for n in (1, 511, 512, 513, 5000):
        x = np.arange(n, dtype=np.uint32) % 7
        built = wavelet.WaveletMatrix.build(x, 3)
        read, *_ = wavelet.WaveletMatrix.from_bytes(built.to_bytes([None], [n]))
        assert read.ranks is not None and np.array_equal(read.ranks, built._index())
        assert [read.access(i) for i in (0, n // 2, n - 1)] == [x[0], x[n // 2], x[n - 1]]


def test_joined_words_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), wavelet.LibraryEncoder(path)
    words = [*(f"w{chr(97 + i % 26)}{'xyz' * (i % 5)}é" for i in range(200)), "12", "'s", "don't", "naïve", "漢字", "ǆ", "ª", "ⅷ", "!?", "́a", "é", "İ", "ß"]
    flat, lens = own._words([own._plain(w) for w in words])
    got = np.split(flat, np.cumsum(lens)[:-1])
    assert [g.tolist() for g in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
