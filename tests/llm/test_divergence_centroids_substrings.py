"""Divergence audit, centroid clustering and substring dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from ledgerlark.llm import centroids, divergence, substring_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, grp int, bucket int, n bigint, part string"


def documents(spark, rows):
    """(doc_id, text, lang, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 1, 2, 3, "p") for r in rows], DOCS).repartition(3)


# -- source divergence audit ------------------------------------------------------------


def brute_audit(rows, cfg):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= cfg.min_docs]
        sources = sorted({d[1] for d in mine})
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= cfg.min_docs) for s in sources}
        count[None] = sum(count.values(), collections.Counter())
        share = {s: {t: 1 + 10**9 * (c[t] + cfg.smooth) // (sum(c.values()) + cfg.smooth * len(kept)) for t in kept} for s, c in count.items()}
        for s in sources:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(share[s][t] - share[None][t], t) for t in kept if count[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, f, i + 1) for i, (f, o) in enumerate(found) if part == "pair" or i < cfg.top]
    return sorted(out)


def audited(spark, rows, cfg):
    got = divergence.audit(documents(spark, rows), cfg)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["É", "Ünlü", "日本", "A", "a", "Zz"]
    rows = [(i, " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 30))) + rng.choice([" 12", "_x", "\x7f", ""]),
             rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "é", "z", None])) for i in range(160)]
    rows += [(None, None, "xx", "s"), (7, "", "xx", "t"), (7, "a a A", "xx", "t"), (8, "\x00 \x40", "yy", "only")]
    rows += [rows[3]] * 5
    for cfg in (divergence.AuditConfig(min_docs=6, top=3, block=7, held=40), divergence.AuditConfig(min_docs=2)):
        assert audited(spark, rows, cfg) == brute_audit(rows, cfg)


def test_audit_without_terms_or_rows(spark):
    rows = [(1, None, "en", "a"), (2, "one", "en", "b"), (3, "two", "en", "c")]
    got = audited(spark, rows, divergence.AuditConfig())
    assert got == [("en", s, "pair", o, 0, i + 1) for s, others in (("a", "bc"), ("b", "ac"), ("c", "ab")) for i, o in enumerate(others)]
    assert audited(spark, [], divergence.AuditConfig()) == []


def test_audit_long_text_and_large_counts(spark):
    cfg = divergence.AuditConfig(min_docs=1)
    rows = [(1, "ab CD " * 200_000, "en", "a"), (2, "ab " + "x" * 100_000, "en", "b")]
    assert audited(spark, rows, cfg) == brute_audit(rows, cfg)
    n = np.array([0, 5 * 10**10, 3 * 10**12])
    assert divergence.shares(n, 10**13, 7, 5).tolist() == [1 + 10**9 * (int(c) + 5) // (10**13 + 35) for c in n]


def test_scatter_needs_no_posting_pairs():
    """One block against the dense definition, zero counts on both sides included."""
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 4, (40, 6)) * rng.integers(0, 2, (40, 6))
    dense[:, 5] = 0
    dense = dense[dense.any(1)]
    term, group = np.nonzero(dense)
    totals, v = dense.sum(0) + rng.integers(0, 50, 6), len(dense) + 9
    share = 1 + 10**9 * (dense + 5) // (totals + 5 * v)
    pairs, excess = divergence.compare_block(term, group, dense[term, group], totals, int(totals.sum()), v, 5)
    assert (pairs == np.abs(share[:, :, None] - share[:, None, :]).sum(0)).all()
    lang = 1 + 10**9 * (dense.sum(1) + 5) // (totals.sum() + 5 * v)
    assert (excess == share[term, group] - lang[term]).all()


# -- centroid clustering ----------------------------------------------------------------


def brute_lloyd(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(v))) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [list(x) for _, x in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, where) in zip(kept, at) if where == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    of = collections.Counter()
    for d, j in at:
        of[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, of[j], sum(of.values()), sha[j]) for (i, _), (d, j) in zip(kept, at)), key=str)


def clustered(spark, rows):
    df = spark.createDataFrame([(i, x, 1, "x", 2) for i, x in rows], "vec_id bigint, embedding array<double>, cluster int, x string, distance int")
    got = centroids.digests(centroids.cluster(df.repartition(3)))
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 2, (5, dims))
    return [(i, [float(v) for v in centre[i % 5] + rng.normal(0, 1, dims)]) for i in range(n)]


def test_clustering_equals_brute_force(spark):
    rows = vectors(1, 90)
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [0.0] * 63), (205, [float("nan")] * 64), (206, [float("inf")] * 64)]
    rows += [(5, rows[5][1])] * 4 + [(6, rows[9][1]), (None, rows[8][1]), (300, [0.0] * 64), (301, [0.0] * 64), (302, [-1e-9] * 64)]
    assert clustered(spark, rows) == brute_lloyd(rows)


@pytest.mark.parametrize("n", [0, 1, 7, 8])
def test_clustering_of_few_vectors(spark, n):
    rows = vectors(2, n)
    assert clustered(spark, rows) == brute_lloyd(rows)
    same = [(i, [0.5] * 64) for i in range(n)]
    assert clustered(spark, same) == brute_lloyd(same)


def test_search_is_exact_and_rejects():
    rng = np.random.default_rng(5)
    centre = rng.integers(-20_000, 20_000, (60, 64))
    c = centre + rng.integers(0, 3000, (60, 1))
    c[7] = c[3]  # a tie between centroids
    x = np.concatenate([c[rng.integers(0, 60, 800)] + rng.integers(-200, 200, (800, 64)), c, (c[:30] + c[30:]) // 2])
    number, distance, measured = centroids.Searcher(c).nearest(x)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert measured < len(x) * len(c) / 3


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        clustered(spark, [(1, [1e9] * 64)])


# -- substring dedup --------------------------------------------------------------------


def brute_substrings(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j:j + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for j in range(len(w) - window + 1) if i is not None and least[tuple(w[j:j + window])] < i for k in range(j, j + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def substrings(spark, rows, **config):
    df = documents(spark, [(i, t, None, None) for i, t in rows])
    got = substring_dedup.dedup_substrings(df, substring_dedup.SubstringConfig(**config), digest=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def copied(seed, n):
    """Documents that hold passages of each other at any offset, of lengths around a window."""
    rng = random.Random(seed)
    fresh = (f"w{i}" for i in itertools.count())
    passages = [[next(fresh) for _ in range(rng.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [next(fresh) for _ in range(rng.randint(0, 9))]
            p = rng.choice(passages)
            a = rng.randint(0, 6)
            words += p[a:a + rng.randint(5, 40)]
        rows.append((rng.randint(-50, 50) * 10**rng.choice([0, 9, 16]), rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("balance", [1 << 14, 4])
def test_substrings_equal_brute_force(spark, balance):
    rows = copied(balance, 150)
    rows += [(None, rows[0][1]), (1, None), (2, ""), (3, " \n"), rows[4], rows[4], (5, "a " * 400), (4, "a " * 14), (9, "é 日本 😀 " * 9), (10, "é 日本 😀 " * 9)]
    rows += [(11, rows[4][1]), (2**63 - 1, rows[4][1]), (-2**63, "a " * 13)]
    assert substrings(spark, rows, balance=balance) == brute_substrings(rows)


def test_substrings_of_long_text_and_none(spark):
    long = " ".join(f"t{i % 5000}" for i in range(300_000))
    rows = [(2, long), (1, " ".join(f"t{i}" for i in range(100))), (3, "x" * 500_000)]
    assert substrings(spark, rows) == brute_substrings(rows)
    assert substrings(spark, []) == []


@pytest.mark.parametrize("window,period,cover", [(13, 7, (0, 1, 3)), (5, 3, (0, 1)), (20, 13, (0, 1, 3, 9)), (4, 1, (0,)), (7, 7, (0, 1, 3))])
def test_a_match_of_a_window_shares_an_anchor(window, period, cover):
    """Whatever the two offsets, some anchor of equal words is at a cover position of both."""
    cfg = substring_dedup.SubstringConfig(window=window, period=period, cover=cover)
    same = " ".join(f"s{i}" for i in range(window))
    for a in range(period):
        for b in range(period):
            texts = [" ".join([f"{side}{i}" for i in range(n)] + [same, "end" + side]) for side, n in (("l", a), ("r", b))]
            g = substring_dedup.Group([1, 2], texts, cfg)
            at, values = g.anchors()
            assert set(values[g.doc[at] == 0].tolist()) & set(values[g.doc[at] == 1].tolist())


def test_covers_are_checked():
    with pytest.raises(ValueError):
        substring_dedup.SubstringConfig(cover=(0, 1))
    with pytest.raises(ValueError):
        substring_dedup.SubstringConfig(window=5)


def test_texts_are_shuffled_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    df = substring_dedup.dedup_substrings(docs, digest=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(exchanges) == 5 and plan.count("ReusedExchange") == 3
