"""Stages of the pipeline on hard input: NULLs, repeated and clashing rows, empty tables."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import components, line_dedup, ngram_join, quality_rules
from ledgerlark.llm.components import stored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int, _id string, _of bigint, extra string"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 1, "x", 2, "y") for i, t in rows], DOCS).repartition(3)


def kept(spark, rows):
    out = STAGES["ngram_jaccard_join"](spark, frame(spark, rows), "")
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


BASE = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))


def test_one_row_of_each_group_stays(spark):
    assert kept(spark, [(3, BASE), (2, BASE + " end"), (9, OTHER)]) == [(2, BASE + " end"), (9, OTHER)]


def test_rows_are_told_apart_by_text_not_id(spark):
    # two rows of one id and different texts; the least row of a class shares its id with another text
    assert kept(spark, [(1, BASE), (5, BASE), (5, OTHER), (1, "a lone text of its own")]) == [
        (1, "a lone text of its own"), (1, BASE), (5, OTHER)]


def test_repeated_rows_and_rows_without_id(spark):
    assert kept(spark, [(7, BASE)] * 4 + [(None, BASE), (None, OTHER), (None, OTHER)]) == [(7, BASE), (None, OTHER)]


def test_documents_without_words_are_one_group(spark):
    assert kept(spark, [(4, ""), (3, None), (8, " \n\t "), (None, None), (5, BASE)]) == [(3, None), (5, BASE)]
    assert kept(spark, []) == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows(spark, name):
    hard = [(1, None), (2, ""), (3, "x " * 4000), (3, "x " * 4000), (None, BASE), (4, BASE + "\n" + OTHER), (5, BASE + "\n" + OTHER)]
    for rows in (hard, []):
        docs = stored(frame(spark, rows), "hard")
        out = STAGES[name](spark, docs, "")
        n = out.count()
        if name == "best_fit_packing":  # long documents are placed in pieces
            assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
            continue
        assert n <= len(rows)
        if name in ("line_dedup", "secret_scan"):
            assert n == len(rows)
        assert out.columns == docs.columns


def test_ledger_takes_clashing_names(spark):
    """Columns named like the ledger's own working columns are kept as they are; measured names are replaced."""
    own = ["_words", "_lines", "_hash", "_placed", "_twice", "_given", "a.b"]
    df = spark.createDataFrame([(1, "one two three two", 9, *range(7))], ["doc_id", "text", "n_words", *own])
    out = quality_rules.ledger(df)
    row = out.first().asDict()
    assert [row[c] for c in own] == list(range(7)) and row["n_words"] == 4
    plain = quality_rules.ledger(df.select("doc_id", "text")).first().asDict()
    assert {k: v for k, v in row.items() if k not in own} == plain


def test_tables_that_nothing_reads_are_deleted(spark, tmp_path, monkeypatch):
    """Line dedup and the near-duplicate join leave only tables that their results read."""
    monkeypatch.setattr(components, "scratch_path", lambda _, label: f"{tmp_path}/{label}/{uuid.uuid4().hex}")

    def left():
        return {p.parent.name for p in tmp_path.glob("*/*")}

    docs = frame(spark, [(i, BASE + "\n" + " ".join(f"{'abc'[i % 3]}{j}" for j in range(40)) + f" {i}") for i in range(12)])
    lines = STAGES["line_dedup"](spark, docs, "")
    assert lines.count() == 12
    assert left() == {"components", "line_weak", "line_final", "line_seen"}
    near = STAGES["ngram_jaccard_join"](spark, docs, "")
    assert 0 < near.count() <= 12
    assert not left() & {"ngram_counts", "ngram_lists", "ngram_live", "ngram_members", "ngram_pairs", "ngram_possible", "ngram_sets"}


def test_lines_are_hashed_once(spark):
    """A line of several pairs has its distinct shingles worked out once, whatever its characters."""
    lines = ["abcabcabcabc \U0001f600 end of it", "short", "another line with its own words"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, lines[0])], "doc_id long, text string")
    ids = spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("xxhash64(line) AS id", "line").collect()
    of = {r["line"]: r["id"] for r in ids}
    pairs = spark.createDataFrame([(of[lines[0]], of[lines[2]]), (of[lines[2]], of[lines[0]])], "a long, b long")
    got = {r["line_id"]: r["shingles"] for r in line_dedup.lines_in(docs, pairs, line_dedup.WHOLE).collect()}
    assert set(got) == {of[lines[0]], of[lines[2]]}
    for x in (lines[0], lines[2]):
        assert len(got[of[x]]) == len(set(got[of[x]])) == len({x[i:i + 8] for i in range(len(x) - 7)})
    assert line_dedup.similar(pairs, line_dedup.lines_in(docs, pairs, line_dedup.WHOLE), line_dedup.WHOLE).count() == 0


def test_shingles_of_one_round_at_a_time(spark, tmp_path, monkeypatch):
    """Shingles, many times the size of the lines, are stored only for a share of the compared lines, and go before the next share's."""
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz_") for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*lines, *(x[:-4] + "0123" for x in lines)])), "doc_id long, text string")
    monkeypatch.setattr(components, "scratch_path", lambda _, label: f"{tmp_path}/{label}/{uuid.uuid4().hex}")
    held, stored = [], line_dedup.stored

    def counted(df, label):
        out = stored(df, label)
        if label == "lines":
            held.append((out.count(), len(list(tmp_path.glob("lines/*")))))
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    got = {r["doc_id"] for r in line_dedup.dropped_lines(docs, line_dedup.WHOLE).collect()}
    assert got == set(range(60, 120))
    assert sum(n for n, _ in held) >= 120 and max(n for n, _ in held) < 90 and {at_once for _, at_once in held} == {1}


def test_quality_writes_no_copy_and_measures_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(components, "scratch_path", lambda _, label: f"{tmp_path}/{label}/{uuid.uuid4().hex}")
    docs = frame(spark, [(1, BASE), (2, None), (None, "few words")])
    out = STAGES["quality_rules"](spark, docs, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    want = quality_rules.ledger(docs).collect()
    want = sorted((r["doc_id"] or 0) for r in want if not r["fail_bits"] & quality_rules.mask_of(quality_rules.POLICIES[corpus_pipeline.POLICY]))
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == want
    assert not list(tmp_path.glob("*/*")) and plan.count("AS _twice#") == 1


def test_unlike_lines_of_a_bucket_are_never_paired(spark, monkeypatch):
    """Lines that share most bands' bins and still too few shingles make no pairs; no link is lost."""
    rng = random.Random(4)

    def text(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).replace(" ", "_")

    common = text(150)
    lines = [common + text(75) for _ in range(80)]
    lines += [x[:-3] + text(3) for x in lines[:20]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    made, similar = [], line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, *a: made.append(pairs.count()) or similar(pairs, *a))
    got = {r["doc_id"] for r in line_dedup.dropped_lines(docs, line_dedup.WHOLE).collect()}
    assert got == set(range(80, 100))
    assert len(made) == 2 and made[1] < 100  # 4 950 pairs in all


def _classes(sets, linked):
    """The least index reachable by links, of each set."""
    comp = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if linked(x, sets[j]) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return comp


def test_group_of_near_lines_meets_several_leaders(spark, monkeypatch):
    """Most of a group of lines around the threshold is linked through leaders; few pairs are left to compare, each made once."""
    rng = random.Random(6)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz_") for _ in range(400)]
    lines = []
    for _ in range(150):
        x = list(base)
        for _ in range(rng.randint(0, 8)):
            x[rng.randrange(400)] = rng.choice("ABCDEFGHIJ")
        lines.append("".join(x))
    comp = _classes([{x[i:i + 8] for i in range(393)} for x in lines], lambda x, y: len(x & y) >= 0.8 * len(x | y))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    made, similar, rows, distinct = [], line_dedup.similar, [], type(docs).distinct
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, *a: made.append(pairs.count()) or similar(pairs, *a))
    monkeypatch.setattr(type(docs), "distinct", lambda df: df.columns == ["a", "b"] and rows.append(df.count()) or distinct(df))
    got = {r["doc_id"] for r in line_dedup.dropped_lines(docs, line_dedup.WHOLE).collect()}
    assert got == {k for k, c in enumerate(comp) if c != k}
    assert made[0] < 6000 and made[1] < 200 and rows[1] == made[1]  # 11 175 pairs in all


def test_group_of_near_texts_makes_few_pairs(spark, monkeypatch):
    """Texts of a group, one edit more or less than the threshold apart, are paired only where a link is in reach; no link is lost."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(147)]
    texts = []
    for _ in range(150):
        x = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 5, 6, 7))):
            x[rng.randrange(147)] = f"x{rng.randint(0, 10**6)}"
        texts.append(x)
    comp = _classes([{tuple(x[i:i + 4]) for i in range(144)} for x in texts], lambda x, y: 100 * len(x & y) >= 85 * len(x | y))
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    rows, distinct = [], type(docs).distinct
    monkeypatch.setattr(type(docs), "distinct", lambda df: df.columns == ["a", "b", "na", "nb"] and rows.append(df.count()) or distinct(df))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs).collect()}
    assert got == dict(enumerate(comp))
    assert len(rows) == 2 and rows[1] < 1000


def test_parity_bound_loses_no_similar_pair(spark):
    """Whatever reaches the threshold passes the bound, at any length."""
    rng = random.Random(8)
    pairs = []
    for k in range(120):
        x = [rng.choice("abcdefgh ") for _ in range(rng.choice([8, 12, 40, 200, 900, 4000]))]
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 60))):
            y[rng.randrange(len(y))] = "X"
        pairs.append(("".join(x) + f"{k}", "".join(y) + f"{k}"))
    sets = [[{x[i:i + 8] for i in range(max(1, len(x) - 7))} for x in p] for p in pairs]
    alike = {k for k, (x, y) in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)}
    docs = spark.createDataFrame([("\n".join(p),) for p in pairs], "text string")
    ids = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, x string, y string").selectExpr("k", "xxhash64(x) AS a", "xxhash64(y) AS b")
    config = line_dedup.WHOLE
    maps = line_dedup.parity(line_dedup.lines_in(docs, ids, config), config)
    x, y = (maps.toDF(side, f"n{side}", f"m{side}") for side in "ab")
    both = ids.join(x, "a").join(y, "b").where(line_dedup.may_be_similar(F.col("ma"), F.col("mb"), F.col("na"), F.col("nb"), config))
    got = {r["k"] for r in both.collect()}
    assert 20 < len(alike) < 120 and alike <= got


def test_join_holds_few_rows_shingles(spark, monkeypatch):
    """However many rows an Arrow batch has, a worker cuts the shingles of a slice alone, and each row's."""
    asked, cut = [], ngram_join.shingle_sets
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda texts, width: asked.append(len(texts)) or cut(texts, width))
    texts = [" ".join(f"w{i % 50 + j}" for j in range(8)) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["doc_id", "text"])

    class Docs:
        """What mapInArrow is given runs here."""

        sparkSession = spark

        def mapInArrow(self, run, schema):
            return spark.createDataFrame(pa.Table.from_batches(run(iter([batch]))).to_pylist(), schema)

    sizes = ngram_join.set_sizes(Docs(), ngram_join.JoinConfig())
    assert sizes.count() == 3000
    ngram_join.frequent_shingles(Docs(), ngram_join.JoinConfig())
    lists = ngram_join.prefix_lists(Docs(), np.zeros(0, np.uint64), ngram_join.JoinConfig())
    assert lists.select("sig").distinct().count() <= 50
    assert sum(asked) == 9000 and max(asked) <= 1024
