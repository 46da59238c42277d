"""Exact n-gram Jaccard self-join by set-relation skipping.

Sets that are equal are one set from the start. The rest follows the prefix
principle: in one order of all shingles, two linked sets share a shingle among
the first few of each. Shingles known to be frequent come last in that order,
so lists of shared passages hardly arise.

* Index lists: the prefix shingles of every set with its size and position,
  in blocks of equal (shingle, size, position). A pair of blocks is skipped as
  a whole when size or position leave too little to share, or when all members
  of both are in one class already.
* Answers from similar sets: each list first tests its members with a few leaders
  only, the first in orders by hash that some lists share: a large group meets
  many leaders and not one that may be an outlier. What a member lacks and adds against its leader is kept, and the
  overlap of two members of one leader follows from these small differences:
  |x & y| = |L| - |miss x U miss y| + |extra x & extra y|. Only pairs of
  different classes are still asked for, since a link inside a class cannot
  change the classes.
* Parity bitmaps bound the symmetric difference from below: a short one of fixed
  length where lists are joined, so that a pair out of reach is never made, then
  one of the set's own length, so that whole sets meet only where a link is
  possible; then they are compared in full.

The result is exact up to equality of 64-bit hashes. No list is capped. The
list of frequent shingles is bounded (it only orders, a shorter one is slower
and not less exact).

Defined results: texts without words have an empty set and link with nothing,
rows with equal sets are one class, repeated rows stay as they are, an empty
table gives an empty result, columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components, discard, release_shuffles, stored
from .ngram_sets import fingerprint, shingle_sets

#: Bound on the frequent shingles that the driver sends to the tasks (8 bytes each).
FREQUENT = 200_000
LEAST_COUNT = 8
#: Rows of a batch whose shingles a worker holds at once.
ROWS = 1024
#: 64-bit words of the bitmap by which pairs are judged as they are made.
WORDS = 16
#: Leaders of a list, each the first of its sets in an order of its own.
LEADERS = 6
#: Sets of such orders; lists of one set and group mostly share their leaders.
ORDERS = 32
#: Share of all hash values within which frequencies are counted.
COUNTED = 0.3


@dataclass(frozen=True)
class JoinConfig:
    """Link when ``den * intersection >= num * union`` of ``width``-word shingles."""

    width: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def need(self, a: Column, b: Column) -> Column:
        total = self.num * (a + b)
        return F.ceil(total / F.lit(float(self.num + self.den)) - F.lit(1e-9))

    def most(self, a: Column, b: Column) -> Column:
        """In how many shingles two linked sets of these sizes differ at most."""
        return a + b - 2 * self.need(a, b)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return self.num * F.greatest(a, b) <= self.den * F.least(a, b)

    def links(self, inter: Column, a: Column, b: Column) -> Column:
        return self.den * inter >= self.num * (a + b - inter)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a few rows, so that a worker holds the shingles of these alone."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def set_sizes(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """doc_id, n_shingles, sig, bits and map: the set's size, 64-bit fingerprint, parity bitmap and the same in WORDS words."""

    def run(batches):
        for part in slices(batches):
            sets = [(len(s), fingerprint(s), bitmap(s), np.frombuffer(bitmap(s, 64 * WORDS), np.int64)) for s in shingle_sets(part.column(1).to_pylist(), config.width)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([x[k] for x in sets], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))],
                names=["doc_id", "n_shingles", "sig", "bits", "map"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, sig bigint, bits binary, map array<bigint>")


def frequent_shingles(docs: DataFrame, config: JoinConfig) -> np.ndarray:
    """At most FREQUENT of the most frequent shingles, sorted."""
    top = np.uint64(int(COUNTED * (1 << 64)))

    def run(batches):
        for b in slices(batches):
            # copies, since a view would hold the whole set
            part = [s[: np.searchsorted(s, top)].copy() for s in shingle_sets(b.column(1).to_pylist(), config.width)]
            token, n = np.unique(np.concatenate(part), return_counts=True)
            for lo in range(0, len(token), 1 << 18):
                yield pa.RecordBatch.from_arrays([_signed(token[lo:lo + (1 << 18)]), pa.array(n[lo:lo + (1 << 18)].astype(np.int64))], names=["token", "n"])

    counts = docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    counts = stored(counts.withColumn("level", F.floor(4 * F.log2("n")).cast("int")), "ngram_counts")
    release_shuffles(docs.sparkSession)
    total, level = 0, None
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > FREQUENT:
            break
        level = r["level"]
    if level is None:
        discard(counts)
        return np.zeros(0, np.uint64)
    got = counts.where(F.col("level") >= level).select("token").toArrow().column(0).to_numpy()
    discard(counts)
    return np.sort(got.astype(np.int64).view(np.uint64))


def prefix_lists(docs: DataFrame, frequent: np.ndarray, config: JoinConfig) -> DataFrame:
    """token, sig, n, pos of every prefix shingle of every distinct set."""

    def run(batches):
        seen: set[int] = set()
        for b in slices(batches):
            rows = []
            for s in shingle_sets(b.column(1).to_pylist(), config.width):
                if not len(s):
                    continue
                sig = fingerprint(s)
                if sig in seen:  # copies met before in this task
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(sig)
                if len(frequent):
                    at = np.searchsorted(frequent, s)
                    at[at == len(frequent)] = 0
                    late = frequent[at] == s
                    s = np.concatenate([s[~late], s[late]])
                p = config.prefix(len(s))
                rows.append((s[:p].copy(), sig, len(s)))
            if rows:
                lens = [len(t) for t, _, _ in rows]
                yield pa.RecordBatch.from_arrays([
                    _signed(np.concatenate([t for t, _, _ in rows])), pa.array(np.repeat(np.array([x for _, x, _ in rows], np.int64), lens)),
                    pa.array(np.repeat([n for *_, n in rows], lens).astype(np.int32)), pa.array(np.concatenate([np.arange(k) for k in lens]).astype(np.int32))],
                    names=["token", "sig", "n", "pos"])

    lists = stored(docs.mapInArrow(run, "token bigint, sig bigint, n int, pos int").distinct(), "ngram_lists")
    release_shuffles(docs.sparkSession)
    # a list of one set answers nothing
    live = lists.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    out = stored(lists.join(live, "token"), "ngram_live")
    discard(lists)
    release_shuffles(docs.sparkSession)
    return out


def bitmap(s: np.ndarray, size: int = 0) -> bytes:
    """Parity of the shingles in each of ``size`` slots (a power of two), else of 2n or more."""
    size = size or max(256, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing_at_least(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference; the longer bitmap is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):  # slots are hash bits, so folding keeps them aligned
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def needed_sets(docs: DataFrame, heads: DataFrame, pairs: DataFrame, config: JoinConfig) -> DataFrame:
    """sig and tokens of every set in the pairs (a, b)."""
    sigs = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    first = heads.select("sig", "doc_id").join(sigs, "sig", "left_semi")

    def run(batches):
        seen: set[int] = set()
        for part in slices(batches, 512):
            sets = list(shingle_sets(part.column(1).to_pylist(), config.width))
            keep = []
            # rows that share a doc_id may hold other texts, or the same again
            for i, (s, sig) in enumerate(zip(sets, part.column(0).to_pylist())):
                if sig not in seen and fingerprint(s) == sig:
                    seen.add(sig)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["sig", "tokens"])

    texts = docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"])).select("sig", "text")
    out = stored(texts.mapInArrow(run, "sig bigint, tokens array<bigint>"), "ngram_sets")
    release_shuffles(docs.sparkSession)
    return out


def possible(pairs: DataFrame, heads: DataFrame, config: JoinConfig) -> DataFrame:
    """Pairs (a, b, na, nb) whose bitmaps leave a link possible."""

    def run(batches):
        for b in batches:
            na, nb, x, y = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
            keep = []
            for i in range(b.num_rows):
                t = na[i] + nb[i]
                keep.append(differing_at_least(x[i], y[i]) <= t + 2 * (-config.num * t // (config.num + config.den)))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3])

    bits = heads.select(F.col("sig").alias("a"), F.col("bits").alias("x"))
    both = pairs.join(bits, "a").join(bits.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "na", "nb", "x", "y")
    return stored(both.mapInArrow(run, "a bigint, b bigint, na int, nb int"), "ngram_possible")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with what b lacks of a and what it adds, from whole sets."""
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", "na", "nb", F.array_except("ta", "tb").alias("miss"), F.array_except("tb", "ta").alias("extra"))


def in_reach(x: Column, y: Column, a: Column, b: Column, config: JoinConfig) -> Column:
    """Whether the short bitmaps of two sets leave a link possible."""
    return sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(WORDS)), F.lit(0)) <= config.most(a, b)


def leaders(value: Column) -> Column:
    """``value`` of each of a list's leaders; no two sets of a list are equal in an order."""
    return F.array(*(F.min_by(value, F.xxhash64(F.lit(k), F.pmod("token", F.lit(ORDERS)), "sig")) for k in range(LEADERS)))


def near(a: Column, b: Column, pa_: Column, pb: Column, config: JoinConfig) -> Column:
    return config.sizes_fit(a, b) & (F.least(a - pa_, b - pb) >= config.need(a, b))


def links(docs: DataFrame, heads: DataFrame, config: JoinConfig) -> DataFrame:
    """Edges (a, b) between fingerprints: every class of linked sets is connected by them."""
    lists = prefix_lists(docs, frequent_shingles(docs, config), config)

    # every list's members against its leaders
    lead = lists.groupBy("token").agg(leaders(F.struct("sig", "n", "pos")).alias("leads"))
    star = lists.join(lead, "token").withColumn("l", F.explode(F.array_distinct("leads")))
    star = star.where(F.col("sig") != F.col("l.sig")).where(near(F.col("l.n"), F.col("n"), F.col("l.pos"), F.col("pos"), config))
    star = star.select(F.col("l.sig").alias("a"), F.col("sig").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb")).distinct()
    star = possible(star, heads, config)
    sets = needed_sets(docs, heads, star, config)
    answers = compared(star, sets)
    answers = stored(answers.withColumn("linked", config.links(F.col("nb") - F.size("extra"), F.col("na"), F.col("nb"))), "ngram_answers")
    discard(sets)
    discard(star)
    release_shuffles(docs.sparkSession)
    first = answers.where("linked").select("a", "b")
    classes = stored(connected_components(first), "ngram_classes")

    # lists that still hold more than one class
    members = lists.join(classes.withColumnRenamed("id", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    spread = members.groupBy("token").agg(leaders(F.struct("sig", "comp")).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    members = stored(members.join(spread.select("token", F.col("l")[0]["comp"].alias("lead"), F.col("l.sig").alias("leads")), "token"), "ngram_members")
    discard(lists)
    release_shuffles(docs.sparkSession)
    # one side of each pair is outside the first leader's class, and leaders have met all others
    free = members.where(~F.array_contains("leads", F.col("sig")))
    others = free.where("comp <> lead")
    blocks = free.groupBy("token", "n", "pos").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    own = others.groupBy("token", "n", "pos").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = own.alias("x"), blocks.alias("y")
    kept = x.join(y, F.col("x.token") == F.col("y.token")).where(near(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"), config)).where(
        (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))).select(
        F.col("x.token").alias("token"), F.col("x.n").alias("n"), F.col("x.pos").alias("pos"), F.col("y.n").alias("yn"), F.col("y.pos").alias("ypos"))
    maps = heads.select("sig", "map")
    side = free.join(maps, "sig").select(
        "token", F.col("n").alias("yn"), F.col("pos").alias("ypos"), F.col("sig").alias("ysig"), F.col("comp").alias("ycomp"), F.col("map").alias("ymap"))
    pairs = kept.join(others.join(maps, "sig").select("token", "n", "pos", "sig", "comp", "lead", "map"), ["token", "n", "pos"]).join(side, ["token", "yn", "ypos"])
    # one way round where both sets are outside the leader's class
    pairs = pairs.where("comp <> ycomp and (sig < ysig or ycomp = lead)").where(
        in_reach(F.col("map"), F.col("ymap"), F.col("n"), F.col("yn"), config)).select(
        F.least("sig", "ysig").alias("a"), F.greatest("sig", "ysig").alias("b"),
        F.when(F.col("sig") < F.col("ysig"), F.col("n")).otherwise(F.col("yn")).alias("na"),
        F.when(F.col("sig") < F.col("ysig"), F.col("yn")).otherwise(F.col("n")).alias("nb"))
    pairs = found = stored(pairs.distinct(), "ngram_pairs")
    discard(members)
    release_shuffles(docs.sparkSession)

    # of two members of one leader the overlap follows from their differences
    best = answers.groupBy("b").agg(F.min(F.struct((F.size("miss") + F.size("extra")).alias("d"), F.col("a"))).alias("m")).select("b", F.col("m.a").alias("a"))
    kept_answers = answers.join(best, ["a", "b"]).select(F.col("b").alias("id"), F.col("a").alias("leader"), F.col("na").alias("nl"), "miss", "extra")
    led = kept_answers.select("id", "leader")
    pairs = pairs.join(led.select(F.col("id").alias("a"), F.col("leader").alias("la")), "a", "left").join(
        led.select(F.col("id").alias("b"), F.col("leader").alias("lb")), "b", "left")
    same = F.coalesce(F.col("la") == F.col("lb"), F.lit(False))
    p, q = kept_answers.select(F.col("id").alias("a"), "nl", F.col("miss").alias("ma"), F.col("extra").alias("ea")), kept_answers.select(
        F.col("id").alias("b"), F.col("miss").alias("mb"), F.col("extra").alias("eb"))
    overlap = F.col("nl") - F.size(F.array_union("ma", "mb")) + F.size(F.array_intersect("ea", "eb"))
    derived = pairs.where(same).join(p, "a").join(q, "b").where(config.links(overlap, F.col("na"), F.col("nb"))).select("a", "b")
    rest = possible(pairs.where(~same).select("a", "b", "na", "nb"), heads, config)
    sets = needed_sets(docs, heads, rest, config)
    asked = compared(rest, sets)
    asked = asked.where(config.links(F.col("nb") - F.size("extra"), F.col("na"), F.col("nb"))).select("a", "b")
    second = stored(derived.union(asked).distinct(), "ngram_links")
    for done in (found, rest, sets):
        discard(done)
    release_shuffles(docs.sparkSession)
    return first.union(second)


def classes(docs: DataFrame, config: JoinConfig = JoinConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id: the least id reachable by links."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    release_shuffles(docs.sparkSession)  # those of the step that made the documents
    sizes = stored(set_sizes(rows, config), "ngram_sizes")
    heads = sizes.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("bits").alias("bits"), F.min("map").alias("map"))
    heads = stored(heads, "ngram_heads")
    sizes = sizes.select("doc_id", "n_shingles", "sig")
    comps = connected_components(links(rows, heads, config)).withColumnRenamed("id", "sig")
    # the class of every distinct set and its least row, then back to the rows
    least = heads.select("sig", F.col("doc_id").alias("first"))
    named = least.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    tops = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    tops = named.join(tops, "comp").select("sig", "component_id")
    empty = F.col("n_shingles") == 0
    return sizes.join(tops, "sig", "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
