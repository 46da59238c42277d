"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Equal lines are one line from the start. A line's shingles are its runs of
SHINGLE characters (the whole line, if shorter), hashed once each; the least
hash in each of BINS bins is its signature (one-permutation MinHash; an empty
bin takes one of the next three, else the least hash of all). Bands of ROWS bins bring likely pairs together,
whose Jaccard similarity is then computed exactly from the shingles, and
distributed union-find turns the links into components. One line per component
stays: its first occurrence by document and position.

Buckets are never cut: each tests its members with a few leaders, and then only
pairs of different components, so a bucket of many copies costs its size. Leaders
are the first in orders by hash that a few buckets share, so that a large group
meets several of them and not one that may be an outlier. Where components share a bucket, parity bitmaps
of the whole shingle sets bound from below in how many shingles two lines differ:
a pair that cannot reach the threshold is never made, and no other one is lost.
A pair of several buckets is made in the first of them only.

Defined results: lines with fewer than MIN_CHARS characters (blank ones too)
are never compared; they always stay, or, with ALL_REPEATS, go as exact repeats
unless they are blank; a NULL text stays NULL, an empty one empty;
a text all of whose lines went is empty and its row stays; rows
with equal ids count as one document, so exact repeats of a row keep or lose
the same lines; an empty table gives an
empty table; all other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components, discard, release_shuffles, stored


def _ring(bins: int, rows: int, steps: tuple[int, ...], stride: int) -> tuple[tuple[int, ...], ...]:
    """Bands over a ring of bins: every ``stride``-th start, by each step."""
    return tuple(tuple((b + k * s) % bins for k in range(rows)) for s in steps for b in range(0, bins, stride))


@dataclass(frozen=True)
class LineConfig:
    shingle: int = 8
    bins: int = 24
    #: Which bins make up each band.
    bands: tuple[tuple[int, ...], ...] = _ring(24, 5, (1, 5, 7), 5)
    #: Bands whose buckets are counted and joined in one go.
    bands_at_once: int = 5
    #: In how many goes pairs meet the shingles of their lines.
    pair_rounds: int = 3
    #: Bins (of two bits each) in which a pair may differ and still be compared.
    differing: int = 11
    #: 64-bit words of the parity bitmap that bounds how many shingles two lines share.
    words: int = 16
    #: Leaders of a bucket, each the first of its lines in an order of its own.
    leaders: int = 3
    #: Sets of such orders; buckets of one set and group mostly share their leaders.
    orders: int = 4
    #: Hashes per bin that a line's first pass looks at, on average.
    filling: int = 4
    similarity: float = 0.8
    min_chars: int = 20
    #: Whether exact repeats of shorter lines that hold a word go too.
    all_repeats: bool = False


#: Every line: one shorter than a shingle is its own only shingle, so no other line is similar to it.
WHOLE = LineConfig(min_chars=8, all_repeats=True)


def _counted(config: LineConfig) -> Column:
    """Whether a line's exact repeats go."""
    long = F.char_length("line") >= config.min_chars
    return long | F.col("line").rlike(r"[^\x20\x09-\x0D]") if config.all_repeats else long


def _positions(n: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))


def hashed(lines: DataFrame, config: LineConfig) -> DataFrame:
    """The rows of ``lines``, a line each, with the distinct shingle hashes in the place of ``line``.

    A line in UTF-32 has four bytes per character, which make the cut of a
    shingle independent of its place. Shingles become rows, since a function
    over an array is interpreted and costs several times as much for each.
    """
    keys = [c for c in lines.columns if c != "line"]
    wide = lines.select(*keys, F.encode("line", "UTF-32").alias("wide"))
    each = wide.select(*keys, "wide", F.explode(_positions((F.octet_length("wide") / 4).cast("int"), config.shingle)).alias("i"))
    each = each.select(*keys, F.xxhash64(F.substring("wide", F.col("i") * 4 + 1, F.lit(config.shingle * 4))).alias("h"))
    return each.groupBy(*keys).agg(F.collect_list("h").alias("all")).select(*keys, F.array_distinct("all").alias("shingles"))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line number and line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def lines_in(docs: DataFrame, pairs: DataFrame, config: LineConfig, text: str = "text") -> DataFrame:
    """line_id, the shingle hashes, worked out once, and whether it stands as a or as b, of every line in the pairs (a, b)."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("line_id"), F.lit(True).alias("is_a")), F.struct(F.col("b").alias("line_id"), F.lit(False).alias("is_a"))))
    ids = pairs.select(ends.alias("end")).groupBy(F.col("end.line_id").alias("line_id")).agg(
        F.bool_or("end.is_a").alias("is_a"), F.bool_or(~F.col("end.is_a")).alias("is_b"))
    return shingles_of(docs, ids, config, text)


def shingles_of(docs: DataFrame, ids: DataFrame, config: LineConfig, text: str = "text") -> DataFrame:
    """The rows of ``ids``, of one line_id each, with the shingle hashes of their lines; ``docs`` may be what ``texts_of`` gives."""
    known = docs.columns == ["line_id", "line"]
    found = docs.join(ids, "line_id") if known else _rows(docs, config, text).join(ids, "line_id").dropDuplicates(["line_id"])
    out = stored(hashed(found.select(*ids.columns, "line"), config), "lines")
    release_shuffles(docs.sparkSession)
    return out


def _rows(docs: DataFrame, config: LineConfig, text: str) -> DataFrame:
    """line_id and line of every line that is compared."""
    rows = docs.select(F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line")).where(F.char_length("line") >= config.min_chars)
    return rows.select(F.xxhash64("line").alias("line_id"), "line")


def texts_of(docs: DataFrame, ids: DataFrame, config: LineConfig, text: str = "text") -> DataFrame:
    """line_id and line of the distinct lines of ``ids``, so that the documents are read and shuffled once for all comparisons."""
    found = _rows(docs, config, text).join(ids, "line_id", "left_semi").dropDuplicates(["line_id"])
    return stored(found.select("line_id", "line"), "line_texts")


def leaders(value: str, config: LineConfig) -> Column:
    """``value`` of each of a bucket's leaders; no two lines of a bucket are equal in an order."""
    return F.array(*(F.min_by(value, F.xxhash64(F.lit(k), F.pmod("bucket", F.lit(config.orders)), "line_id")) for k in range(config.leaders)))


def parity(lines: DataFrame, config: LineConfig) -> DataFrame:
    """line_id, size and map: the number of shingles and the parity of those in each of 64 * words slots."""
    each = lines.select("line_id", F.size("shingles").alias("size"), F.explode("shingles").alias("h"))
    bit, word = F.expr("shiftleft(1L, cast(h & 63 as int))"), F.pmod(F.shiftright("h", 6), F.lit(config.words))
    own = each.select("line_id", "size", bit.alias("bit"), word.alias("word")).groupBy("line_id", "size").agg(
        *(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))).alias(f"w{k}") for k in range(config.words)))
    return own.select("line_id", "size", F.array(*(F.coalesce(f"w{k}", F.lit(0).cast("long")) for k in range(config.words))).alias("map"))


def may_be_similar(x: Column, y: Column, nx: Column, ny: Column, config: LineConfig) -> Column:
    """Whether sizes and parity bitmaps leave the threshold in reach; a slot that differs holds a shingle that one line lacks."""
    differ = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(config.words)), F.lit(0))
    most = (nx + ny) * F.lit((1 - config.similarity) / (1 + config.similarity))
    return (F.least(nx, ny) >= config.similarity * F.greatest(nx, ny)) & (differ <= most + F.lit(1e-6))


def _bin_minima(lines: DataFrame, config: LineConfig, bounded: bool) -> DataFrame:
    """line_id, n and the least hash of each bin (NULL for an empty one) of (line, n)."""
    wide = lines.select(F.xxhash64("line").alias("line_id"), "n", F.encode("line", "UTF-32").alias("wide"))
    each = wide.select("line_id", "n", "wide", F.explode(_positions(F.col("n"), config.shingle)).alias("i"))
    hashed = each.select("line_id", "n", "i", F.xxhash64(F.substring("wide", F.col("i") * 4 + 1, F.lit(config.shingle * 4))).alias("h"))
    if bounded:  # the first shingle is always there, so that every line has a row
        small = F.shiftrightunsigned("h", 33) * F.col("n") < F.lit(config.filling * config.bins << 31)
        hashed = hashed.where(small | (F.col("i") == 0))
    # bins by the whole hash, order by its 31 highest bits, which is all that a signature keeps
    hashed = hashed.select("line_id", "n", F.pmod("h", F.lit(config.bins)).cast("int").alias("bin"), F.shiftrightunsigned("h", 33).cast("int").alias("h"))
    return hashed.groupBy("line_id", "n").agg(*(F.min(F.when(F.col("bin") == k, F.col("h"))).alias(f"m{k}") for k in range(config.bins)))


def signatures(docs: DataFrame, config: LineConfig, text: str = "text") -> DataFrame:
    """line_id and sig, the values of all bins, of every distinct line.

    A line's shingles become rows that the aggregation folds where they arise,
    so equal lines meet as signatures and no text is shuffled. Least hashes are
    small: the first pass takes only hashes below a bound that leaves a few in
    each bin. A line that fills less than half of its bins so (it repeats few
    shingles) is done again without the bound.
    """
    lines = docs.select(F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line")).withColumn("n", F.char_length("line")).where(F.col("n") >= config.min_chars)
    mins = first = stored(_bin_minima(lines, config, True), "line_minima")
    release_shuffles(docs.sparkSession)
    filled = sum((F.col(f"m{k}").isNotNull().cast("int") for k in range(config.bins)), F.lit(0))
    weak = (F.col("n") > config.filling * config.bins) & (2 * filled < config.bins)
    ids = stored(mins.where(weak).select(F.col("line_id").alias("_id")), "line_weak")
    if not ids.isEmpty():  # else the join would shuffle all long lines to find none
        again = lines.where(F.col("n") > config.filling * config.bins)
        again = again.join(ids, F.xxhash64("line") == ids["_id"], "left_semi")
        mins = mins.where(~weak).unionByName(_bin_minima(again, config, False))
    # an empty bin takes the value of one of the next three, else the least of all
    near = [[F.col(f"m{(k + d) % config.bins}") for d in range(4)] for k in range(config.bins)]
    mins = mins.withColumn("low", F.least(*(F.col(f"m{k}") for k in range(config.bins))))
    sigs = stored(mins.select("line_id", F.array(*(F.coalesce(*cols, "low") for cols in near)).alias("sig")), "line_sigs")
    discard(first)
    release_shuffles(docs.sparkSession)
    return sigs


def buckets(sigs: DataFrame, config: LineConfig) -> list[DataFrame]:
    """bucket, line_id, code: one row per line and band, buckets of one line left out, in tables of some bands each.

    ``code`` keeps two bits of every bin. Bands are taken a few at a time, so
    that only their share of the rows is in shuffles at once.
    """
    bits = (F.shiftleft(F.col("sig")[k].bitwiseAND(F.lit(3)).cast("long"), 2 * k) for k in range(config.bins))
    code = reduce(lambda x, y: x.bitwiseOR(y), bits)
    hashes = [F.xxhash64(F.lit(i), *(F.col("sig")[k] for k in band)) for i, band in enumerate(config.bands)]
    parts = []
    for first in range(0, len(hashes), config.bands_at_once):
        some = F.array(*hashes[first:first + config.bands_at_once])
        # a line has one row per bucket, so what is counted is lines
        shared = sigs.select(F.explode(some).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
        rows = sigs.select("line_id", code.alias("code"), F.explode(some).alias("bucket"))
        parts.append(stored(rows.join(shared, "bucket"), "line_shared"))
        release_shuffles(sigs.sparkSession)
    return parts


def alike(a: Column, b: Column, config: LineConfig) -> Column:
    """Whether few enough bins differ in the codes for a comparison to be due."""
    x = a.bitwiseXOR(b)
    ones = F.lit(sum(1 << 2 * k for k in range(config.bins))).cast("long")
    any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones)
    return F.bit_count(any_bit) <= config.differing


def similar(pairs: DataFrame, lines: DataFrame, config: LineConfig) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold.

    ``lines`` holds the lines themselves (``texts_of``) or has their shingles
    already (``lines_in``). Pairs are few bytes and much work, so they are spread over all shuffle
    partitions first; those of too different sizes are not intersected. They are
    taken in a few rounds by their first line, so that only a share of the
    shingles is on disk at once, many times the size of the lines: a round hashes
    the lines of its own pairs, and they go with it. The measures are
    written before the filter, which would otherwise be pushed down and have
    them evaluated several times.
    """
    spark = pairs.sparkSession
    parts = []
    for k in range(config.pair_rounds):
        own = F.pmod(F.xxhash64("a"), F.lit(config.pair_rounds)) == k
        some = pairs.where(own)
        held = lines if "shingles" in lines.columns else lines_in(lines, some, config)
        a = held.where("is_a").select(F.col("line_id").alias("a"), F.col("shingles").alias("x"))
        b = held.where("is_b").select(F.col("line_id").alias("b"), F.col("shingles").alias("y"))
        some = some.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        both = some.join(a.where(own), "a").join(b, "b").where(F.least(F.size("x"), F.size("y")) >= config.similarity * F.greatest(F.size("x"), F.size("y")))
        parts.append(stored(both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t")), "line_measures"))
        if held is not lines:
            discard(held)
        release_shuffles(spark)
    links = stored(reduce(DataFrame.union, parts).where(F.col("i") >= config.similarity * (F.col("t") - F.col("i"))).select("a", "b"), "line_links")
    for done in parts:
        discard(done)
    return links


def line_components(docs: DataFrame, config: LineConfig = LineConfig(), text: str = "text") -> DataFrame:
    """(id, comp) of every line that is linked with another one."""
    spark = docs.sparkSession
    sigs = signatures(docs, config, text)
    parts = buckets(sigs, config)
    discard(sigs)
    member = reduce(DataFrame.union, parts)
    lead = member.groupBy("bucket").agg(F.arrays_zip(leaders("line_id", config).alias("id"), leaders("code", config).alias("code")).alias("leads"))
    star = member.join(lead, "bucket").select("line_id", "code", F.explode(F.array_distinct("leads")).alias("lead"))
    star = star.select("line_id", "code", F.col("lead.id").alias("lead"), F.col("lead.code").alias("lead_code"))
    star = star.where("line_id <> lead").where(alike(F.col("code"), F.col("lead_code"), config))
    star = stored(star.select(F.least("lead", "line_id").alias("a"), F.greatest("lead", "line_id").alias("b")).distinct(), "line_star")
    release_shuffles(spark)
    texts = texts_of(docs, member.select("line_id").distinct(), config, text)
    release_shuffles(spark)
    first = similar(star, texts, config)
    discard(star)
    release_shuffles(spark)
    comps = stored(connected_components(first), "line_comps")
    member = member.join(comps.withColumnRenamed("id", "line_id"), "line_id", "left").withColumn("comp", F.coalesce("comp", "line_id"))
    lead = member.groupBy("bucket").agg(
        leaders("line_id", config).alias("leads"), leaders("comp", config)[0].alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    member = stored(member.join(lead.select("bucket", "lead", "leads"), "bucket"), "line_members")
    for done in (*parts, comps):
        discard(done)
    release_shuffles(spark)
    # a line is in one bucket per band at most
    ids = member.groupBy("line_id").agg(F.sort_array(F.collect_set("bucket")).alias("all"))
    lines = shingles_of(texts, ids.select("line_id"), config)
    maps = stored(parity(lines, config).join(ids, "line_id"), "line_maps")
    discard(lines)
    release_shuffles(spark)
    mapped = full = stored(member.join(maps, "line_id"), "line_mapped")
    discard(member)
    discard(maps)
    release_shuffles(spark)
    held = ("line_id", "comp", "code", "size", "map", "all")
    full = full.where(~F.array_contains("leads", F.col("line_id")))  # those have met all others
    x = full.where("comp <> lead").select("bucket", "lead", *(F.col(c).alias(f"x_{c}") for c in held))
    y = full.select("bucket", *(F.col(c).alias(f"y_{c}") for c in held))
    # one way round where both lines stand on both sides, and in the first bucket that both are in
    pairs = x.join(y, "bucket").where("x_comp <> y_comp and (x_line_id < y_line_id or y_comp = lead)").where(
        alike(F.col("x_code"), F.col("y_code"), config)).where(
        may_be_similar(F.col("x_map"), F.col("y_map"), F.col("x_size"), F.col("y_size"), config)).where(
        F.element_at(F.array_intersect("x_all", "y_all"), 1) == F.col("bucket"))
    pairs = stored(pairs.select(F.least("x_line_id", "y_line_id").alias("a"), F.greatest("x_line_id", "y_line_id").alias("b")).distinct(), "line_pairs")
    discard(mapped)
    release_shuffles(spark)
    second = similar(pairs, texts, config)
    for done in (pairs, texts):
        discard(done)
    release_shuffles(spark)
    found = connected_components(first.union(second))
    discard(first)
    discard(second)
    return found


def placed_lines(docs: DataFrame, config: LineConfig = LineConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """line_id, comp and the first place (doc_id, line number) of every component with more than one occurrence."""
    comps = stored(line_components(docs, config, text), "line_final").withColumnRenamed("id", "line_id")
    # occurrences are counted per distinct line before anything meets by component
    lines = lines_of(docs, id_col, text).where(_counted(config))
    seen = lines.groupBy(F.xxhash64("line").alias("line_id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_no")).alias("at"))
    seen = seen.join(comps, "line_id", "left").where("comp is not null or n > 1").withColumn("comp", F.coalesce("comp", "line_id"))
    seen = stored(seen, "line_seen")
    first = seen.groupBy("comp").agg(F.min("at").alias("first"))
    return seen.select("line_id", "comp").join(first, "comp").select("line_id", "comp", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def dropped_lines(docs: DataFrame, config: LineConfig = LineConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line_id, comp of every line that goes."""
    placed = placed_lines(docs, config, id_col, text)
    lines = lines_of(docs, id_col, text).where(_counted(config)).select("doc_id", "line_no", F.xxhash64("line").alias("line_id"))
    hit = lines.join(placed, "line_id")
    return hit.where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")))).select("doc_id", "line_no", "line_id", "comp")


def dedup_lines(docs: DataFrame, config: LineConfig = LineConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all but one line of each component taken out of the text."""
    gone = dropped_lines(docs, config, id_col, text)
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.xxhash64("line_no", "line_id")).alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]), "left")
    keep = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", F.xxhash64(i, F.xxhash64(x))))
    new = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))
    return out.withColumn(text, new).select(*docs.columns)
