"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ann, bpe_automaton, centroids, divergence, html_extract, lang_id, line_dedup, ngram_join, packing, quality_rules, secrets, substring_dedup,
               wavelet)
from .components import stored

WORD_BPE, WORD_BPE_BITS, END_ID = "word_bpe_49k.json", 16, 2
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_CTE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i+4], chr(10)) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest(range(5)) AS k)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i-1])) AS BIGINT) AS n_doubled_words,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id)
"""
FAILS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality_rules.RULES))
OP4_SQL = QUALITY_CTE + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits AS fail_bits
FROM (SELECT *, CAST({FAILS} AS BIGINT) AS bits FROM m)
"""


@query("op4_quality_rules", OP4_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask_of(quality_rules.BASE_RULES))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), quality_rules.passes("v2").alias("kept"), "fail_bits")


@query("op6_wavelet_shards")
def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.encode_shards(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), END_ID, WORD_BPE_BITS)
    return wavelet.read_documents(stored(shards, "op6"))


@query("op8_bpe_automaton")
def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.train(docs))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = lang_id.train(docs, tokenizer(PIECES), labelled=~held_out)
    return lang_id.predict(docs, model, tokenizer(PIECES)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def packable(docs: DataFrame) -> DataFrame:
    """Words as token counts; equal texts but for case and white space are one cluster."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), quality_rules.WORD_GAP), "")
    return docs.select("doc_id", "source", words.alias("_words")).select(
        "doc_id", "source", F.size("_words").cast("long").alias("size"), F.xxhash64(F.array_join("_words", " ")).alias("cluster"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packable(docs), "size", "source", "cluster")


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), ngram_join.JoinConfig(width=4, num=85, den=100))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, line_dedup.WHOLE)
    return kept.select(
        "doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines_kept"), F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op10_nn_descent")
def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
tok AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS cq FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 30),
voc AS MATERIALIZED (SELECT lang, count(*) AS v, sum(cq) AS nq FROM kept GROUP BY lang),
grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
cnt AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (cq + 5)) // (nq + 5 * v) AS BIGINT) AS q
  FROM tot JOIN voc USING (lang) JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
vals AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS f
             FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
    ON z.lang = a.lang AND z.s = a.source AND z.o = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM dense WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM vals)
WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as one more table of assignments and one of centroids."""
    ctes = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c FROM (
    SELECT x, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM kept) ORDER BY h, x LIMIT {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, best.cluster AS cluster, best.distance AS distance FROM (
    SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'distance': d, 'cluster': cluster}}) AS best FROM (
      SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM kept, c{i})
    GROUP BY r)),
s{i} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
    SELECT cluster, j, sum(v) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS j, unnest(x) AS v FROM a{i}) GROUP BY cluster, j)
  GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))""")
    return f"""WITH {",".join(ctes)}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


@query("op12_centroid_clustering", lloyd_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(centroids.cluster(table(spark, sf_dir, "embeddings")))


OP13_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS MATERIALIZED (
  SELECT r, doc_id, i, array_to_string(words[i:i+12], ' ') AS g
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13 AND doc_id IS NOT NULL)),
gone AS MATERIALIZED (
  SELECT r, list_distinct(flatten(list(range(i, i + 13)))) AS spots
  FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id GROUP BY r),
kept AS (
  SELECT w.r, doc_id, len(words) AS n, coalesce(len(spots), 0) AS n_gone FROM w LEFT JOIN gone ON w.r = gone.r),
left_over AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM (
    SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w)
  ANTI JOIN (SELECT r, unnest(spots) AS i FROM gone) USING (r, i) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN left_over ON kept.r = left_over.r
"""


@query("op13_substring_dedup", OP13_SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)
