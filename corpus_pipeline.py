"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. Texts that a stage
changes get their ``n_chars`` anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.functions.exprs import staged
from ledgerlark.llm import line_dedup, ngram_join, packing, quality_rules, secrets
from ledgerlark.llm.components import stored

POLICY = "v2"
NEAR = ngram_join.JoinConfig(width=5, num=80, den=100)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go.

    The verdict is a generator's output: a filter is not pushed below that, where
    it would have the measurements evaluated again and again.
    """
    ledger = quality_rules.ledger(docs)
    judged = staged(ledger, [c for c in ledger.columns if c != "fail_bits"], {"fail_bits": F.col("fail_bits")})
    return judged.where(quality_rules.passes(POLICY)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays in the whole corpus; every document stays."""
    return _counted(line_dedup.dedup_lines(docs, line_dedup.WHOLE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays: the one with the least id, a NULL id coming last.

    Rows are told apart by a number of their own, so rows that share an id, or
    have none, are judged each by its text. Documents without a word, as line
    dedup leaves them of a text whose lines all stand elsewhere, are copies of
    each other and one group.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near_rows")
    classes = ngram_join.classes(rows, NEAR, id_col=row)
    group = F.when(F.col("n_shingles") == 0, F.lit(-1)).otherwise(F.col("component_id"))
    placed = classes.select(F.col("doc_id").alias("_of"), group.alias("_group"))
    ids = rows.select(F.col(row).alias("_of"), F.col("doc_id").alias("_id"))
    first = placed.join(ids, "_of").groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_of")).alias("_first"))
    kept = first.select(F.col("_first._of").alias("_of"))
    return rows.join(kept, rows[row] == kept["_of"], "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are masked in the texts; every document stays."""
    return _counted(secrets.redact(docs, secrets.train(docs))).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placements of all documents in sequences."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), quality_rules.WORD_GAP), "")
    rows = docs.select("doc_id", "source", words.alias("_words")).select(
        "doc_id", "source", F.size("_words").cast("long").alias("size"), F.xxhash64(F.lower(F.array_join("_words", " "))).alias("cluster"))
    return packing.pack(rows, "size", "source", "cluster")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit),
]

#: Fuzzy line classes, model scores and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
