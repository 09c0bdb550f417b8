"""From raw documents to token ids, in five stages.

Each stage takes all that the one before kept and returns the columns of documents; the last returns token ids. A stage
gets its documents as a written table, so what it computes from them more than once costs one read each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from sievework.llm.scratch import Scratch, workers_import
from sievework.operators.rows import with_row_id

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; the lexicon is learned from these documents' labels."""
    workers_import(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, model, TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest identifier."""
    workers_import(spark)
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more: that with the smallest identifier, of these the first row.

    Rows are told apart by their numbers, so documents that share an identifier are documents of their own.
    """
    workers_import(spark)
    rows = with_row_id(docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row")), "number")
    own = F.struct(F.col(f"row.c{docs.columns.index('doc_id')}").alias("doc_id"), "number")
    groups = ngram_join.similar_groups(rows.select(own.alias("own"), F.col(f"row.c{docs.columns.index('text')}").alias("text")), id_col="own", words=5, low=80)
    stays = groups.filter(F.col("own").eqNullSafe(F.col("component_id"))).select(F.col("own.number").alias("stays"))
    kept = rows.join(stays, F.col("number") == F.col("stays"), "left_semi")
    return kept.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times or not at all."""
    workers_import(spark)
    return mixing.take(docs, mixing.mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, repeats included."""
    workers_import(spark)
    return bpe.encode(docs, bpe.default_vocabulary()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

ORACLE_SQL = None  # the stages learn, draw by hash and tokenize; a test compares with a plain computation


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
