"""Quality rules, near-duplicate removal, mixing and encoding of a corpus, each stage written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayflow.llm import bpe, jaccard, mixing, quality
from swayflow.llm.common import Scratch, load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all rules; null and empty texts keep none. Repeated rows are judged alike, each stays."""
    judged = quality.judged(docs.select(*COLUMNS))
    # A filter on `kept` itself would be pushed below the counts and repeat their expressions without end; one on a generated column stays above them.
    return judged.select(*COLUMNS, F.explode_outer(F.when(F.col("kept"), F.array(F.lit(1)))).alias("_k")).where("_k IS NOT NULL").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id (null last); texts that share an id are told apart, of rows that repeat id and text one stays.

    Documents without words are near copies of none but rows that repeat them.
    """
    scratch = Scratch(spark, "near")
    kept = scratch.save("kept", jaccard.linked(docs).where("first").groupBy(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).agg(F.count("*").alias("_n")))
    found = docs.select(*COLUMNS, F.xxhash64("text").alias("_text")).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_place")))
    return found.where("_n = 1").select(*COLUMNS).unionByName(found.where("_n > 1").dropDuplicates(["_id", "_place"]).select(*COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix asks for; rows with equal ids and texts are rated alike."""
    scratch = Scratch(spark, "mixed")
    rated = mixing.mixed(docs, load(spark, sf_dir, "labels")).groupBy(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).agg(F.max("copies").alias("_copies"))
    rated = scratch.save("rated", rated.where("_copies > 0"))
    out = docs.select(*COLUMNS, F.xxhash64("text").alias("_text")).join(rated, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_place")))
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), "_copies"))).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left, a row for each."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", mixed_sources),
    ("bpe_encoding", bpe_tokens),
]

#: Classifier, gradient steps and tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again as the next one's documents.

    Columns of documents beyond COLUMNS are not looked at. An empty table gives none.
    """
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(f"{k}-{name}", docs)
    return docs
