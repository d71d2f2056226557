"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, jaccard, lm, mixing, mtree, quality, shards, urls, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    shards.op1_sharding, bpe.op2_bpe, mtree.op3_exact_top_k, chat.op4_chat, jaccard.op5_ngram_jaccard_join,
    urls.op6_url_filters, lm.op7_lm_scoring, warc.op8_warc, mixing.op9_mixing, quality.op10_quality_rules, pipeline,
)}

ORACLES = {
    "op4_chat": chat.SQL,
    "op3_exact_top_k": mtree.SQL, "op5_ngram_jaccard_join": jaccard.SQL, "op6_url_filters": urls.SQL,
    "op8_warc": warc.SQL, "op10_quality_rules": quality.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
