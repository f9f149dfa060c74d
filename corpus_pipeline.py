"""The corpus pipeline: language ID, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm import exact_dedup as exact
from sparkweft.llm import language_id, near_texts, packing
from sparkweft.llm.common import id_crc, materialise, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts and texts
    without letters. The model learns from the labelled rows of four of five folds."""
    model = language_id.learn(docs.where(id_crc("doc_id") % 5 != 0))
    return language_id.keep_identified(docs, model)


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact.exact_dedup(docs)


def drop_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints under the segment-count grid give candidates, compared by five-word shingles: of each
    group of texts linked at Jaccard 0.8 the document with the smallest doc_id stays."""
    return near_texts.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", keep_identified), ("exact_dedup", drop_equal_texts), ("near_dedup", drop_near_texts), ("packing", pack)]

#: Neither the trained model nor the tokenizer can be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
