"""From raw documents to token ids: each stage reads what its predecessor wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import byte_bpe, cotrain, exact_dedup, jaccard, mixture
from panelcast.llm.common import without
from panelcast.session import stage
from panelcast.sources.tables import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = cotrain.score(docs, read_table(spark, sf_dir, "labels"), prefix="__quality_")
    return scored.where("__quality_keep").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    found = jaccard.link_components(docs)
    gone = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "near_copies")
    return without(docs, gone, ["doc_id"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with sources at their target weights; repeated epochs repeat rows."""
    return mixture.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the length of the text they decode to."""
    tokens = byte_bpe.read_ranks(TOKENIZER)
    rows = byte_bpe.encode(docs, tokens, public_tokenizers.PATTERN, ids="ids")
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", good),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixture", mixed),
    ("encode", encoded),
]

#: Classifier, links and merges have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
