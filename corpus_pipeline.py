"""The corpus pipeline: raw documents to token ids of a deduplicated, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All stages but the last
return the columns of ``documents``, whatever else they are called.

Defined cases, for every stage: a null text is an empty one; an empty table gives an
empty one; texts of any length are worked on whole; extra columns stay as they are.
What is special about a stage is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hedgerow.llm import mixing, ngram_join, quality_pu, queries, sp_codec, suffix_dedup
from hedgerow.llm.common import keep, table

#: Share of the surviving tokens that the mixture takes, each document once at most.
MIX_SHARE = 0.9


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows with equal texts share their fate, without trusted positives all stay."""
    return quality_pu.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the smallest id, a null id last; texts without words all stay."""
    return ngram_join.drop_near_duplicates(docs)


def passage_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first, by id; one of some rows with the same id and text stays."""
    return suffix_dedup.drop_repeated_passages(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by the weights of the domain, language and source tree; rows with the same id and text together or not at all."""
    return mixing.mix(docs, queries.mixture_levels(), queries.MIXTURE, share=MIX_SHARE, epochs=1, seed=9)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document that is left, one row for each row."""
    return sp_codec.encode(docs, queries.vocabulary(queries.PIECES))


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("suffix_array_dedup", passage_filter),
    ("source_mixing", source_mixture),
    ("sentencepiece_encoding", token_ids),
]

#: The classifier can't be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
