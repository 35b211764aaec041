"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cobucket, langid, lattice_lm, line_rules, mixing, ngram_join, quality_pu, sp_codec, suffix_dedup, token_count, train_order, whitening
from .common import table

#: Names of the public tokenizer files.
BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("repeated").cast("long").alias("n_spans"),
        suffix_dedup.span_words("repeated").alias("repeated_words"),
        suffix_dedup.span_words("removed").alias("removed_words"),
    )


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the training order, written to a new shared folder; each record is given by its place and checksum there."""
    folder = cobucket.new_folder(spark, "training-order")
    return train_order.write_training_order(table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS), folder, key=20240229, pad=50256, listed=True)


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(table(spark, sf_dir, "documents"), vocabulary(PIECES))


#: The mixture: domains stand for groups of sources; unlisted names get the default.
DOMAINS = ["web", "books", "news", "code"]
MIXTURE = mixing.Weights([{"web": 0.4, "books": 0.25, "news": 0.25, "code": 0.1}, {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, {}], default=0.05)


def mixture_levels() -> list:
    """Domain (by the number in the source's name), language and source."""
    number = F.coalesce(F.regexp_extract("source", r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return [F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))) + 1), F.col("lang"), F.col("source")]


def op9_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of 80 % of the tokens at hand, small leaves up to twice."""
    found = mixing.mixture(table(spark, sf_dir, "documents"), mixture_levels(), MIXTURE, share=0.8, epochs=2, seed=9)
    return found.select("doc_id", "epoch", "n_tokens", F.col("level_0").alias("domain"), F.col("level_1").alias("lang"), F.col("level_2").alias("source"))


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


#: Buckets of the shop's sales.
SALE_BUCKETS = 300


def op11_late_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and their lines, from files by sale (some with two buckets) and by item, in common buckets."""
    sales, lines = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines")
    bucket = lambda key: F.crc32(F.concat(F.lit("line"), key.cast("string")).cast("binary")) % SALE_BUCKETS
    b = F.coalesce(bucket(F.col("sale_id")), F.lit(SALE_BUCKETS + 1))
    starts = {
        "sales": F.when(b % 3 == 1, b - 1).otherwise(b),
        "sale_lines": F.coalesce(F.crc32(F.col("item_id").cast("string").cast("binary")) % SALE_BUCKETS, F.lit(0)),
    }
    return cobucket.co_bucket(sales, lines, "sale_id", bucket, SALE_BUCKETS, starts, cobucket.new_folder(spark))


def op12_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary(PIECES), "rb") as f:
        return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), f.read())


def op13_gramian_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_suffix_array": op2_suffix_array,
    "op3_string_kernel": op3_string_kernel,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_pu_quality": op5_pu_quality,
    "op6_whole_token_counts": op6_whole_token_counts,
    "op7_training_order": op7_training_order,
    "op8_sentencepiece_codec": op8_sentencepiece_codec,
    "op9_hierarchical_mix": op9_hierarchical_mix,
    "op10_line_frequency": op10_line_frequency,
    "op11_late_materialisation": op11_late_materialisation,
    "op12_subword_lattice": op12_subword_lattice,
    "op13_gramian_whitening": op13_gramian_whitening,
}

ORACLES: dict[str, str] = {
    "op2_suffix_array": suffix_dedup.ORACLE,
    "op4_ngram_jaccard": ngram_join.ORACLE,
    "op10_line_frequency": line_rules.ORACLE,
}
