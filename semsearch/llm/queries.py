"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, lines, lm, mixing, neardup, pack, quality, rank, repair, shard, urls, vafile, whiten
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a model of those outside the held-out fold."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as Re-Pair shards and digest what the files give back."""
    path = scratch_path(spark, "repair-shards")
    repair.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.col("ids")
    return repair.read_shards(spark, path, without_id=True).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents and digest the ids of each piece."""
    packed = pack.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal all documents over 16 shards."""
    return shard.shard_documents(table(spark, sf_dir, "documents"))


#: Entries of the allow and block lists.
URL_LISTS = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all page URLs; a page is labelled bad if its label is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_LISTS, labels)


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents; the source is the host."""
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op3_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for every 50th vector among all others."""
    vectors = vafile.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vafile.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op6_maximum_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract.extract_text(table(spark, sf_dir, "pages"))


def mixing_levels() -> dict:
    """Domain (a number from the source's), language and source."""
    number = F.coalesce(F.regexp_extract(F.col("source"), "([0-9]+)$", 1), F.lit(""))
    return {"domain": F.concat(F.lit("d"), (F.coalesce(number.try_cast("long"), F.lit(0)) % 3).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


#: Weights of nodes by level; all others weigh 1.
MIXING_WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op8_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix 60 % of all tokens from domains, languages and sources, with at most two epochs of a leaf."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing_levels(), MIXING_WEIGHTS, 60, max_epochs=2)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies", "epoch")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whiten all embeddings onto the four components of most variance."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"), 4)


def op12_stratified_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return rank.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the lines that three documents or more share from all but the last of them."""
    return lines.line_digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_brown_bigrams": op1_brown_bigrams,
        "op2_repair_tokens": op2_repair_tokens,
        "op4_lpt_sharding": op4_lpt_sharding,
        "op10_url_rules": op10_url_rules,
        "op7_line_frequency": op7_line_frequency,
        "op3_vector_approximation": op3_vector_approximation,
        "op6_maximum_subsequence": op6_maximum_subsequence,
        "op8_hierarchical_budgets": op8_hierarchical_budgets,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op5_sum_of_squares_packing": op5_sum_of_squares_packing,
        "op11_cholesky_whitening": op11_cholesky_whitening,
        "op12_stratified_ranking": op12_stratified_ranking,
        "op13_line_runs": op13_line_runs,
    }
