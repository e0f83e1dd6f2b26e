"""A corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read as the next stage's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsearch.llm import mixing, neardup, pack, quality
from semsearch.llm.common import stored
from semsearch.llm.queries import MIXING_WEIGHTS, mixing_levels

#: Percent of all tokens that the mixture takes, each document at most once.
MIXTURE_PERCENT = 90


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that many documents of their source share.

    Null, empty and blank texts go, as they have too few words; repeated rows go or stay
    alike; rows without an id or source are judged as others; an empty table stays empty.
    """
    kept = quality.kept_documents(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, or any one if none has an id.

    Of repeated rows one stays.  Texts without a word are in no group and all stay.
    """
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, each at most once.

    A null language or source is the value ``''``; texts without words go with what
    precedes them in their leaf's order; repeated rows are taken or left together.
    """
    return mixing.mixed_documents(docs, mixing_levels(), MIXING_WEIGHTS, MIXTURE_PERCENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids.

    A null or empty text is a single end; repeated rows are packed as often as they
    occur; only texts longer than a sequence are cut.
    """
    return pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_pieces=False)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", ngram_jaccard_join), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: SQL can express neither the token ids nor the packing; the tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
