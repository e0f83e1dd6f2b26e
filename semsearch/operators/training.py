"""Training examples from the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import word_tokens


def training_kpis(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: examples, estimated tokens, their mean, cost."""
    tokens = word_tokens(F.coalesce("query", F.lit("")), config.tokens_per_word) + word_tokens(F.coalesce("response", F.lit("")), config.tokens_per_word)
    total = F.coalesce(F.sum(tokens), F.lit(0))
    return pairs.agg(
        F.count("*").alias("examples"), total.cast("long").alias("tokens"), F.coalesce(F.round(F.try_divide(total, F.count("*")), 0), F.lit(0.0)).alias("mean_tokens"),
        F.round(total / 1000 * config.cost_per_1000_tokens, 2).alias("cost"),
    )


def fine_tuning_examples(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """id, value: a JSON line of system, user and assistant messages for every pair with positive feedback."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(message("system", F.lit(config.system_prompt)), message("user", F.col("query")), message("assistant", F.col("response")))
    return pairs.where(F.col("feedback") == 1).select("id", F.to_json(F.struct(messages.alias("messages"))).alias("value"))
