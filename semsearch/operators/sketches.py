"""Statistics per day that can be merged over any range: counts, and sketches of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the registers of a sketch: a standard error of about 1.6 %.
PRECISION = 12


def daily_stats(history: DataFrame) -> DataFrame:
    """day, collection, searches, with sketches of users and query texts; a search counts in each of its collections."""
    rows = history.select(F.to_date("created_at").alias("day"), F.explode("collections_used").alias("collection"), "user_id", "query")
    sketch = lambda c: F.hll_sketch_agg(c, PRECISION).alias(f"{c}_sketch")
    return rows.groupBy("day", "collection").agg(F.count("*").alias("searches"), sketch("user_id"), sketch("query"))


def put_days(daily: DataFrame, path: str) -> None:
    """Write days, a folder each, in the place of what these days had before; other days stay untouched."""
    daily.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("day date, collection string, searches long, user_id_sketch binary, query_sketch binary").parquet(path)


def merged_stats(daily: DataFrame, start: str, end: str) -> DataFrame:
    """collection, searches (exact), and estimates of distinct users and query texts over the days, both included; only sketches are read."""
    inside = daily.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch"))
    return inside.groupBy("collection").agg(F.sum("searches").alias("searches"), estimate("user_id").alias("users"), estimate("query").alias("queries"))
