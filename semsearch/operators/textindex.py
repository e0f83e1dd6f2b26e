"""Parts of texts found through trigrams: an inverted index of the search log, whose hits are then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import search_history

#: Folders that grams are dealt over by hash.
BUCKETS = 64


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text; none of a shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3)))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_text_index(history: DataFrame, path: str) -> None:
    """The log in a folder per day, and which days and ids hold each trigram of query or response.

    A gram of a day is one row with its ids in order, so what a gram in a third of
    all texts takes is spread over the days.
    """
    dated = history.withColumn("created_date", F.to_date("created_at"))
    dated.write.partitionBy("created_date").parquet(f"{path}/log")
    grams = dated.select("created_date", "id", F.explode(F.array_union(trigrams(F.col("query")), trigrams(F.col("response")))).alias("gram"))
    lists = grams.groupBy("gram", "created_date").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("bucket", _bucket(F.col("gram")))
    lists.repartition("bucket", "created_date").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """created_date, id of the rows that hold all trigrams of ``part``; None if it is too short to have one."""
    grams = [r.g for r in spark.range(1).select(F.explode(trigrams(F.lit(part))).alias("g")).collect()]
    if not grams:
        return None
    buckets = [r.b for r in spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g")).select(_bucket(F.col("g")).alias("b")).distinct().collect()]
    lists = spark.read.parquet(f"{path}/grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    held = lists.select("created_date", F.explode("ids").alias("id")).groupBy("created_date", "id").agg(F.count("*").alias("n"))
    return held.where(F.col("n") == len(grams)).drop("n")


def indexed_search(spark: SparkSession, path: str, part: str, **conditions) -> DataFrame:
    """``search_history`` of the log under ``path`` for a part of query or response, in any case.

    Only the folders of days with candidates are read, and of these only the
    candidates are verified.  A part of fewer than three characters scans the log.
    """
    log, found = spark.read.parquet(f"{path}/log"), candidates(spark, path, part)
    if found is None:
        return search_history(log, search=part, **conditions)
    days = [r.created_date for r in found.select("created_date").distinct().collect()]  # at most the days of the log
    return search_history(log.where(F.col("created_date").isin(days)).join(found, ["created_date", "id"], "left_semi"), search=part, **conditions)
