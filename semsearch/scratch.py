"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that is unset and everything runs on this machine, a folder of our own
    takes its place; on a cluster other machines would not see it, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def range_splits(df: DataFrame, order: str, n: int) -> list[float]:
    """Bounds of about ``n`` ranges of the number ``order`` (two at least) with about as many rows each."""
    cuts = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("c")).first().c or []
    return [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]


def in_ranges(df: DataFrame, order: str, splits: list[float], out: str) -> DataFrame:
    """Number the ranges of ``order`` from 0; nulls are in the last one."""
    placed = df.withColumn("_order", F.coalesce(F.col(order).cast("double"), F.lit(float("inf"))))
    return Bucketizer(splits=splits, inputCol="_order", outputCol=out).transform(placed).drop("_order")


def numbered_in_order(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Number the rows of each ``key`` from 1 by the number ``order``.

    Rows are dealt over ranges of ``order``, so a key with most of the rows is
    numbered by many tasks; rows of the ranges before come from a table of one row
    per key and range.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = in_ranges(df, order, range_splits(df, order, n), "_range")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    joined = ranked.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_in")))
    return joined.withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_key", "_in", "_before", "_rank", "_range")
