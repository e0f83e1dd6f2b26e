"""Pages of a sorted log that read only the files they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file of the sorted log, about.
FILE_ROWS = 100_000


def write_sorted_log(history: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """The log in ranges of time and id, a file each, beside a directory of their rows and bounds."""
    spark, n = history.sparkSession, max(1, -(-history.count() // file_rows))
    history.repartitionByRange(n, "created_at", "id").sortWithinPartitions("created_at", "id").write.parquet(f"{path}/log")
    rows = spark.read.parquet(f"{path}/log").select("created_at", "id", F.input_file_name().alias("file"))
    bounds = rows.groupBy("file").agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("first"), F.max(F.struct("created_at", "id")).alias("last"))
    bounds.coalesce(1).write.parquet(f"{path}/directory")


def page_files(spark: SparkSession, path: str, limit: int = 100, offset: int = 0, order: str = "DESC") -> tuple[list[str], int]:
    """The files that hold the rows from ``offset`` on, and how many rows of them come before.

    The directory has a row per file; only the files of the page come to the driver.
    """
    if order.upper() not in ("ASC", "DESC"):
        raise ValueError("order must be ASC or DESC")
    way = F.desc if order.upper() == "DESC" else F.asc
    before = Window.orderBy(way("first")).rowsBetween(Window.unboundedPreceding, -1)
    placed = spark.read.parquet(f"{path}/directory").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("before").select("file", "before").collect()
    return [r.file for r in held], offset - held[0].before if held else 0


def seek_page(spark: SparkSession, path: str, limit: int = 100, offset: int = 0, order: str = "DESC") -> DataFrame:
    """A page of ``write_sorted_log`` by time and id: the same rows as sorting and skipping the whole log gives."""
    files, skip = page_files(spark, path, limit, offset, order)
    way = F.desc if order.upper() == "DESC" else F.asc
    if not files:
        return spark.read.parquet(f"{path}/log").limit(0)
    return spark.read.parquet(*files).orderBy(way("created_at"), way("id")).offset(skip).limit(limit)
