"""Readers of catalogue pages, item pages, field definitions and the application log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import last_of_each, log_level

COLLECTIONS = "id long, name string, description string, url string, items_count long"
ITEM_PAGE = "items array<struct<id: long, title: string, description: string, url: string, metadata: array<struct<name: string, value_as_string: string>>>>"
METADATA_DEFS = "id long, name string, metadata_type string, description string"


def _defaults(df: DataFrame) -> DataFrame:
    """Missing numbers are 0 and missing texts empty."""
    return df.select(*(F.coalesce(c, F.lit("" if t == "string" else 0)).cast(t).alias(c) for c, t in df.dtypes))


def read_collections(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The catalogue from JSON files, each an array of collections, or with ``lines`` one collection a line."""
    return _defaults(spark.read.schema(COLLECTIONS).option("multiLine", not lines).json(path))


def get_collection(collections: DataFrame, collection_id: int) -> DataFrame:
    """The collection's row; none if it is unknown."""
    return collections.where(F.col("id") == collection_id)


def metadata_map(entries):
    """A map of name to value; entries without either go, the last of equal names stays."""
    named = F.filter(entries, lambda e: e["name"].isNotNull() & e["value_as_string"].isNotNull())
    return F.coalesce(last_of_each(F.transform(named, lambda e: F.struct(e["name"].alias("key"), e["value_as_string"].alias("value")))), F.create_map().cast("map<string,string>"))


def read_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items from JSON files under ``collection_id=<id>`` folders, each a page, or with ``lines`` one page a line."""
    pages = spark.read.schema(ITEM_PAGE + ", collection_id long").option("multiLine", not lines).option("basePath", path).json(path)
    return flat_items(pages)


def flat_items(pages: DataFrame) -> DataFrame:
    """One row per item of pages (collection_id, items)."""
    items = pages.select("collection_id", F.explode("items").alias("i"))
    text = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit(""))
    return items.select(
        F.coalesce("i.id", F.lit(0)).cast("long").alias("item_id"), "collection_id", text("title").alias("title"), text("description").alias("description"),
        metadata_map(F.col("i.metadata")).alias("metadata"), text("url").alias("url"),
    )


def read_metadata_defs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Field definitions under ``collection_id=<id>`` folders, arrays or one a line; the last file's of equal ids stays."""
    raw = spark.read.schema(METADATA_DEFS + ", collection_id long").option("multiLine", not lines).option("basePath", path).json(path)
    raw = raw.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    last = Window.partitionBy("collection_id", "id").orderBy(F.desc("_at"))
    return _defaults(raw.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_at").withColumnRenamed("metadata_type", "type"))


def read_app_log(spark: SparkSession, path: str, tag: str, limit: int = 50) -> DataFrame:
    """The last ``limit`` lines with the tag: line_no, value, level."""
    return log_tail(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()), tag, limit)


def log_levels(lines: DataFrame, tag: str) -> DataFrame:
    """Lines with the tag and their level."""
    return lines.where(F.contains("value", F.lit(tag))).withColumn("level", log_level(F.col("value")))


def log_tail(lines: DataFrame, tag: str, limit: int = 50) -> DataFrame:
    return log_levels(lines, tag).orderBy(F.desc("line_no")).limit(limit)


def decode_vectors(df: DataFrame, column: str = "vector") -> DataFrame:
    """Vectors that an import holds as JSON text."""
    return df.withColumn(column, F.from_json(column, "array<double>"))


def decode_list(df: DataFrame, column: str) -> DataFrame:
    """Lists of names that an import holds as JSON text; empty if unreadable."""
    return df.withColumn(column, F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")))
