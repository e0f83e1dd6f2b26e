"""Facets of all hits of a search as bitmaps: OR of the chosen values of a facet, AND over facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, keys: list[str], id_col: str = "item_id") -> DataFrame:
    """keys, bucket and the bitmap of the ids in it; ids are positive numbers, so one more than numbers from 0."""
    position, bucket = F.bitmap_bit_position(F.col(id_col) + 1), F.bitmap_bucket_number(F.col(id_col) + 1)
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bits"))


def facet_index(items: DataFrame, facets: dict[str, str], id_col: str = "item_id") -> DataFrame:
    """facet, value, bucket, bits: which items have the value; a null is no value."""
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in facets.items())))
    return bitmaps(items.select(id_col, values.alias("_f")).select(id_col, "_f.facet", "_f.value").where("value is not null"), ["facet", "value"], id_col)


def visible(index: DataFrame, hits: DataFrame, chosen: dict[str, list[str]], id_col: str = "item_id") -> DataFrame:
    """bucket, bits of the hits that have one of the chosen values in every facet with a choice."""
    chosen = {f: v for f, v in chosen.items() if v}
    found = bitmaps(hits.select(id_col), [], id_col).select("bucket", "bits")
    for facet, values in chosen.items():
        either = index.where((F.col("facet") == facet) & F.col("value").isin([str(v) for v in values])).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        both = found.unionByName(either).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        found = both.where("n = 2").drop("n")
    return found


def count_visible(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("visible"))


def facet_totals(index: DataFrame, found: DataFrame) -> DataFrame:
    """facet, value, n: how many of the visible hits have each value; values of none are left out."""
    shown = found.select("bucket", F.col("bits").alias("_shown"))
    pairs = index.join(shown, "bucket").select("facet", "value", "bucket", F.explode(F.array("bits", "_shown")).alias("bits"))
    both = pairs.groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return both.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")
