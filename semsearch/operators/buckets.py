"""A table whose rows lie in a fixed number of bucket folders, so that a change reads and writes only those it has keys for.

A change is first written whole to a folder of its own (the stage) and then put in the
place of the touched buckets by a dynamic partition overwrite.  A change that is
run again after a failure takes its stage as it is, if that was finished, so a
crash between the two steps, or amid the second, loses and doubles nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import exists, remove


@dataclass(frozen=True)
class BucketTable:
    """Rows of ``schema`` under ``root``, dealt by a hash of ``keys`` over ``buckets`` folders (the number stays the table's for good)."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = 64

    @property
    def path(self) -> str:
        return f"{self.root}/rows"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _load(self, path: str) -> DataFrame:
        """Rows as they lie, with their bucket and the mark of rows that only keep a bucket's folder."""
        return self.spark.read.schema(StructType([*self.schema.fields, *StructType.fromDDL("_mark boolean, bucket int").fields])).parquet(path)

    def read(self) -> DataFrame:
        """All rows; none before the first change."""
        return self.part(None)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with these keys lie in, at most ``buckets`` numbers."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def part(self, buckets: list[int] | None) -> DataFrame:
        """The rows of these buckets; only their folders are read."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self._load(self.path).where("not _mark")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket", "_mark")

    def change(self, rows: DataFrame, number: int | str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put ``merge(rows of the touched buckets, rows)`` in the place of these buckets; returns their numbers.

        ``rows`` holds the keys that change and whatever ``merge`` needs.  ``number``
        names the change: the same number is the same change run again.  A touched
        bucket has one writer and a row that marks it, so a bucket that loses all its rows is replaced too.
        """
        stage, touched = f"{self.root}/stage/{number}", self.touched(rows)
        if not touched:
            return []
        if not exists(self.spark, f"{stage}/_SUCCESS"):
            merged = merge(self.part(touched), rows).select(*self.schema.names, F.lit(False).alias("_mark"), self.bucket().alias("bucket"))
            nothing = (F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields)
            marks = self.spark.range(self.buckets).where(F.col("id").isin(touched)).select(*nothing, F.lit(True).alias("_mark"), F.col("id").cast("int").alias("bucket"))
            merged.unionByName(marks).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(stage)
        self._install(stage)
        return touched

    def _install(self, stage: str) -> None:
        self._load(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def forget(self, number: int | str) -> None:
        """Delete the stage of a change that will not be run again."""
        if exists(self.spark, f"{self.root}/stage/{number}"):
            remove(self.spark, f"{self.root}/stage/{number}")
