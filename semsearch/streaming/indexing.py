"""An indexing run as a stream of item pages that goes on where it was stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import DEFAULT, Config
from ..operators.buckets import BucketTable
from ..operators.embed import Embedder
from ..operators.index import KEY, index_batch
from ..operators.runs import progress
from ..scratch import exists, remove
from ..sources.ingest import flat_items

VECTOR_ROW = "item_id long, collection_id long, collection_name string, content string, permalink string, vector array<double>, norm double, last_updated timestamp"
RUN_ROW = "collection_id long, processed long, indexed long, skipped long, failed long, errors array<string>, last_update timestamp, batch long"

#: Errors that a row of a run keeps.
KEPT_ERRORS = 10


def vector_table(spark: SparkSession, root: str, buckets: int = 64) -> BucketTable:
    """The vectors of a run under ``root``, by item and collection."""
    return BucketTable(spark, f"{root}/vectors", tuple(KEY), StructType.fromDDL(VECTOR_ROW), buckets)


def put_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select(*KEY), KEY, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def stream_indexing(
    pages: DataFrame, root: str, checkpoint: str, collections: DataFrame | None = None, embedder: Embedder | None = None, force: bool = False, config: Config = DEFAULT, buckets: int = 64
) -> StreamingQuery:
    """Index a stream of item pages (collection_id, items) into ``vector_table``, all there is, and stop.

    Started again, it goes on with the first micro-batch that was not done.  A
    micro-batch first writes its items' outcomes and vectors, so texts are embedded
    once; then it puts the vectors into the buckets they belong to; then it writes
    its rows of the run (``run_rows``) to a folder of its number.  Each step replaces what an
    earlier attempt at the same batch left, so a batch that is run again gives the
    same vectors and counters.  ``collections`` (id, name) names the collections of the rows.
    """
    table = vector_table(pages.sparkSession, root, buckets)

    def step(batch: DataFrame, number: int) -> None:
        spark, stage = batch.sparkSession, f"{root}/batches/{number}"
        if not exists(spark, f"{stage}/_SUCCESS"):
            items = flat_items(batch).dropDuplicates(KEY)
            if collections is None:
                items = items.withColumn("collection_name", F.lit(None).cast("string"))
            else:
                items = items.join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name")), "collection_id", "left")
            index_batch(items, table.part(table.touched(items)), embedder, force, config).write.mode("overwrite").parquet(stage)
        rows = spark.read.parquet(stage)
        table.change(rows.where("outcome = 'indexed'").select(*table.schema.names), number, put_vectors)
        write_run_rows(rows, f"{root}/runs/batch={number}")
        if number:
            table.forget(number - 1)
            if exists(spark, f"{root}/batches/{number - 1}"):
                remove(spark, f"{root}/batches/{number - 1}")

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_run_rows(rows: DataFrame, path: str) -> None:
    """The counters of a micro-batch, a row per collection."""
    counted = [F.count("*").alias("processed"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("indexed", "skipped", "failed"))]
    errors = F.slice(F.array_sort(F.collect_set(F.when(F.col("outcome") == "failed", F.col("error")))), 1, KEPT_ERRORS)
    rows.groupBy("collection_id").agg(*counted, errors.alias("errors"), F.current_timestamp().alias("last_update")).write.mode("overwrite").parquet(path)


def run_rows(spark: SparkSession, root: str) -> DataFrame:
    """``RUN_ROW`` of every micro-batch that was done."""
    if not exists(spark, f"{root}/runs"):
        return spark.createDataFrame([], RUN_ROW)
    return spark.read.schema(RUN_ROW).option("basePath", f"{root}/runs").parquet(f"{root}/runs")


def run_summary(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Each collection of ``totals`` (collection_id, total): sums of its run rows, batches, percent and status.

    ``pending`` without a row, ``completed`` once as many items as there are were processed, else ``processing``.
    """
    sums = [F.sum(c).alias(c) for c in ("processed", "indexed", "skipped", "failed")]
    done = rows.groupBy("collection_id").agg(*sums, F.count("*").alias("batches"))
    counted = totals.join(done, "collection_id", "left").fillna(0, ["processed", "indexed", "skipped", "failed", "batches"])
    status = F.when(F.col("batches") == 0, "pending").when(F.col("processed") >= F.col("total"), "completed").otherwise("processing")
    return counted.withColumns({"progress": progress(F.col("processed"), F.col("total")), "status": status})
