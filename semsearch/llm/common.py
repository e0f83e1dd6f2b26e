"""Helpers shared by the operators: scratch tables, bounded broadcasts, salted numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import scratch_path

#: A side of a join is broadcast only when it has at most this many rows (of a few longs each).
BROADCAST_ROWS = 200_000


#: Bytes of a batch of rows that is sent to a Python worker.
BATCH_BYTES = 6_000_000


def for_python(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python workers in batches of about ``BATCH_BYTES``.

    Spark's own bound is ten times that, which the JVM and the worker both hold more than once.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB") if spark.conf.get(name).rstrip("bB").isdigit() else BATCH_BYTES + 1) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return df


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no more than the tasks it ran.
    ``compression`` is other than the session's where that wastes time or memory, as on hashes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more; other tables stay."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as set it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small; otherwise as it is.

    ``df`` should be cheap to read (a stored table).  Beyond the bound Spark joins by shuffle.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count shows at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def n_chunks(spark: SparkSession) -> int:
    """Into how many chunks a group is split: as many as there are shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, keys: list[str], spread: Column, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in column ``out``.

    ``spread`` is a hash of the row.  It deals each group over chunks, so that a
    group with a third of all rows is numbered by many tasks: rows are counted
    within a chunk, and chunk offsets come from a table of one row per group and chunk.
    """
    n = n_chunks(df.sparkSession)
    df = df.withColumn("_chunk", F.pmod(spread, F.lit(n)).cast("int"))
    counts = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(within))
    return (
        ranked.join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .drop("_chunk", "_rank", "_before")
    )
