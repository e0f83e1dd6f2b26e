"""Lines that many documents share, through levelled sorted runs of line hashes.

Documents come in batches of falling ids.  A batch's keys are merge-anti-joined with
the runs before it: what no run holds is new, and the batch's largest document that
holds it is the last of all, the one that keeps the line.  The batch adds its own run.
A run is a table bucketed and sorted by hash with a row per key, so joins and merges read
runs as they lie, without a shuffle of them.  ``FANOUT`` runs of a level are
compacted into one of the next by full outer merge joins, which sum the documents of each key.

All of it is DataFrame work; texts are read twice and never shuffled unless so many documents
lose lines that their row numbers cannot be broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_small, n_chunks, scratch_path, small_or_not, stored

#: White space that is stripped from lines; code points and documents that a line needs to be dropped.
SPACE, LEAST_LENGTH, LEAST_DOCUMENTS = " \t\n\v\f\r", 20, 3

#: Batches of a table, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 4, 2

#: Stands for a missing id: such rows are one document that comes before all others.
NO_ID = -(1 << 63)

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    """All lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_occurrences(df: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc, row (hash of the text), at (number of the line from 0), h1, h2 (128 bits of the key) of every line that is long enough."""
    text = df[text_col].cast("string")
    lines = df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(lines_of(text)).alias("at", "line"))
    keyed = lines.select("doc", "row", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_length)
    return keyed.select("doc", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


@dataclass
class Run:
    """A table bucketed and sorted by ``KEY``, with docs and last (null for keys that an earlier run holds)."""

    table: str
    level: int


@dataclass
class LineRuns:
    """Runs of line hashes of all batches so far, the oldest first."""

    spark: SparkSession
    fanout: int = FANOUT
    runs: list[Run] = field(default_factory=list)
    compactions: int = 0

    def __post_init__(self):
        self.buckets = n_chunks(self.spark)

    def _write(self, rows: DataFrame, level: int) -> Run:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.select(*KEY, "docs", "last").write.format("parquet").option("compression", "none").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", scratch_path(self.spark, name)).saveAsTable(name)
        return Run(name, level)

    def _read(self, run: Run) -> DataFrame:
        return self.spark.table(run.table)

    def add(self, batch: DataFrame) -> Run:
        """Take in a batch of ``line_occurrences``, all of smaller documents than those before; returns its run.

        Rows of new keys name the last document; known keys only add to the count.
        Counts are formed before the shuffle, so a line of a third of all
        documents is a row per task there.
        """
        keys = stored(batch.groupBy(*KEY).agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last")), "batch-keys", "none")
        fresh = keys
        for run in self.runs:
            fresh = fresh.join(self._read(run).select(*KEY).hint("merge"), KEY, "left_anti")
        if self.runs:
            keys = keys.join(fresh.select(*KEY, F.lit(True).alias("fresh")).hint("merge"), KEY, "left").withColumn("last", F.when(F.col("fresh"), F.col("last")))
        self.runs.append(self._write(keys if self.runs else keys.repartition(self.buckets, *KEY), 0))
        written = self.runs[-1]
        while len(same := [r for r in self.runs if r.level == self.runs[-1].level]) >= self.fanout:
            self._compact(same)
        return written

    def _merged(self, runs: list[Run]) -> DataFrame:
        """One row per key of these runs, bucket by bucket; of a key's rows one names its last document."""
        rows = self._read(runs[0])
        for run in runs[1:]:
            other = self._read(run).select(*KEY, F.col("docs").alias("_docs"), F.col("last").alias("_last"))
            both = rows.join(other.hint("merge"), KEY, "full")
            rows = both.select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"), F.coalesce("last", "_last").alias("last"))
        return rows

    def _compact(self, runs: list[Run]) -> None:
        merged = self._write(self._merged(runs), runs[-1].level + 1)
        self.runs = [r for r in self.runs if r not in runs] + [merged]
        self.compactions += 1
        for run in runs:
            self._drop(run)

    def _drop(self, run: Run) -> None:
        """Forget a table and delete its files."""
        files = self._read(run).inputFiles()
        self.spark.sql(f"DROP TABLE {run.table}")
        for folder in {f.rsplit("/", 1)[0] for f in files}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def frequent(self, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
        """Keys of at least so many documents with the last one: h1, h2, docs, last. Stored, as the runs go with it."""
        if not self.runs:
            return self.spark.range(0).select(*(F.col("id").alias(c) for c in (*KEY, "docs", "last")))
        rows = stored(self._merged(self.runs).where(F.col("docs") >= least_documents), "frequent-lines", "none")
        for run in self.runs:
            self._drop(run)
        self.runs = []
        return rows


def batches(occurrences: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """The rows in ranges of falling document ids, about equally many in each; a document is in one range."""
    cuts = occurrences.agg(F.percentile_approx("doc", [k / n for k in range(1, n)], 10_000).alias("c")).first().c
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    doc, parts = F.col("doc"), []
    for above, below in zip(edges[:-1], edges[1:], strict=True):
        inside = F.lit(True) if above is None else doc <= above
        parts.append(occurrences.where(inside if below is None else inside & (doc > below)))
    return parts


def dropped_lines(occurrences: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc, row and the sorted numbers of its lines whose key is frequent and kept by a later document.

    Keys of so many documents that one could unbalance a join are met by broadcast:
    those with more than a quarter of a partition's even share, of which there are at most
    four times as many as partitions. All others meet in a shuffle.
    """
    n = n_chunks(occurrences.sparkSession)
    total = occurrences.count()
    hot = F.col("docs") > max(100, total // (4 * n))
    some = frequent.where(hot)
    columns = ["doc", "row", "at"]
    if is_small(frequent):
        met = occurrences.join(F.broadcast(frequent.select(*KEY, "last")), KEY)
    else:
        met = occurrences.join(F.broadcast(some.select(*KEY, "last")), KEY).select(*columns, "last")
        rest = occurrences.join(F.broadcast(some.select(*KEY)), KEY, "left_anti").join(frequent.where(~hot).select(*KEY, "last"), KEY)
        met = met.unionByName(rest.select(*columns, "last"))
    lost = met.where(F.col("doc") < F.col("last"))
    return lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set("at")).alias("lost"))


def without_shared_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, n_batches: int = BATCHES
) -> DataFrame:
    """Each row with its id, text without the lines that later documents keep, n_lines and n_dropped.

    A line of at least ``least_length`` code points found in ``least_documents``
    documents stays in the one of the largest id alone, there as often as it occurs.
    Rows of one id are one document; rows without an id are one that comes before all
    others; a null or empty text is one empty line; an empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    occurrences = stored(line_occurrences(df, id_col, text_col, least_length), "line-occurrences", "none")
    runs = LineRuns(spark)
    for batch in batches(occurrences, n_batches):
        runs.add(batch)
    lost = stored(dropped_lines(occurrences, runs.frequent(least_documents)), "dropped-lines", "none")
    text = df[text_col].cast("string")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("row"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    joined = rows.join(small_or_not(lost), ["doc", "row"], "left")
    lines, n_lines = lines_of(F.col("text")), F.size(lines_of(F.col("text")))
    # what stands between the dropped lines, so that the work follows the number of lines
    edges = F.concat(F.array(F.lit(-1)), F.col("lost"), F.array(n_lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("lost") + 1), lambda i: F.slice("_lines", F.col("_edges")[i - 1] + 2, F.col("_edges")[i] - F.col("_edges")[i - 1] - 1)))
    out = joined.select("doc_id", "text", "lost", n_lines.cast("long").alias("n_lines"), F.when(F.col("lost").isNotNull(), lines).alias("_lines"), F.when(F.col("lost").isNotNull(), edges).alias("_edges"))
    return out.select("doc_id", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), "n_lines", F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"))


def line_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    return without_shared_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
