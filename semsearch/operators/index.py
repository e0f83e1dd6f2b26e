"""The vector table: what is missing, upserts, deletes, changes, counts.

The table is a folder of snapshots; each is partitioned by collection and never
changed, and the newest of the pointer files names the current one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT, Config
from ..functions.text import is_blank
from ..functions.vectors import norm
from ..scratch import exists, scratch_path
from .documents import build_documents, truncated
from .embed import Embedder, embed_documents, embed_in_batches

KEY = ["item_id", "collection_id"]
POINTER = "number long, version string, schema string"


def pending_items(items: DataFrame, vectors: DataFrame, force: bool = False) -> DataFrame:
    """Items without a vector; all with ``force``."""
    return items if force else items.join(vectors.select(*KEY), KEY, "left_anti")


def latest_of_key(rows: DataFrame, keys: list[str] = KEY, order: str = "seq") -> DataFrame:
    """The row of the highest ``order`` for each key, formed before the shuffle; of equal ones the largest by its other columns' hash."""
    others = [c for c in rows.columns if c not in keys]
    highest = F.max_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*others)))
    return rows.groupBy(*keys).agg(highest.alias("_r")).select(*(F.col(c) if c in keys else F.col(f"_r.`{c}`").alias(c) for c in rows.columns))


def upsert_vectors(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of equal keys in ``new`` the last by ``order`` stays."""
    new = (latest_of_key(new, order=order) if order else new.dropDuplicates(KEY)).select(*old.columns)
    return old.join(new.select(*KEY), KEY, "left_anti").select(*old.columns).unionByName(new)


def remove_orphans(vectors: DataFrame, valid: DataFrame, collection_id: int | None = None) -> DataFrame:
    """Vectors without those, of the collection or all, whose key isn't among ``valid``."""
    kept = vectors.join(valid.select(*KEY).distinct(), KEY, "left_semi")
    if collection_id is None:
        return kept
    of = F.col("collection_id") == collection_id
    return vectors.where(~of).unionByName(kept.where(of))


def delete_collections(vectors: DataFrame, collection_ids: list[int] | None) -> DataFrame:
    """Vectors without these collections; none left if no id is given."""
    return vectors.where(~F.col("collection_id").isin(collection_ids)) if collection_ids else vectors.limit(0)


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state of items after changes: the latest row of each, deleted ones as tombstones.

    Both have item_id, seq and op.  A late change of a deleted item finds the
    tombstone's higher seq and doesn't bring it back.
    """
    return latest_of_key(state.unionByName(changes.select(*state.columns)), ["item_id"])


def live_items(state: DataFrame) -> DataFrame:
    return state.where("op != 'deleted'")


def index_items(items: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, force: bool = False, config: Config = DEFAULT) -> DataFrame:
    """New vector rows of the items that have none: text, cut, vector, norm."""
    texts = truncated(build_documents(pending_items(items, vectors, force), "block", config), config)
    embedded = embed_documents(texts.select("item_id", "collection_id", "collection_name", "content", F.col("url").alias("permalink")), embedder=embedder)
    return embedded.withColumn("norm", norm(F.col("vector"))).withColumn("last_updated", F.current_timestamp())


def index_batch(items: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, force: bool = False, config: Config = DEFAULT) -> DataFrame:
    """One row per item: KEY, outcome, error, and what its new vector row holds (nulls unless indexed).

    An item is ``skipped`` if it has a vector (and not ``force``), ``failed`` if there is
    no text of its own (title, description and metadata blank) or the embedder failed on its
    batch, else ``indexed``.
    """
    has = vectors.select(*KEY).distinct().withColumn("_has", F.lit(True))
    blank = is_blank(F.col("title")) & is_blank(F.col("description")) & (F.coalesce(F.size("metadata"), F.lit(0)) <= 0)
    there = F.lit(False) if force else F.coalesce("_has", F.lit(False))
    judged = items.join(has, KEY, "left").withColumn("outcome", F.when(there, "skipped").when(blank, "failed").otherwise("indexed"))
    texts = truncated(build_documents(judged.where("outcome = 'indexed'"), "block", config), config)
    made = embed_in_batches(texts.select(*KEY, "collection_name", "content", F.col("url").alias("permalink")), embedder=embedder, config=config)
    good = F.col("error").isNull()
    made = made.withColumns({"outcome": F.when(good, "indexed").otherwise("failed"), "norm": norm(F.col("vector")), "last_updated": F.when(good, F.current_timestamp())}).drop("bucket", "batch")
    others = judged.where("outcome <> 'indexed'").select(*KEY, "outcome", F.when(F.col("outcome") == "failed", "no text").alias("error"))
    return made.unionByName(others, allowMissingColumns=True)


def index_collections(items: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, force: bool = False, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Index the items without a vector (all with ``force``): the vector table after that, and each item's outcome.

    The outcomes of ``index_batch`` (KEY, outcome) can be counted by ``outcome_counts``; each text is embedded once.
    """
    path = scratch_path(items.sparkSession, "indexed-items")
    rows = index_batch(items, vectors, embedder, force, config)
    rows.write.parquet(path)
    rows = items.sparkSession.read.schema(rows.schema).parquet(path)
    return upsert_vectors(vectors, rows.where("outcome = 'indexed'")), rows.select(*KEY, "outcome")


def with_vector(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """``items`` with ``indexed``: whether there is a vector of their key."""
    return items.join(vectors.select(*KEY).distinct().withColumn("_has", F.lit(True)), KEY, "left").withColumn("indexed", F.coalesce("_has", F.lit(False))).drop("_has")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """collection_id with how many items were indexed, skipped or failed."""
    return outcomes.groupBy("collection_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("indexed", "skipped", "failed")))


def total_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("total"))


def vectors_by_collection(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("collection_id", "collection_name").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "collection_id")


def collection_stats(vectors: DataFrame, exact: bool = True) -> DataFrame:
    """Vectors, first and last update, and distinct items of each collection."""
    distinct = F.count_distinct("item_id") if exact else F.approx_count_distinct("item_id")
    return vectors.groupBy("collection_id").agg(
        F.count("*").alias("total"), F.min("last_updated").alias("first_update"), F.max("last_updated").alias("last_update"), distinct.alias("items"), F.max("collection_name").alias("collection_name")
    )


def index_coverage(collections: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each collection with its vectors and their percent of its items."""
    counts = vectors.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    percent = F.when(F.col("items_count") > 0, F.round(100 * n / F.col("items_count"), 0)).otherwise(F.lit(0.0))
    return collections.join(counts, "id", "left").select("id", "name", "items_count", n.alias("vectors"), percent.alias("percent"))


def index_health(vectors: DataFrame, collections: DataFrame) -> DataFrame:
    """check, value, status: vectors, collections with vectors, enabled collections."""
    a = vectors.agg(F.count("*").alias("vectors"), F.count_distinct("collection_id").alias("collections_with_vectors"))
    b = collections.agg(F.count_if("enabled").alias("enabled_collections"), F.count("*").alias("collections"))
    rows = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in df.columns))).alias("r")).select("r.*")
    return rows(a).unionByName(rows(b)).withColumn("status", F.when(F.col("value") > 0, "ok").otherwise("warning"))


def write_snapshot(vectors: DataFrame, root: str, version: str, writer_rows: int = 1_000_000) -> str:
    """Write a new snapshot and then a new pointer to it; a reader sees the one before until then.

    A collection's rows are spread over as many tasks as give each at most about ``writer_rows``.
    """
    spark, path = vectors.sparkSession, f"{root}/snapshot={version}"
    salts = max(1, -(-vectors.count() // writer_rows))
    vectors.repartition(F.col("collection_id"), F.pmod(F.xxhash64("item_id"), F.lit(salts))).write.mode("overwrite").partitionBy("collection_id").parquet(path)
    last = spark.read.schema(POINTER).json(f"{root}/current").agg(F.max("number")).first()[0] if exists(spark, f"{root}/current") else None
    number = 0 if last is None else last + 1
    spark.createDataFrame([(number, version, vectors.schema.json())], POINTER).coalesce(1).write.mode("append").json(f"{root}/current")
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that the newest pointer names."""
    newest = spark.read.schema(POINTER).json(f"{root}/current").agg(F.max_by(F.struct("version", "schema"), "number").alias("p")).first().p
    return spark.read.schema(StructType.fromJson(json.loads(newest.schema))).parquet(f"{root}/snapshot={newest.version}")
