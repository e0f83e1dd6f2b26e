"""Longest-processing-time scheduling of groups of documents onto shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_or_not, stored


#: Copies from which on a text's rows are not shuffled to meet its shard.
HOT_ROWS = 10_000


def lpt(sizes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """Schedule ``(size, how many groups of that size)``, given by falling size.

    Every group goes to the least-loaded shard, the lowest of equal ones.  Returns
    for each size how many of its groups went to shards 0 to k, for each k.  Only
    the last group or so of each shard takes a step in the heap: where a size has
    many groups, all but those are placed by the level that they fill up to.
    """
    loads, plan = [0] * shards, []
    for size, count in sizes:
        taken, low, high = [0] * shards, min(loads), min(loads) + size * count
        while low < high:  # the highest level below which no more than count groups would start
            level = (low + high + 1) // 2
            if sum(max(0, -(-(level - x) // size)) for x in loads) <= count:
                low = level
            else:
                high = level - 1
        for k, x in enumerate(loads):
            taken[k] = max(0, -(-(low - x) // size))
        heap = [(x + size * t, k) for k, (x, t) in enumerate(zip(loads, taken, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(taken)):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            taken[k] += 1
        loads = [x + size * t for x, t in zip(loads, taken, strict=True)]
        plan.append([sum(taken[: k + 1]) for k in range(shards)])
    return plan


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards whose bytes are near equal, equal texts together.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (from 0
    without gaps in each shard), grown_shard (null: a group's place depends on all sizes).

    Groups are sized where the rows are and only digests are shuffled.  The
    schedule needs how many groups there are of each size: distinct sizes of total
    B are fewer than sqrt(2 B), so this table alone goes through the driver.
    Groups of one size are numbered in chunks and dealt out by that number.  A text
    with more than ``HOT_ROWS`` copies finds its rows where they are.
    A null text counts as an empty one and joins its group; repeated rows are kept;
    an empty table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = stored(
        df.select(df[id_col].cast("long").alias("doc_id"), text.alias("_t")).select(
            "doc_id", (F.octet_length("_t") + 1).cast("long").alias("size"), F.crc32("_t").alias("text_crc32"), F.unhex(F.md5("_t")).alias("_key")
        ),
        "digests",
    )
    groups = stored(docs.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")), "groups")
    sizes = [(r[0], r[1]) for r in groups.groupBy("_bytes").count().orderBy(F.desc("_bytes")).collect()]
    plan = spark.createDataFrame([(s, p) for (s, _), p in zip(sizes, lpt(sizes, shards), strict=True)], "_bytes long, _upto array<long>")
    ranked = numbered(groups, ["_bytes"], F.xxhash64("_key"), [F.col("_key")], "_rank0")
    plan = F.broadcast(plan) if len(sizes) <= 50_000 else plan
    placed = stored(ranked.join(plan, "_bytes").select("_key", "_rows", F.expr("size(filter(_upto, x -> x <= _rank0))").alias("shard")), "placed")
    # groups of many copies are few and are sent to their rows, so that no task gets all copies of a text
    hot = small_or_not(stored(placed.where(F.col("_rows") > HOT_ROWS).select("_key", "shard"), "hot-groups"))
    rest = docs.join(hot, "_key", "left_anti").join(small_or_not(placed.where(F.col("_rows") <= HOT_ROWS).select("_key", "shard"), 20_000), "_key")
    dealt = stored(docs.join(hot, "_key").unionByName(rest).drop("_key"), "dealt")
    return numbered(dealt, ["shard"], F.xxhash64("doc_id", "text_crc32"), [F.col("doc_id"), F.col("text_crc32")], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
