"""Exact top-k search by inner product over a vector-approximation file.

The file is a Parquet table with one row per block of vectors: ids, one cell number
per component, the smallest and largest value in each cell, and the exact integers.
A search scans the cells, which bound every score from both sides, and reads exact
vectors in the order of their bounds until the kth result is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored

#: Vectors in a block, cells per component, and queries that are held at once.
BLOCK, CELLS, QUERIES = 8192, 64, 2048

FILE_SCHEMA = "dims int, ids binary, cells binary, lows binary, highs binary, exact binary"


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors that are null or hold null or non-finite components go."""
    vector = F.col(vector_col)
    whole = df.where(vector.isNotNull() & F.col(id_col).isNotNull()).where(
        ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    )
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _block(ids: np.ndarray, exact: np.ndarray) -> dict:
    """A row of the file for n vectors (n x dims)."""
    n, dims = exact.shape
    low = exact.min(0)
    step = np.maximum(1, -(-(exact.max(0) - low + 1) // CELLS))
    cells = ((exact - low) // step).astype(np.uint8)
    lows = low + step * np.arange(CELLS)[:, None]
    return {
        "dims": dims, "ids": ids.astype("<i8").tobytes(), "cells": cells.tobytes(), "lows": lows.astype("<i8").tobytes(),
        "highs": (lows + step - 1).astype("<i8").tobytes(), "exact": exact.astype("<i8").tobytes(),
    }


def build(vectors: DataFrame, name: str = "va-file") -> DataFrame:
    """Write the file for ``integers``; blocks hold vectors of one length that one task read."""

    def blocks(batches):
        waiting: dict[int, tuple[list, list]] = {}
        kinds = {"int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in FILE_SCHEMA.split(", "))])

        def flush(dims):
            ids, parts = waiting.pop(dims)
            row = _block(np.concatenate(ids), np.concatenate(parts).reshape(-1, dims))
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dims in np.unique(sizes[sizes > 0]).tolist():
                rows = pa.array(sizes == dims)
                some = waiting.setdefault(dims, ([], []))
                some[0].append(ids[sizes == dims])
                some[1].append(lists.filter(rows).flatten().to_numpy())
                if sum(map(len, some[0])) >= BLOCK:
                    yield flush(dims)
        for dims in list(waiting):
            yield flush(dims)

    return stored(vectors.select("vec_id", "v").mapInArrow(blocks, FILE_SCHEMA), name)


class _Best:
    """The k best (score, id) of a query so far; higher scores first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def certain(self) -> float:
        """A score that anything must reach to be among the k."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_block(row: dict, query_ids: np.ndarray, queries: np.ndarray, best: list[_Best], k: int, together: int = 256) -> int:
    """Add the block's results to those of each query; returns how many exact vectors were read."""
    dims = row["dims"]
    ids = np.frombuffer(row["ids"], "<i8")
    cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, dims)
    exact = np.frombuffer(row["exact"], "<i8").reshape(-1, dims)
    low, high = (np.take_along_axis(np.frombuffer(row[x], "<i8").reshape(CELLS, dims), cells, 0).astype(float) for x in ("lows", "highs"))
    read = 0
    for a in range(0, len(queries), together):
        some = queries[a : a + together].astype(float)
        plus, minus = np.maximum(some, 0), np.minimum(some, 0)
        at_most, at_least = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
        own = query_ids[a : a + together, None] == ids
        at_most[own] = at_least[own] = -np.inf
        kth = np.partition(at_least, max(0, len(ids) - k), 1)[:, max(0, len(ids) - k)] if len(ids) >= k else np.full(len(some), -np.inf)
        for i in range(len(some)):
            found = best[a + i]
            rows = np.flatnonzero((at_most[i] >= max(kth[i], found.certain())) & (at_most[i] > -np.inf))
            rows = rows[np.argsort(-at_most[i][rows], kind="stable")]
            for b in range(0, len(rows), 64):
                if at_most[i][rows[b]] < found.certain():
                    break  # no later vector can reach the kth; an equal score may still have a smaller id
                part = rows[b : b + 64]
                found.add(exact[part] @ queries[a + i], ids[part])
                read += len(part)
    return read


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of ``vectors`` for each of ``queries`` (both ``integers``): query_id, rank, vec_id, score.

    Queries are taken in blocks of about ``QUERIES``, each sent to all tasks; a
    task keeps k results per query over all blocks it scans, and only those are
    shuffled.  Only vectors of a query's length are compared with it.  A repeated
    vector row counts as often as it occurs; of a repeated query id the smallest
    vector is asked.  The largest score must fit a long.
    """
    spark = vectors.sparkSession
    file = build(vectors)
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "va-queries")
    n_blocks = max(1, -(-asked.count() // QUERIES))
    path = scratch_path(spark, "va-results")
    schema = "query_id long, vec_id long, score long"
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()
        by_dims: dict[int, list] = {}
        for r in block:
            by_dims.setdefault(len(r.v), []).append(r)
        held = spark.sparkContext.broadcast({d: (np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], np.int64)) for d, rows in by_dims.items() if d})

        def scan(batches, held=held):
            best = {d: [_Best(k) for _ in ids] for d, (ids, _) in held.value.items()}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["dims"] in best:
                        search_block(row, *held.value[row["dims"]], best[row["dims"]], k)
            for d, found in best.items():
                ids = np.repeat(held.value[d][0], [len(x.ids) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([x.ids for x in found])), pa.array(np.concatenate([x.scores for x in found]))], names=["query_id", "vec_id", "score"])

        file.mapInArrow(scan, schema).write.mode("append").parquet(path)
        held.destroy()
    results = spark.read.schema(schema).parquet(path)
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
