"""A greedy fill of batches in order of id, made by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..scratch import in_ranges, range_splits, scratch_path

_KEY = ["bucket", "range"]
#: Arrow's order of a range.
IN_ORDER = [("id", "ascending"), ("chars", "ascending")]
_OUTCOME = "bucket int, range double, texts long, chars long, before array<long>, more array<long>, open_texts array<long>, open_chars array<long>"
_OPEN = "bucket int, range double, batch int, open_texts long, open_chars long"
_BEGUN = "bucket int, range double, batch int, starts array<int>"


def followers(chars: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Characters before each text and after the last, and the place after the batch that would begin with each text.

    A batch ends before it would have more texts or estimated tokens than an embedder
    takes, and has one text at least.  Sums of characters are exact.
    """
    before, at = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)]), np.arange(len(chars))
    fits = np.searchsorted(before, before[:-1] + config.batch_tokens * config.chars_per_token, side="right") - 1
    return before, np.maximum(np.minimum(fits, at + config.batch_texts), at + 1)


def _taken(texts: int, chars: int, before: np.ndarray, config: Config) -> int:
    """How many of a range's first texts an open batch of so many texts and characters still takes."""
    fits = int(np.searchsorted(before, config.batch_tokens * config.chars_per_token - chars, side="right")) - 1
    return max(0, min(config.batch_texts - texts, fits))


def _outcome(chars: np.ndarray, config: Config) -> dict:
    """What a range does to the batch that is open before it, for every number of texts that this may take.

    These numbers end with the batch that would begin with the range.  For each: the
    characters taken, how many batches begin after the range's own first one, and
    texts and characters of the batch that is open at the range's end.
    """
    before, after = followers(chars, config)
    n, after = len(chars), after.tolist()
    more, last = [0] * n, list(range(n))
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            more[i], last[i] = more[after[i]] + 1, last[after[i]]
    m = min(after[0] + 1, n)
    ends = np.array(last[:m])
    return {"texts": n, "chars": int(before[n]), "before": before[: after[0] + 1].tolist(), "more": more[:m], "open_texts": (n - ends).tolist(), "open_chars": (before[n] - before[ends]).tolist()}


def _none(config: Config) -> tuple[int, int, int]:
    """Batch, texts and characters before the first range: a full one, so the first text begins batch 0."""
    return -1, config.batch_texts, 0


def _open_batches(config: Config):
    """From outcomes in order of bucket and range: number (-1 if none), texts and characters of the batch that is open before each range."""

    def run(parts: Iterator[pa.RecordBatch]):
        bucket = state = None
        for part in parts:
            found = []
            for r in part.to_pylist():
                if r["bucket"] != bucket:
                    bucket, state = r["bucket"], _none(config)
                found.append((bucket, r["range"], *state))
                batch, texts, chars = state
                p = _taken(texts, chars, np.array(r["before"]), config)
                state = (batch, texts + p, chars + r["chars"]) if p == r["texts"] else (batch + 1 + r["more"][p], r["open_texts"][p], r["open_chars"][p])
            names = [*_KEY, "batch", "open_texts", "open_chars"]
            schema = pa.schema(list(zip(names, (pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()), strict=True)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, f, strict=True)) for f in found], schema)

    return run


def _row(schema: str, **values) -> pa.Table:
    types = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.table({c: pa.array([values[c]], types[t]) for c, t in (field.split(" ") for field in schema.split(", "))})


def sized(df: DataFrame, id_: Column, chars: Column, buckets: int, *others: Column) -> DataFrame:
    """``others`` with bucket, id and chars; one bucket is the whole table, more are dealt by a hash of the id."""
    bucket = F.lit(0) if buckets == 1 else F.coalesce(F.pmod(F.xxhash64(id_), F.lit(buckets)), F.lit(0))
    return df.select(*others, bucket.cast("int").alias("bucket"), id_.alias("id"), chars.cast("long").alias("chars"))


def assigned(rows: DataFrame, ranges: int, config: Config) -> DataFrame:
    """Rows of ``sized`` with the batch that a fill in order of id within their bucket puts them in.

    The fill is sequential, but what a range of ids does to the batch that is open
    before it is a short table: every range gives one to a single task, which goes
    through them with a few steps a range, and then the ranges are filled by many
    tasks.  Null ids come last, equal ones by size.  Beyond one range the sizes are
    stored; other columns are read once more.
    """
    spark, light = rows.sparkSession, rows.select("bucket", "id", "chars")
    if ranges > 1:
        path = scratch_path(spark, "batch-sizes")
        light.write.parquet(path)
        light = spark.read.schema(light.schema).parquet(path)
        splits = range_splits(light, "id", ranges)
        rows, light = (in_ranges(df, "id", splits, "range") for df in (light if rows.columns == light.columns else rows, light))
    else:
        rows, light = rows.withColumn("range", F.lit(0.0)), light.withColumn("range", F.lit(0.0))

    def outcome(table: pa.Table) -> pa.Table:
        key = {c: table[c][0].as_py() for c in _KEY}
        return _row(_OUTCOME, **key, **_outcome(table.sort_by(IN_ORDER)["chars"].to_numpy(), config))

    def starts(table: pa.Table) -> pa.Table:
        first = {c: table[c][0].as_py() for c in (*_KEY, "batch", "open_texts", "open_chars")}
        before, after = followers(table.sort_by(IN_ORDER)["chars"].to_numpy(), config)
        i, found = _taken(first["open_texts"], first["open_chars"], before, config), []
        while i < len(after):
            found.append(i)
            i = int(after[i])
        return _row(_BEGUN, **first, starts=found)

    if ranges > 1:
        made = light.groupBy(_KEY).applyInArrow(outcome, _OUTCOME)
        light = light.join(made.repartition(1).sortWithinPartitions(_KEY).mapInArrow(_open_batches(config), _OPEN), _KEY)
    else:
        light = light.withColumns(dict(zip(("batch", "open_texts", "open_chars"), map(F.lit, _none(config)), strict=True)))
    begun = light.groupBy(_KEY).applyInArrow(starts, _BEGUN)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(_KEY).orderBy(F.asc_nulls_last("id"), "chars")) - 1)
    batch = F.col("batch") + F.size(F.filter("starts", lambda s: s <= F.col("place")))
    return placed.join(begun, _KEY).withColumn("batch", batch.cast("int")).drop("range", "place", "starts")
