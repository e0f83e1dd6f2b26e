"""Embedding as a data job: a pluggable embedder run on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..scratch import numbered_in_order
from .batches import IN_ORDER, assigned, followers, sized

#: Texts -> one vector each.
Embedder = Callable[[list[str]], np.ndarray]
_TERM = regex.compile(r"[\p{L}\p{N}]+")


class HashEmbedder:
    """Unit vectors of term counts in buckets of md5; zero without terms. Needs no model."""

    def __init__(self, dims: int = DEFAULT.dims):
        self.dims, self._buckets = dims, {}

    def _bucket(self, term: str) -> int:
        if term not in self._buckets:
            if len(self._buckets) >= 200_000:
                self._buckets.clear()
            self._buckets[term] = int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % self.dims
        return self._buckets[term]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            terms = _TERM.findall((text or "").lower())
            row += np.bincount([self._bucket(t) for t in terms], minlength=self.dims) if terms else 0
            length = np.sqrt((row * row).sum())
            row /= length or 1.0
        return out


def embed_documents(df: DataFrame, column: str = "content", embedder: Embedder | None = None, out: str = "vector") -> DataFrame:
    """``df`` with a vector per row; it stays with its row, so no positions are matched up."""
    embedder = embedder or HashEmbedder()
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            vectors = np.asarray(embedder([t or "" for t in batch.column(names.index(column)).to_pylist()]), float)
            dims = vectors.shape[1] if len(vectors) else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dims, pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` array<double>")


#: Rows in a range of ids whose batches one task fills, about.
RANGE_ROWS = 8_192


def _sized(df: DataFrame, column: str, id_col: str, buckets: int | None, range_rows: int, *others: Column) -> tuple[DataFrame, int]:
    """Rows of ``batches.sized`` and how many ranges of ids a bucket has."""
    buckets = buckets or 1
    rows = sized(df, F.col(id_col).cast("long"), F.length(F.coalesce(column, F.lit(""))), buckets, *others)
    return rows, -(-rows.count() // (range_rows * buckets))


def assign_embedding_batches(df: DataFrame, column: str = "content", id_col: str = "item_id", buckets: int | None = None, range_rows: int = RANGE_ROWS, config: Config = DEFAULT) -> DataFrame:
    """item ids with the batch that a greedy fill puts them in: bucket, batch, tokens.

    The fill goes through all ids in order, or through those of each of ``buckets``
    hash buckets; a task takes about ``range_rows`` rows (an id and a number) at once.
    """
    placed = assigned(*_sized(df, column, id_col, buckets, range_rows), config)
    return placed.select(F.col("id").alias("item_id"), "bucket", "batch", (F.col("chars") / config.chars_per_token).alias("tokens"))


def embed_in_batches(df: DataFrame, column: str = "content", id_col: str = "item_id", embedder: Embedder | None = None, out: str = "vector", buckets: int | None = None, range_rows: int = RANGE_ROWS, config: Config = DEFAULT) -> DataFrame:
    """``df`` with bucket, batch, a vector per row and error: one call of the embedder gets the texts of exactly one batch.

    Batches are those of ``assign_embedding_batches``: at most ``config.batch_texts``
    texts and ``config.batch_tokens`` estimated tokens, unless one text alone has
    more.  A call that raises, or gives other than a vector per text, fails its batch
    alone: these rows have no vector and the error's text.  A null text is an empty one.
    Rows of one range are filled and embedded by one task, those of more meet by their batch.
    """
    embedder = embedder or HashEmbedder()
    names = df.columns
    rows, ranges = _sized(df, column, id_col, buckets, range_rows, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    placed = assigned(rows, ranges, config) if ranges > 1 else rows.withColumn("batch", F.lit(0))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(f"_{c}", way) for c, way in IN_ORDER])
        texts, after = [t or "" for t in table[column].to_pylist()], followers(table["_chars"].to_numpy(), config)[1]
        batches, vectors, errors, a = [], [], [], 0
        while a < len(texts):
            n = int(after[a]) - a
            try:
                made = np.asarray(embedder(texts[a : a + n]), float)
                if made.ndim != 2 or len(made) != n:
                    raise ValueError(f"{n} texts gave vectors of shape {made.shape}")
                vectors += list(made)
                errors += [None] * n
            except Exception as e:  # the batch fails, whatever it was; the others go on
                vectors += [None] * n
                errors += [f"{type(e).__name__}: {e}"] * n
            batches += [(batches[-1] if batches else table["_batch"][0].as_py() - 1) + 1] * n
            a += n
        made = [pa.array(batches, pa.int32()), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())]
        return pa.table([*(table[c] for c in names), table["_bucket"], *made], names=[*names, "bucket", "batch", out, "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = placed.select("row.*", *(F.col(c).alias(f"_{c}") for c in ("bucket", "batch", "id", "chars")))
    return placed.groupBy("_bucket", "_batch").applyInArrow(run, f"{schema}, bucket int, batch int, `{out}` array<double>, error string")


def batch_size(items: Column, config: Config = DEFAULT, rule: str = "server") -> Column:
    """Items of an indexing batch for a collection's size, by the ``server`` rule or the ``browser`` one."""
    if rule not in ("server", "browser"):
        raise ValueError("rule must be server or browser")
    steps, beyond = (config.batch_sizes, config.batch_size_beyond) if rule == "server" else (config.browser_batch_sizes, config.browser_batch_size_beyond)
    size = F.lit(beyond)
    for most, n in reversed(steps):
        size = F.when(items <= most, F.lit(n)).otherwise(size)
    return size


def item_pages(items: DataFrame, config: Config = DEFAULT, rule: str = "server") -> DataFrame:
    """collection_id, item_id and the number of the batch they are indexed in, from 1, by item id."""
    sizes = items.groupBy("collection_id").agg(F.count("*").alias("_n"))
    placed = numbered_in_order(items.select("collection_id", "item_id"), "collection_id", "item_id", "_k").join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, "collection_id")
    size = batch_size(F.col("_n"), config, rule)
    return placed.select("collection_id", "item_id", size.cast("long").alias("batch_size"), (F.floor((F.col("_k") - 1) / size) + 1).cast("long").alias("page"))
