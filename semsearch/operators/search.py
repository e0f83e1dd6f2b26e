"""Vector search: exact for one or many queries, and through clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity, score
from ..scratch import scratch_path

#: Queries that are sent to all tasks at once.
QUERY_BLOCK = 2048
#: Digits of a similarity that count for ranks, so that equal vectors tie.
DIGITS = 12
HITS = "query_id long, item_id long, similarity double"


def in_collections(df: DataFrame, collection_ids: list[int] | None) -> DataFrame:
    """Rows of these collections; all if none is given."""
    return df.where(F.col("collection_id").isin(collection_ids)) if collection_ids else df


def resolve_collections(requested: DataFrame, collections: DataFrame) -> DataFrame:
    """query_id and collection_id to search: the requested enabled ones (query_id, collection_id), or all enabled ones."""
    enabled = collections.where("enabled").select(F.col("id").alias("collection_id"))
    wanted = requested.where("collection_id is not null").join(enabled, "collection_id", "left_semi").select("query_id", "collection_id").distinct()
    none = requested.select("query_id").distinct().join(wanted, "query_id", "left_anti")
    every = enabled.agg(F.collect_list("collection_id").alias("_all")).withColumn("_one", F.lit(1))  # one row, ids of the catalogue
    return wanted.unionByName(none.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").select("query_id", F.explode("_all").alias("collection_id")))


def search_vector(vectors: DataFrame, query: list[float], k: int = 10, collection_ids: list[int] | None = None, candidate_cap: int | None = None) -> DataFrame:
    """The k most similar rows for one query: rank, similarity, score and all columns but the vector.

    ``candidate_cap`` compares only so many rows, the first by item id.
    """
    rows = in_collections(vectors, collection_ids)
    if candidate_cap is not None:
        rows = rows.orderBy("item_id").limit(candidate_cap)
    similarity = F.round(cosine_similarity(F.array(*(F.lit(float(x)) for x in query)), F.col("vector")), DIGITS)
    top = rows.withColumn("similarity", similarity).drop("vector", "norm").orderBy(F.desc("similarity"), "item_id").limit(k)
    return ranked(top, [])


def ranked(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with rank (from 1) and score, for each of ``keys``."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("similarity"), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).withColumn("score", score(F.col("similarity")))


def search_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, collection_ids: list[int] | None = None) -> DataFrame:
    """The k most similar rows for each of ``queries`` (query_id, vector): query_id, item_id, similarity, rank, score.

    Queries go to all tasks in blocks of ``QUERY_BLOCK``; a task multiplies each
    batch of vectors with a block and keeps k rows a query, so the only exchange
    carries k rows per query and task.  With several blocks each one's hits are
    written before the next is asked.  A query without a vector has no hits, a row
    without one is none; an empty index gives no rows.
    """
    spark = vectors.sparkSession
    rows = in_collections(vectors, collection_ids).select("item_id", "vector")
    queries = queries.where("vector is not null").select("query_id", "vector")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    path, found = scratch_path(spark, "hits"), None
    for b in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).collect()
        dims = max((len(r.vector) for r in block), default=0)
        matrix = np.zeros((len(block), dims))
        for row, r in zip(matrix, block, strict=True):
            row[: len(r.vector)] = r.vector
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in block], np.int64), matrix, np.array([len(r.vector) for r in block], np.int64)))
        found = rows.mapInArrow(_scorer(held, k), HITS)
        if n_blocks > 1:
            found.write.mode("append").parquet(path)
            held.destroy()
    if n_blocks > 1:
        found = spark.read.schema(HITS).parquet(path)
    return ranked(found, ["query_id"]).where(F.col("rank") <= k)


def similarities(queries: np.ndarray, sizes: np.ndarray, vectors: pa.Array) -> np.ndarray:
    """Cosine of every query with every vector, over the query's components; 0 for a zero norm."""
    dims = queries.shape[1]
    matrix = np.zeros((len(vectors), dims))
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        matrix = flat.reshape(-1, dims).astype(float)
    else:
        start = 0
        for row, n in zip(matrix, lengths, strict=True):
            row[: min(n, dims)] = flat[start : start + min(n, dims)]
            start += n
    squares = np.concatenate([np.zeros((len(matrix), 1)), np.cumsum(matrix * matrix, 1)], 1)
    norms = np.sqrt((queries * queries).sum(1))[:, None] * np.sqrt(squares[:, sizes]).T
    return np.divide(queries @ matrix.T, norms, out=np.zeros_like(norms), where=norms > 0)


def _scorer(held, k):
    def run(batches):
        ids, queries, sizes = held.value
        rows = np.arange(len(ids))[:, None]
        best, best_ids = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            items = batch.column(0).to_numpy()
            for a in range(0, len(items) if len(ids) else 0, 4096):
                sims = np.round(similarities(queries, sizes, batch.column(1)[a : a + 4096]), DIGITS)
                some = items[a : a + 4096]
                # item ids in order, so that of equal similarities the smaller ids stand first in a stable sort
                order = np.argsort(some, kind="stable")
                some, sims = some[order], sims[:, order]
                if len(some) > k:
                    kth = np.partition(sims, len(some) - k, 1)[:, len(some) - k, None]
                    # all above the kth, and of those equal to it as many as are left, from the left
                    above, equal = sims > kth, sims == kth
                    take = above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))
                    at = np.nonzero(take)[1].reshape(len(ids), k)
                else:
                    at = np.broadcast_to(np.arange(len(some)), (len(ids), len(some)))
                s, i = np.concatenate([best, sims[rows, at]], 1), np.concatenate([best_ids, some[at]], 1)
                order = np.lexsort((i, -s), 1)[:, :k]
                best, best_ids = s[rows, order], i[rows, order]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(best_ids.ravel()), pa.array(best.ravel())], names=["query_id", "item_id", "similarity"])

    return run


def fit_clusters(vectors: DataFrame, clusters: int, seed: int = 42) -> KMeansModel:
    return KMeans(k=clusters, seed=seed, featuresCol="_features", predictionCol="cluster").fit(vectors.select(array_to_vector("vector").alias("_features")))


#: Steps of a quantised residual to either side, and candidates per wanted hit that are compared exactly.
STEPS, CANDIDATES = 127, 5


def _centres(model: KMeansModel) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))


def build_lists(vectors: DataFrame, model: KMeansModel, path: str) -> None:
    """Inverted lists: a folder per cluster with each vector's residual from the centre in a byte a component, its step, and its norm.

    Exact vectors stay where they are; the lists have a quarter of the bytes of floats.
    """
    placed = model.transform(vectors.select("item_id", "vector", array_to_vector("vector").alias("_features"))).drop("_features")
    residual = F.zip_with("vector", F.element_at(_centres(model), F.col("cluster") + 1), lambda x, c: x.cast("double") - c)
    rows = placed.select("item_id", "cluster", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm"), residual.alias("_r"))
    step = F.greatest(F.array_max(F.transform("_r", F.abs)) / STEPS, F.lit(1e-30))
    rows = rows.withColumn("step", step).select("item_id", "norm", "step", F.transform("_r", lambda x: F.round(x / F.col("step")).cast("tinyint")).alias("codes"), "cluster")
    rows.repartition("cluster", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.mode("overwrite").partitionBy("cluster").parquet(path)


def probes_of(queries: DataFrame, model: KMeansModel, nprobe: int) -> DataFrame:
    """query_id, vector and each of the ``nprobe`` nearest clusters."""
    distance = F.transform(_centres(model), lambda c, i: F.struct(F.aggregate(F.zip_with(c, "vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("d"), i.alias("cluster")))
    return queries.where("vector is not null").select("query_id", "vector", F.explode(F.slice(F.array_sort(distance), 1, nprobe)).alias("p")).select("query_id", "vector", F.col("p.cluster").alias("cluster"))


def search_lists(spark: SparkSession, path: str, vectors: DataFrame, queries: DataFrame, model: KMeansModel, k: int = 10, nprobe: int = 8, candidates: int = CANDIDATES) -> DataFrame:
    """As ``search_vectors``, over the lists of each query's ``nprobe`` nearest clusters: recall may be below 1, similarities are exact.

    Queries go to the tasks in blocks, with the clusters they probe; only the folders of
    these clusters are read. A task keeps ``candidates * k`` rows per query by their
    quantised similarity before anything is shuffled; these alone meet ``vectors`` for the exact one.
    """
    centres, wanted = np.array(model.clusterCenters()), candidates * k
    lists = spark.read.schema("item_id long, norm double, step double, codes array<tinyint>, cluster int").parquet(path)
    n_blocks, found = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for b in range(n_blocks):
        block: dict[int, list] = {}
        for r in probes_of(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b), model, nprobe).collect():
            block.setdefault(r.cluster, []).append((r.query_id, r.vector))
        held = spark.sparkContext.broadcast({c: (np.array([q for q, _ in rows], np.int64), np.array([v for _, v in rows], float)) for c, rows in block.items()})
        part = lists.where(F.col("cluster").isin(sorted(block))).mapInArrow(_list_scorer(held, centres, wanted), HITS)
        found = part if found is None else found.unionByName(part)
    best = ranked(found, ["query_id"]).where(F.col("rank") <= wanted).select("query_id", "item_id")
    pairs = best.join(vectors.select("item_id", "vector"), "item_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
    hits = pairs.select("query_id", "item_id", F.round(cosine_similarity(F.col("_q"), F.col("vector")), DIGITS).alias("similarity"))
    return ranked(hits, ["query_id"]).where(F.col("rank") <= k)


def _list_scorer(held, centres, wanted):
    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            items, norms, steps = (batch.column(c).to_numpy() for c in (0, 1, 2))
            clusters, codes = batch.column(4).to_numpy(), batch.column(3).flatten().to_numpy().reshape(len(batch), -1) if len(batch) else None
            for c in np.unique(clusters).tolist():
                rows = np.flatnonzero(clusters == c)
                ids, queries = held.value[c]
                near = codes[rows] * steps[rows, None] + centres[c]
                lengths = np.sqrt((queries * queries).sum(1))[:, None] * norms[rows]
                sims = np.divide(queries @ near.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
                for q, s in zip(ids.tolist(), sims, strict=True):
                    old = best.get(q, (np.empty(0), np.empty(0, np.int64)))
                    s, i = np.concatenate([old[0], s]), np.concatenate([old[1], items[rows]])
                    order = np.lexsort((i, -s))[:wanted]
                    best[q] = s[order], i[order]
        for q, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q, np.int64)), pa.array(i), pa.array(s)], names=["query_id", "item_id", "similarity"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id and the share of its exact hits that were found."""
    met = exact.select("query_id", "item_id").join(found.select("query_id", "item_id").withColumn("_found", F.lit(1)), ["query_id", "item_id"], "left")
    return met.groupBy("query_id").agg((F.count("_found") / F.count("*")).alias("recall"))
