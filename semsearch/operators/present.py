"""From hits to what is shown: formatted hits, facets, prompts, answers, reports, traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T
from ..scratch import scratch_path
from .documents import build_documents
from .embed import Embedder, embed_documents
from .search import search_vectors

#: Hits that are sent to the tasks that hold the items; with more, items are shuffled.
HITS_BROADCAST = 100_000


def format_hits(hits: DataFrame) -> DataFrame:
    """Hits (query_id, query, rank, content, …) as shown: sections of the content, plain description, snippet."""
    content = F.col("content")
    return hits.select(
        "query_id", "rank", F.col("item_id").alias("id"), T.extract_title(content).alias("title"), T.strip_tags(T.extract_description(content)).alias("description"),
        T.extract_metadata(content).alias("metadata"), T.snippet(content, F.col("query")).alias("snippet"), "permalink", F.col("collection_name").alias("collection"),
        "collection_id", "similarity", "score",
    )


def facet_counts(hits: DataFrame, facets: dict[str, str]) -> DataFrame:
    """query_id, facet, value, n, shown for hits with a column per facet.

    Collection and year are shown with more than one value, and nothing of a query
    whose hits are of one collection; type is counted only.
    """
    named = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in facets.items()))
    counts = hits.select("query_id", F.explode(named).alias("f")).select("query_id", "f.*").where(~T.is_blank(F.col("value"))).groupBy("query_id", "facet", "value").agg(F.count("*").alias("n"))
    values = counts.groupBy("query_id", "facet").agg(F.count("*").alias("_values"))
    collections = values.where("facet = 'collection'").select("query_id", F.col("_values").alias("_collections"))
    shown = F.col("facet").isin("collection", "year") & (F.col("_values") > 1) & (F.coalesce("_collections", F.lit(0)) > 1)
    return counts.join(values, ["query_id", "facet"]).join(collections, "query_id", "left").select("query_id", "facet", "value", "n", shown.alias("shown"))


def apply_facets(hits: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Hits with ``visible``: of a chosen value in every facet that has one."""
    visible = F.lit(True)
    for column, values in chosen.items():
        if values:
            visible = visible & F.coalesce(F.col(column).cast("string").isin(values), F.lit(False))
    return hits.withColumn("visible", visible)


def visible_counts(hits: DataFrame) -> DataFrame:
    """query_id with how many of its hits are visible."""
    return hits.groupBy("query_id").agg(F.count_if("visible").alias("visible"), F.count("*").alias("total"))


def build_prompts(formatted: DataFrame, queries: DataFrame, config: Config = DEFAULT, words: int = 100) -> DataFrame:
    """query_id, system, user_prompt: every query with its hits in rank order as context; also without hits."""
    entries = F.array_sort(F.map_entries("metadata"))
    meta = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    block = F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title"), F.concat(F.lit("Collection: "), "collection"),
        F.when(F.col("description") != "", F.concat(F.lit("Description: "), T.trim_words(F.col("description"), words))), F.when(meta != "", F.concat(F.lit("Metadata: "), meta)),
        F.concat(F.lit("Link: "), "permalink"),
    )
    blocks = formatted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_b"))
    context = F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n")
    joined = queries.select("query_id", "query").join(blocks, "query_id", "left")
    user = F.concat(F.lit("Items:\n\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), "query")
    return joined.select("query_id", F.lit(config.system_prompt).alias("system"), user.alias("user_prompt"))


def answer_queries(prompts: DataFrame, answer: Callable[[list[str], list[str]], list[str]]) -> DataFrame:
    """Prompts with an answer each, from a function of (system texts, user texts) that is called on batches."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            answers = answer(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], names=["query_id", "response"])

    return prompts.select("query_id", "system", "user_prompt").mapInArrow(run, "query_id long, response string")


def extractive_answers(formatted: DataFrame, queries: DataFrame) -> DataFrame:
    """The best hit's snippet for every query; empty without hits."""
    best = formatted.where("rank = 1").select("query_id", "snippet")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("snippet", F.lit("")).alias("response"))


def search_log(formatted: DataFrame, queries: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows for the log: query_id, query, response, items_used, collections_used (in order of rank), total_results."""
    hit = F.struct("rank", "id", "title", "collection", "collection_id", "permalink", "similarity", "score")
    used = formatted.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("items_used"))
    rows = queries.select("query_id", "query").join(responses, "query_id", "left").join(used, "query_id", "left")
    return rows.select(
        "query_id", "query", "response", "items_used", F.array_distinct(F.transform("items_used", lambda h: h["collection"])).alias("collections_used"),
        F.coalesce(F.size("items_used"), F.lit(0)).cast("long").alias("total_results"),
    )


def search(
    queries: DataFrame, items: DataFrame, vectors: DataFrame, k: int = 10, collection_ids: list[int] | None = None, embedder: Embedder | None = None,
    answer: Callable[[list[str], list[str]], list[str]] | None = None, config: Config = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """Answer ``queries`` (query_id, query): the formatted hits, and a row for the log of each query.

    Queries are embedded and compared with all ``vectors``; the hits meet their items'
    texts, and ``answer`` is given the prompts.  Without it the best snippet is the
    answer.  A query without hits has a row without items.
    """
    asked = embed_documents(queries.select("query_id", F.coalesce("query", F.lit("")).alias("query")), "query", embedder)
    path = scratch_path(queries.sparkSession, "search-hits")
    search_vectors(vectors, asked.select("query_id", "vector"), k, collection_ids).write.parquet(path)
    hits = queries.sparkSession.read.parquet(path)
    named = hits.join(queries.select("query_id", "query"), "query_id")
    named = F.broadcast(named) if hits.limit(HITS_BROADCAST + 1).count() <= HITS_BROADCAST else named  # or texts are shuffled
    texts = build_documents(items, "block", config).select("item_id", "content", "collection_id", "collection_name", F.col("url").alias("permalink"))
    formatted = format_hits(texts.join(named, "item_id"))
    responses = answer_queries(build_prompts(formatted, queries, config), answer) if answer else extractive_answers(formatted, queries)
    return formatted, search_log(formatted, queries, responses)


def selected_marks(collections: DataFrame, selected: DataFrame) -> DataFrame:
    """``collections`` with ``selected``: whether their id is among ``selected`` (collection_id)."""
    ids = selected.select(F.col("collection_id").alias("id")).distinct().withColumn("_there", F.lit(True))
    return collections.join(ids, "id", "left").withColumn("selected", F.coalesce("_there", F.lit(False))).drop("_there")


def ranked_report(hits: DataFrame) -> DataFrame:
    """query_id, rank, title, collection, score as percent text, url."""
    return hits.select("query_id", "rank", "title", F.col("collection_name").alias("collection"), F.concat(F.format_number("score", 1), F.lit("%")).alias("score"), F.col("permalink").alias("url"))


def trace_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "item_id", F.col("collection_name").alias("collection"), "score", F.round("similarity", 4).alias("similarity"))


def search_trace(queries: DataFrame, vectors: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id with counts per step: vectors and collections available, hits found."""
    there = vectors.agg(F.count("*").alias("vectors"), F.count_distinct("collection_id").alias("collections")).withColumn("_one", F.lit(1))  # one row
    found = hits.groupBy("query_id").agg(F.count("*").alias("_hits"))
    return queries.select("query_id", F.lit(1).alias("_one")).join(F.broadcast(there), "_one").join(found, "query_id", "left").select("query_id", "vectors", "collections", F.coalesce("_hits", F.lit(0)).alias("hits"))
