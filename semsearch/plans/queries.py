"""Registered queries of the library's operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.vectors import cosine_similarity
from ..operators import documents as D
from ..operators import embed as E
from ..operators import history as H
from ..operators import index as X
from ..operators import present as P
from ..operators import runs as R
from ..operators import search as S
from ..operators import training as TR
from ..scratch import scratch_path
from ..sources import export, ingest
from ..streaming import stream
from . import upkeep
from . import views as V

LONG = "long"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "item_id", F.col("rank").cast(LONG).alias("rank"), F.round("similarity", 6).alias("similarity"), "score")


def _one(df: DataFrame) -> DataFrame:
    return df.select("item_id", F.col("rank").cast(LONG).alias("rank"), F.round("similarity", 6).alias("similarity"), "score")


def _query(spark, d, item_id=0) -> list[float]:
    """The vector that a single search asks for."""
    row = V.vectors(spark, d).where(F.col("item_id") == item_id).select("vector").first()
    return list(row.vector)


def _with_content(spark, d, hits: DataFrame) -> DataFrame:
    """Hits with the text, collection and link of their item."""
    docs = D.build_documents(V.items(spark, d)).select("item_id", "content", "collection_id", "collection_name", "m_type", "m_year", F.col("url").alias("permalink"))
    return hits.join(docs, "item_id")


def _top(spark, d, k=5) -> DataFrame:
    return S.search_vectors(V.vectors(spark, d), V.query_vectors(spark, d), k)


def _described(spark, d, k=5) -> DataFrame:
    """Hits of the vector search with the columns that the vector table has."""
    v = V.vectors(spark, d).select("item_id", "collection_id", "collection_name", "permalink")
    return _top(spark, d, k).join(v, "item_id").withColumn("title", F.concat(F.lit("Item "), F.col("item_id").cast("string")))


def _asked(spark, d) -> DataFrame:
    """Each item with the first three words of one of the benchmark texts as its query."""
    b = V.table(spark, d, "benchmark").select((F.col("item_id") % 40).alias("_b"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))
    b = b.groupBy("_b").agg(F.min("query").alias("query"))
    return V.items(spark, d).withColumn("_b", F.col("item_id") % 40).join(b, "_b")


def topk_single(spark, d):
    return _one(S.search_vector(V.vectors(spark, d), _query(spark, d), 10))


def topk_multi(spark, d):
    return _hits(_top(spark, d, 10))


def topk_filtered(spark, d):
    return _one(S.search_vector(V.vectors(spark, d), _query(spark, d), 10, [1, 2, 3]))


def topk_candidate_cap(spark, d):
    return _one(S.search_vector(V.vectors(spark, d), _query(spark, d), 10, candidate_cap=30))


def cosine_all(spark, d):
    """Every vector against the centre of its collection."""
    v = V.vectors(spark, d)
    parts = v.select("collection_id", F.posexplode("vector").alias("i", "x")).groupBy("collection_id", "i").agg(F.avg("x").alias("x"))
    centres = parts.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("collection_id", F.transform("c", lambda c: c["x"]).alias("centre"))
    return v.join(centres, "collection_id").select("item_id", F.round(cosine_similarity(F.col("centre"), F.col("vector")), 6).alias("similarity"))


def trace_hits(spark, d):
    return P.trace_hits(_described(spark, d))


def search_trace(spark, d):
    t = P.search_trace(V.query_vectors(spark, d), V.vectors(spark, d), _top(spark, d))
    return t.select("query_id", "vectors", "collections", "hits")


def ranked_report(spark, d):
    return P.ranked_report(_described(spark, d)).withColumn("rank", F.col("rank").cast(LONG))


def _document_query(layout, config=Config()):
    return lambda spark, d: D.build_documents(V.items(spark, d), layout, config).select("item_id", "content")


def truncate_text(spark, d):
    return D.truncated(D.build_documents(V.items(spark, d), "inline")).select("item_id", "content")


def extract_sections(spark, d):
    s = D.sections(D.build_documents(V.items(spark, d)))
    entries = F.array_sort(F.map_entries("x_metadata"))
    return s.select("item_id", "x_title", "x_description", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("x_metadata"))


def strip_tags_pages(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


def snippets(spark, d):
    return _asked(spark, d).select("item_id", T.snippet(F.col("description"), F.col("query")).alias("snippet"))


def hash_embed(spark, d):
    e = E.embed_documents(V.items(spark, d).select("item_id", "description"), "description", E.HashEmbedder(16))
    return e.select("item_id", F.array_join(F.transform("vector", lambda x: F.round(x * 10000).cast(LONG).cast("string")), " ").alias("vector"))


def semantic_search(spark, d):
    """Items by the similarity of their hashed embedding to every benchmark text."""
    items = E.embed_documents(V.items(spark, d).select("item_id", "description"), "description", E.HashEmbedder(16))
    asked = E.embed_documents(V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", E.HashEmbedder(16))
    return _hits(S.search_vectors(items, asked.select("query_id", "vector"), 10))


def _facets(spark, d):
    hits = _with_content(spark, d, _top(spark, d, 10))
    return hits.select("query_id", "item_id", "collection_name", "m_year", "m_type")


def facet_counts(spark, d):
    return P.facet_counts(_facets(spark, d), {"collection": "collection_name", "year": "m_year", "type": "m_type"})


def facet_filter(spark, d):
    return P.visible_counts(P.apply_facets(_facets(spark, d), {"m_type": ["en", "de"], "collection_name": [f"src{k}" for k in range(10)]}))


def _formatted(spark, d, k=3):
    asked = V.query_vectors(spark, d).select("query_id").withColumn("query", F.concat(F.lit("the of item "), F.col("query_id").cast("string")))
    hits = _with_content(spark, d, _top(spark, d, k)).join(asked, "query_id")
    return P.format_hits(hits), asked


def format_hits(spark, d):
    f, _ = _formatted(spark, d)
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return f.select("query_id", F.col("rank").cast(LONG).alias("rank"), "id", "title", meta.alias("metadata"), "snippet", "collection", "score")


def build_prompts(spark, d):
    f, asked = _formatted(spark, d)
    return P.build_prompts(f, asked, words=20)


def search_log(spark, d):
    f, asked = _formatted(spark, d)
    log = P.search_log(f, asked, P.extractive_answers(f, asked))
    return log.select("query_id", "query", "response", F.array_join(F.transform("items_used", lambda h: h["id"].cast("string")), ",").alias("items"), F.array_join("collections_used", ",").alias("collections"), "total_results")


def total_vectors(spark, d):
    return X.total_vectors(V.vectors(spark, d))


def vectors_by_collection(spark, d):
    return X.vectors_by_collection(V.vectors(spark, d))


def collection_stats(spark, d):
    return X.collection_stats(V.vectors(spark, d))


def index_health(spark, d):
    return X.index_health(V.vectors(spark, d), V.collections(spark, d))


def index_coverage(spark, d):
    return X.index_coverage(V.collections(spark, d), V.vectors(spark, d))


def enabled_collections(spark, d):
    chosen = V.collections(spark, d).where("enabled").select("id")
    return V.collections(spark, d).join(chosen, "id", "left_semi").select("id", "name", "items_count")


def resolve_collections(spark, d):
    """Each user asks for the collections of their events; those not enabled are left out."""
    asked = V.table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("user_id") % 7).alias("collection_id")).distinct()
    return S.resolve_collections(asked, V.collections(spark, d))


def pending_items(spark, d):
    items = V.items(spark, d).withColumn("collection_id", F.col("item_id") % 10)
    have = V.vectors(spark, d).withColumn("collection_id", F.col("item_id") % 10)
    return X.pending_items(items, have).select("item_id", "collection_id")


def _new_vectors(spark, d):
    """The vectors two ids on, twice, the second time with another name."""
    v = V.vectors(spark, d).select((F.col("item_id") * 2).alias("item_id"), "collection_id", "collection_name", "permalink")
    v = v.withColumn("seq", F.lit(1))
    return v.unionByName(v.withColumn("collection_name", F.concat(F.lit("new "), "collection_name")).withColumn("seq", F.lit(2)))


def upsert_vectors(spark, d):
    old = V.vectors(spark, d).select("item_id", "collection_id", "collection_name", "permalink")
    return X.upsert_vectors(old, _new_vectors(spark, d), order="seq")


def remove_orphans(spark, d):
    valid = V.items(spark, d).select("item_id", (F.col("item_id") % 10).alias("collection_id"))
    return X.remove_orphans(V.vectors(spark, d), valid).select("item_id", "collection_id")


def delete_collections(spark, d):
    return X.delete_collections(V.vectors(spark, d), [1, 2]).select("item_id", "collection_id")


def _own_items(spark, d):
    """Items and the vectors of some of them, both with the id's last digit as collection."""
    items = V.items(spark, d).withColumn("collection_id", F.col("item_id") % 10)
    v = V.vectors(spark, d).select("item_id", (F.col("item_id") % 10).alias("collection_id"), "collection_name", F.lit(None).cast("string").alias("content"), "permalink")
    return items, v.withColumns({"vector": F.array(F.lit(1.0)), "norm": F.lit(1.0), "last_updated": F.current_timestamp()})


def index_items(spark, d):
    """Every item's outcome when those without a vector are indexed, with what its new vector row holds."""
    items, have = _own_items(spark, d)
    after, outcomes = X.index_collections(items, have, E.HashEmbedder(16))
    rows = after.select("item_id", "collection_id", F.length("content").cast(LONG).alias("chars"), F.round("norm", 6).alias("norm"))
    return outcomes.join(rows, X.KEY, "left").select("item_id", "collection_id", "outcome", "chars", "norm")


def item_exists(spark, d):
    items, have = _own_items(spark, d)
    return X.with_vector(items, have).select("item_id", "collection_id", "indexed")


def outcome_counts(spark, d):
    have = V.vectors(spark, d).select("item_id", F.lit(True).alias("there"))
    outcome = F.when(F.col("there"), "skipped").when(F.col("description") == "", "failed").otherwise("indexed")
    return X.outcome_counts(V.items(spark, d).join(have, "item_id", "left").select("collection_id", outcome.alias("outcome")))


def apply_changes(spark, d):
    c = V.changes(spark, d)
    state = X.apply_changes(c.limit(0), c.where("seq % 3 <> 1"))  # the changes of two thirds first, later ones among them
    return X.live_items(X.apply_changes(state, c.where("seq % 3 = 1"))).select("item_id", "seq", "op", F.round("value", 6).alias("value"))


def embedding_batches(spark, d):
    docs = D.build_documents(V.items(spark, d))
    return E.assign_embedding_batches(docs).select("item_id", F.col("bucket").cast(LONG).alias("bucket"), F.col("batch").cast(LONG).alias("batch"), "tokens")


def item_pages(spark, d):
    return E.item_pages(V.items(spark, d))


def browser_pages(spark, d):
    return E.item_pages(V.items(spark, d), rule="browser")


def search_history(spark, d):
    return H.search_history(V.history(spark, d), "2024-01-05", "2024-01-20", collection="c3", search="PURCHASE", feedback=1).select("id", "created_at", "user_id", "query")


def history_page(spark, d):
    return H.history_page(V.history(spark, d), 50, 100).select("id", "created_at", "query", T.feedback_label(F.col("feedback")).alias("feedback"))


def search_detail(spark, d):
    return H.search_detail(V.history(spark, d), 5).select("id", "query", "collection")


def _stats(period):
    return lambda spark, d: H.search_stats(V.history(spark, d), period)


def recent_periods(spark, d):
    return H.search_stats(V.history(spark, d), "day", 7)


def top_collections(spark, d):
    return H.top_collections(V.history(spark, d))


def top_collections_prelimit(spark, d):
    return H.top_collections(V.history(spark, d), pre_limit=10)


def dashboard_kpis(spark, d):
    return H.dashboard_kpis(V.history(spark, d), "2024-01-01", "2024-01-30")


def latest_search_ids(spark, d):
    return H.latest_search_ids(V.history(spark, d))


def apply_feedback(spark, d):
    h = V.history(spark, d).withColumn("feedback_notes", F.lit(None).cast("string"))
    events = V.table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("id"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).cast("int").alias("feedback"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("feedback_notes"))
    return H.apply_feedback(h, events).select("id", "feedback", "feedback_notes")


def client_address(spark, d):
    e = V.table(spark, d, "events")
    text = lambda c: c.cast("string")
    client = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0.0."), text(F.col("user_id")))).otherwise("")
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.0.1."), text(F.col("user_id"))))
    return e.select(F.col("event_id").alias("id"), T.client_address(client, forwarded, F.concat(F.lit("10.0.2."), text(F.col("user_id")))).alias("address"))


def training_kpis(spark, d):
    return TR.training_kpis(V.training_pairs(spark, d))


def fine_tuning_examples(spark, d):
    return TR.fine_tuning_examples(V.training_pairs(spark, d))


def trim_words(spark, d):
    return V.items(spark, d).select("item_id", T.trim_words(F.col("description"), 12).alias("text"))


def id_lists(spark, d):
    text = F.concat_ws(", ", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return V.table(spark, d, "documents").select("doc_id", F.aggregate(T.id_list(text), F.lit(0).cast(LONG), lambda a, x: a + x).alias("total"))


def content_previews(spark, d):
    return V.items(spark, d).select("item_id", T.preview(F.col("description")).alias("preview"))


def run_totals(spark, d):
    return R.run_totals(V.runs(spark, d))


def latest_runs(spark, d):
    return R.latest_runs(V.runs(spark, d), "run_day")


def prune_runs(spark, d):
    r = V.runs(spark, d).withColumns({"status": F.when(F.col("failed") > 0, "processing").otherwise("completed"), "last_update": F.col("run_day")})
    return R.prune_runs(r, F.lit("2024-01-20").cast("date")).select("collection_id", "run_day", "status")


def last_errors(spark, d):
    e = V.table(spark, d, "events").where("event_type = 'error'")
    return R.last_errors(e.select((F.col("user_id") % 10).alias("collection_id"), F.col("event_id").alias("seq"))).select("collection_id", "seq", F.col("place").cast(LONG).alias("place"))


def log_levels(spark, d):
    return ingest.log_levels(V.log_lines(spark, d), "[app]").groupBy("level").agg(F.count("*").alias("n"))


def log_tail(spark, d):
    return ingest.log_tail(V.log_lines(spark, d), "[app]").select("line_no", "value", "level")


def item_metadata(spark, d):
    """Item pages built from the items and flattened again, with a repeated and a nameless entry."""
    entry = lambda n, v: F.struct(n.alias("name"), v.alias("value_as_string"))
    meta = F.array(entry(F.lit("type"), F.lit("old")), entry(F.lit("type"), F.col("m_type")), entry(F.lit(None).cast("string"), F.lit("x")), entry(F.lit("year"), F.col("m_year")))
    item = F.struct(F.col("item_id").alias("id"), "title", "description", "url", meta.alias("metadata"))
    pages = V.items(spark, d).groupBy("collection_id", F.floor(F.col("item_id") / 50).alias("page")).agg(F.collect_list(item).alias("items"))
    return ingest.flat_items(pages).select("item_id", "collection_id", "title", F.col("metadata")["type"].alias("m_type"), F.col("metadata")["year"].alias("m_year"), F.size("metadata").cast(LONG).alias("entries"))


def search_ivf(spark, d):
    v = V.vectors(spark, d)
    model, path = S.fit_clusters(v, 16), scratch_path(spark, "lists")
    S.build_lists(v, model, path)
    return _hits(S.search_lists(spark, path, v, V.query_vectors(spark, d), model, 10, 12))


def inverted_lists(spark, d):
    """Each query's best hit from the lists, and whether 12 of 16 lists found nine tenths of all exact hits."""
    found = search_ivf(spark, d)
    mean = S.recall(found, _top(spark, d, 10)).agg((F.avg("recall") >= 0.9).alias("reached"))
    return found.where("rank = 1").select("query_id", "item_id", "similarity", F.lit(1).alias("_one")).join(F.broadcast(mean.withColumn("_one", F.lit(1))), "_one").drop("_one")  # mean is one row


def composed_search(spark, d):
    """Every benchmark text asked of all items: the log's row of each."""
    items = V.items(spark, d)
    vectors = E.embed_documents(items.select("item_id", "collection_id", "description"), "description", E.HashEmbedder(16))
    asked = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    _, log = P.search(asked, items, vectors, 5, embedder=E.HashEmbedder(16))
    return log.select("query_id", "query", F.array_join(F.transform("items_used", lambda h: h["id"].cast("string")), ",").alias("items"), "total_results")


def selected_collections(spark, d):
    chosen = V.table(spark, d, "events").where("event_type = 'error'").select((F.col("user_id") % 5).alias("collection_id"))
    return P.selected_marks(V.collections(spark, d), chosen).select("id", "name", "selected")


def history_of_user(spark, d):
    return H.search_history(V.history(spark, d), user_id=5).select("id", "query")


def history_without_accents(spark, d):
    h = V.history(spark, d).withColumn("query", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Coleção "), "query")).otherwise(F.concat(F.lit("colecao "), "query")))
    return H.search_history(h, search="COLEÇAO view", accents=False).select("id", "query")


def history_last_days(spark, d):
    return H.last_days(V.history(spark, d), 7, "2024-01-20").select("id", "created_at")


def history_items(spark, d):
    h = V.history(spark, d).withColumn("items_used", F.when(F.col("feedback").isNotNull(), F.col("collections_used")))
    return H.items_per_search(h).select("id", F.col("n_items").cast(LONG).alias("n_items"))


def catalogue(spark, d):
    """Collections written as a JSON catalogue with some values left out, and read again."""
    path = scratch_path(spark, "catalogue")
    entry = F.struct("id", "name", F.when(F.col("id") % 2 == 0, F.col("items_count")).alias("items_count"))
    pages = V.collections(spark, d).groupBy((F.col("id") % 4).alias("page")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return ingest.read_collections(spark, path)


def one_collection(spark, d):
    return ingest.get_collection(V.collections(spark, d), 3).select("id", "name", "items_count")


def read_items(spark, d):
    """Item pages written as JSON lines of each collection, and read again; a file a page would be a million files at a few GB."""
    path = scratch_path(spark, "item-pages")
    meta = F.array(F.struct(F.lit("type").alias("name"), F.col("m_type").alias("value_as_string")))
    item = F.struct(F.col("item_id").alias("id"), "title", "description", "url", meta.alias("metadata"))
    pages = V.items(spark, d).groupBy("collection_id", F.floor(F.col("item_id") / 50).alias("page")).agg(F.collect_list(item).alias("items"))
    pages.select("collection_id", "items").write.partitionBy("collection_id").json(path)
    return ingest.read_items(spark, path, lines=True).select("item_id", "collection_id", "title", F.length("description").cast(LONG).alias("chars"), F.col("metadata")["type"].alias("m_type"))


def metadata_defs(spark, d):
    path = scratch_path(spark, "metadata-defs")
    fields = V.items(spark, d).select("collection_id", F.explode(F.array(F.lit("type"), F.lit("year"))).alias("name")).distinct()
    defs = fields.select("collection_id", F.when(F.col("name") == "type", 1).otherwise(2).cast(LONG).alias("id"), "name", F.lit("text").alias("metadata_type"))
    defs.repartition("collection_id").write.partitionBy("collection_id").json(path)
    return ingest.read_metadata_defs(spark, path, lines=True).select("collection_id", "id", "name", "type", "description")


def exported_index(spark, d):
    """The vector table exported as CSV, its vectors as JSON text, and decoded again."""
    path = scratch_path(spark, "index-csv")
    export.export_index(V.vectors(spark, d).select("item_id", "collection_name", "vector"), path, "csv")
    back = spark.read.schema("item_id long, collection_name string, vector string").option("header", True).option("escape", '"').csv(path)
    digits = F.transform("vector", lambda x: F.round(x * 1000).cast(LONG).cast("string"))
    return ingest.decode_vectors(back).select("item_id", "collection_name", F.array_join(digits, " ").alias("vector"))


def exported_history(spark, d):
    """The log exported as JSON and as CSV, both read back; lists are decoded from the text of the latter."""
    h = V.history(spark, d).select("id", "query", "collections_used", "feedback")
    js, csv = scratch_path(spark, "history-json"), scratch_path(spark, "history-csv")
    export.export_history(h, js)
    export.export_history(h, csv, "csv")
    a = spark.read.schema("id long, query string, feedback int").json(js)
    b = ingest.decode_list(spark.read.schema("id long, query string, collections_used string, feedback int").option("header", True).option("escape", '"').csv(csv), "collections_used")
    return a.join(b.select("id", F.array_join(F.array_sort("collections_used"), ",").alias("collections")), "id")


def exported_examples(spark, d):
    path = scratch_path(spark, "examples")
    export.export_examples(TR.fine_tuning_examples(V.training_pairs(spark, d)), path)
    return spark.read.text(path)


def appended_history(spark, d):
    """Searches appended to the log in two parts; days are found again by their folders."""
    path = scratch_path(spark, "history-days")
    h = V.history(spark, d).select("id", "created_at")
    for k in range(2):
        export.append_history(h.where(F.col("id") % 2 == k), path)
    return H.search_history(spark.read.parquet(path), "2024-01-05", "2024-01-20").select("id", "created_at", "created_date")


def config_row(spark, d):
    """The settings as exported, with the number of collections they apply to."""
    n = V.collections(spark, d).agg(F.count("*").alias("collections"))
    c = export.config_table(spark)
    return n.crossJoin(F.broadcast(c)).select("collections", F.col("max_items").cast(LONG).alias("max_items"), F.col("chunk_size").cast(LONG).alias("chunk_size"))  # one row each


def snapshot(spark, d):
    """Two snapshots of the vector table, of which the newer one is read."""
    root = scratch_path(spark, "snapshots")
    v = V.vectors(spark, d).select("item_id", "collection_id", "collection_name")
    X.write_snapshot(v.limit(0), root, "a")
    X.write_snapshot(v, root, "b")
    return X.read_snapshot(spark, root).select("item_id", F.col("collection_id").cast(LONG).alias("collection_id"), "collection_name")


def stream_search_counts(spark, d):
    """The log as a stream of files; equal to the counts per day once the watermark has passed."""
    root = scratch_path(spark, "stream")
    h = V.history(spark, d).select("id", "created_at")
    h.write.parquet(f"{root}/in")
    # a last search far ahead lets the watermark pass all days
    last = h.agg(F.max("created_at").alias("m")).select(F.lit(-1).cast(LONG).alias("id"), (F.col("m") + F.expr("INTERVAL 10 DAYS")).alias("created_at"))
    source = spark.readStream.schema(h.schema).parquet(f"{root}/in")

    def run():
        q = stream.stream_search_counts(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    last.write.mode("append").parquet(f"{root}/in")
    run()
    return spark.read.schema("day date, total long").parquet(f"{root}/out")


def stream_index(spark, d):
    """Changes as a stream of files in four micro-batches; equal to applying them at once."""
    root = scratch_path(spark, "stream")
    c = V.changes(spark, d)
    c.repartitionByRange(4, "seq").write.parquet(f"{root}/in")
    source = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream.stream_index(source, f"{root}/state", f"{root}/checkpoint", 16).awaitTermination()
    state = stream.state_table(spark, f"{root}/state", c.schema, 16).read()
    return X.live_items(state).select("item_id", "seq", "op", F.round("value", 6).alias("value"))


def queries() -> dict:
    custom = Config(index_fields=("title", "metadata", "m_type", "m_year"))
    named = [
        topk_single, topk_multi, topk_filtered, topk_candidate_cap, cosine_all, trace_hits, search_trace, ranked_report, truncate_text, extract_sections, strip_tags_pages,
        snippets, hash_embed, semantic_search, facet_counts, facet_filter, format_hits, build_prompts, search_log, total_vectors, vectors_by_collection, collection_stats,
        index_health, index_coverage, enabled_collections, resolve_collections, pending_items, upsert_vectors, remove_orphans, delete_collections, index_items, outcome_counts,
        apply_changes, embedding_batches, item_pages, search_history, history_page, search_detail, recent_periods, top_collections, top_collections_prelimit, dashboard_kpis,
        latest_search_ids, apply_feedback, client_address, training_kpis, fine_tuning_examples, trim_words, id_lists, content_previews, run_totals, latest_runs, prune_runs,
        last_errors, log_levels, log_tail, item_metadata, search_ivf, inverted_lists, stream_search_counts, stream_index, item_exists, browser_pages, composed_search, selected_collections,
        history_of_user, history_without_accents, history_last_days, history_items, catalogue, one_collection, read_items, metadata_defs, exported_index, exported_history,
        exported_examples, appended_history, config_row, snapshot,
    ]
    found = {f.__name__: f for f in named}
    found |= {"documents_block": _document_query("block"), "documents_inline": _document_query("inline"), "documents_custom_fields": _document_query("inline", custom)}
    return found | {f"search_stats_{p}": _stats(p) for p in ("day", "week", "month")} | upkeep.queries()
