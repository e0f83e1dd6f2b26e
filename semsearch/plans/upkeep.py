"""Registered queries of upkeep: runs, buckets, streams and the log, with their DuckDB SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import embed as E
from ..operators import facets, pages, sketches, textindex
from ..operators import history as H
from ..operators import index as X
from ..operators import runs as R
from ..operators.buckets import BucketTable
from ..scratch import scratch_path
from ..sources import export, ingest, tail
from ..sources.ingest import ITEM_PAGE
from ..streaming import indexing, stream
from . import views as V
from .views import sql

LONG = "long"


def _append(stream_df: DataFrame, root: str) -> None:
    """Write all there is of a stream to files and stop."""
    writer = stream_df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the time of a stream."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _page_items(spark, d) -> DataFrame:
    """Items with the id's last digit as collection; every eleventh has no text of its own."""
    items = V.items(spark, d).withColumn("collection_id", F.col("item_id") % 10)
    without = F.col("item_id") % 11 == 0
    return items.withColumns({c: F.when(without, "").otherwise(F.col(c)) for c in ("title", "description")}).withColumn("m_type", F.when(~without, F.col("m_type")))


def indexing_run(spark, d):
    """Pages of items indexed by a stream that is stopped halfway and started again: the run of each collection.

    A third of the items has a vector from before.
    """
    root = scratch_path(spark, "indexing-run")
    items = _page_items(spark, d)
    entry = F.struct(F.lit("type").alias("name"), F.col("m_type").alias("value_as_string"))
    item = F.struct(F.col("item_id").alias("id"), "title", "description", "url", F.array(entry).alias("metadata"))
    made = items.groupBy("collection_id", F.floor(F.col("item_id") / 500).alias("page")).agg(F.collect_list(item).alias("items"))
    made.write.parquet(f"{root}/all")
    made = spark.read.parquet(f"{root}/all")
    have = items.where("item_id % 3 = 0").select("item_id", "collection_id", "collection_name").withColumns({"vector": F.array(F.lit(1.0)), "norm": F.lit(1.0), "last_updated": F.current_timestamp()})
    indexing.vector_table(spark, root, 16).change(have.withColumns({c: F.lit(None).cast("string") for c in ("content", "permalink")}), "before", indexing.put_vectors)
    for half in (0, 1):
        made.where(F.pmod(F.col("page") + F.col("collection_id"), F.lit(2)) == half).select("items", "collection_id").coalesce(1).write.mode("append").parquet(f"{root}/pages")
        source = spark.readStream.schema(ITEM_PAGE + ", collection_id long").parquet(f"{root}/pages")
        indexing.stream_indexing(source, root, f"{root}/checkpoint", embedder=E.HashEmbedder(16), buckets=16).awaitTermination()
    totals = items.groupBy("collection_id").agg(F.count("*").alias("total"))
    summary = indexing.run_summary(indexing.run_rows(spark, root), totals)
    vectors = indexing.vector_table(spark, root, 16).read().groupBy("collection_id").agg(F.count("*").alias("vectors"))
    return summary.join(vectors, "collection_id", "left").select("collection_id", "total", "processed", "indexed", "skipped", "failed", "progress", "status", "vectors")


def run_transitions(spark, d):
    return R.run_transitions(V.run_events(spark, d)).select("collection_id", "seq", "event", "accepted", F.col("run").cast(LONG).alias("run"), "status")


def run_states(spark, d):
    return R.run_states(R.run_transitions(V.run_events(spark, d))).withColumn("run", F.col("run").cast(LONG))


def stream_run_transitions(spark, d):
    """The events of runs as a stream of files, each with events of all days; equal to judging them at once."""
    root = scratch_path(spark, "run-events")
    events = V.run_events(spark, d)
    events.repartition(3, F.xxhash64("seq")).write.parquet(f"{root}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    # an event far ahead lets the watermark pass all others
    ahead = events.agg(F.max("ts").alias("m")).select(F.lit(-1).cast(LONG).alias("collection_id"), (F.col("m") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(-1).cast(LONG).alias("seq"), F.lit("progress").alias("event"))
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        _append(stream.stream_run_transitions(source, "40 days"), root)
        ahead.write.mode("append").parquet(f"{root}/in")
        _append(stream.stream_run_transitions(source, "40 days"), root)
    judged = spark.read.schema("collection_id long, ts timestamp, seq long, event string, accepted boolean, run long, status string").parquet(f"{root}/out")
    return judged.select("collection_id", "seq", "event", "accepted", "run", "status")


def bucket_upsert(spark, d):
    """Vectors in buckets, and new rows of some put in; only their buckets are written again."""
    old = V.vectors(spark, d).select("item_id", "collection_id", "collection_name", "permalink")
    table = BucketTable(spark, scratch_path(spark, "buckets"), ("item_id", "collection_id"), old.schema, 32)
    table.change(old, 0, X.upsert_vectors)
    new = old.select((F.col("item_id") * 2).alias("item_id"), "collection_id", "collection_name", "permalink").withColumn("seq", F.lit(1))
    new = new.unionByName(new.withColumn("collection_name", F.concat(F.lit("new "), "collection_name")).withColumn("seq", F.lit(2)))
    table.change(new, 1, lambda rows, changed: X.upsert_vectors(rows, changed, order="seq"))
    return table.read()


def stream_feedback(spark, d):
    """Searches met by the feedback given within a week, both as streams of files."""
    root = scratch_path(spark, "feedback")
    h, f = V.history(spark, d).select("id", "created_at", "query"), V.feedback_events(spark, d)
    h.write.parquet(f"{root}/searches")
    f.write.parquet(f"{root}/feedback")
    searches, feedback = spark.readStream.schema(h.schema).parquet(f"{root}/searches"), spark.readStream.schema(f.schema).parquet(f"{root}/feedback")
    joined = stream.stream_feedback(searches, feedback, "7 days", "1 day")
    _append(joined, root)
    ahead = h.agg(F.max("created_at").alias("m")).select((F.col("m") + F.expr("INTERVAL 100 DAYS")).alias("at"))
    ahead.select(F.lit(-1).cast(LONG).alias("id"), F.col("at").alias("created_at"), F.lit("").alias("query")).write.mode("append").parquet(f"{root}/searches")
    ahead.select(F.lit(-2).cast(LONG).alias("id"), F.col("at").alias("given_at"), F.lit(0).cast(LONG).alias("seq"), F.lit(0).alias("feedback"), F.lit("").alias("feedback_notes")).write.mode("append").parquet(f"{root}/feedback")
    _append(joined, root)
    return spark.read.schema("id long, created_at timestamp, query string, feedback int, feedback_notes string").parquet(f"{root}/out").select("id", "query", "feedback", "feedback_notes")


def repeated_appends(spark, d):
    """Searches appended in two batches, the second of them twice; days are found again by their folders."""
    path, h = scratch_path(spark, "history-batches"), V.history(spark, d).select("id", "created_at")
    for k in (0, 1, 1):
        export.append_history(h.where(F.col("id") % 2 == k), path, k)
    return H.search_history(export.read_history(spark, path), "2024-01-05", "2024-01-20").select("id", "created_at", "created_date")


def stream_log(spark, d):
    """The log as a sink of a stream in which a third of the searches come twice."""
    root, h = scratch_path(spark, "log-stream"), V.history(spark, d).select("id", "created_at", "query")
    h.unionByName(h.where("id % 3 = 0")).write.parquet(f"{root}/in")
    source = spark.readStream.schema(h.schema).parquet(f"{root}/in")
    stream.append_searches(source, f"{root}/log", f"{root}/checkpoint", "40 days").awaitTermination()
    h.where("id % 5 = 0").write.mode("append").parquet(f"{root}/in")  # once more, in a later micro-batch
    stream.append_searches(source, f"{root}/log", f"{root}/checkpoint", "40 days").awaitTermination()
    return spark.read.parquet(f"{root}/log").select("id", "created_at", "query", "created_date")


def embedding_failures(spark, d):
    """Every item's batch, whether it has a vector, and the error: the embedder refuses the batches of two items."""

    def refuses(texts: list[str]):
        if any(t.startswith(("TÍTULO: Item 7 ", "TÍTULO: Item 150 ")) for t in texts):
            raise ValueError("refused")
        return E.HashEmbedder(16)(texts)

    docs = D.build_documents(V.items(spark, d)).select("item_id", "content")
    got = E.embed_in_batches(docs, embedder=refuses)
    return got.select("item_id", F.col("bucket").cast(LONG).alias("bucket"), F.col("batch").cast(LONG).alias("batch"), F.col("vector").isNotNull().alias("embedded"), "error")


def log_file_tail(spark, d):
    """The application log written as one file, and the last tagged lines of its last bytes."""
    path = scratch_path(spark, "app-log")
    lines = V.log_lines(spark, d)
    lines.withColumn("value", F.format_string("%09d %s", "line_no", "value")).repartitionByRange(1, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return ingest.log_tail(tail.read_tail(spark, path), "[app]").select("value", "level")


_SELECTED = {"type": ["en", "de"], "collection": [f"src{k}" for k in range(10)]}


def _facet_index(spark, d) -> DataFrame:
    return facets.facet_index(V.items(spark, d), {"collection": "collection_name", "year": "m_year", "type": "m_type"})


def _long_items(spark, d) -> DataFrame:
    """The hits that facets are counted over: all items of more than 500 characters."""
    return V.items(spark, d).where(F.length("description") > 500)


def facet_bitmaps(spark, d):
    """Facets of all hits that two chosen languages and ten collections leave."""
    index = _facet_index(spark, d)
    return facets.facet_totals(index, facets.visible(index, _long_items(spark, d), _SELECTED))


def visible_bitmaps(spark, d):
    index = _facet_index(spark, d)
    return facets.count_visible(facets.visible(index, _long_items(spark, d), _SELECTED))


def seek_page(spark, d):
    """The log sorted into files, and a page that reads only those it lies in."""
    path = scratch_path(spark, "sorted-log")
    pages.write_sorted_log(V.history(spark, d).select("id", "created_at", "query", "feedback"), path, 2_000)
    return pages.seek_page(spark, path, 50, 100).select("id", "created_at", "query")


def merged_statistics(spark, d):
    """Searches per collection over two weeks from counts and sketches per day, one day of them late; whether the estimates are within 5 %."""
    path, h = scratch_path(spark, "daily"), V.history(spark, d)
    late = F.to_date("created_at") == F.lit("2024-01-09").cast("date")
    sketches.put_days(sketches.daily_stats(h.where(~late | (F.col("id") % 2 == 0))), path)
    sketches.put_days(sketches.daily_stats(h.where(late)), path)
    merged = sketches.merged_stats(sketches.read_days(spark, path), "2024-01-05", "2024-01-18")
    exact = H.search_history(h, "2024-01-05", "2024-01-18").select(F.explode("collections_used").alias("collection"), "user_id", "query").groupBy("collection").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("query").alias("q"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b) + 1
    return merged.join(exact, "collection").select("collection", "searches", near("users", "u").alias("users_near"), near("queries", "q").alias("queries_near"))


def indexed_text_search(spark, d):
    """The log's texts found through their trigrams; queries carry the day of the month."""
    path = scratch_path(spark, "text-index")
    h = V.history(spark, d).withColumn("query", F.concat("query", F.lit(" on day "), F.dayofmonth("created_at").cast("string")))
    textindex.write_text_index(h.select("id", "created_at", "user_id", "query", "response"), path)
    return textindex.indexed_search(spark, path, "19 ON DAY 17").select("id", "user_id", "query")


def queries() -> dict:
    named = [indexed_text_search, log_file_tail, facet_bitmaps, visible_bitmaps, seek_page, merged_statistics, indexing_run, run_transitions, run_states, stream_run_transitions, bucket_upsert, stream_feedback, repeated_appends, stream_log, embedding_failures]
    return {f.__name__: f for f in named}


_BEFORE = "OVER (PARTITION BY collection_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "OVER (PARTITION BY collection_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
_TRANSITIONS = f""", m AS (SELECT *, CASE WHEN event IN ('start', 'complete', 'cancel') THEN event END AS move FROM run_events),
  b AS (SELECT *, coalesce(last_value(move IGNORE NULLS) {_BEFORE} = 'start', false) AS active FROM m),
  j AS (SELECT *, (event = 'start') <> active AS accepted FROM b),
  t AS (SELECT *, CAST(sum(CASE WHEN accepted AND event = 'start' THEN 1 ELSE 0 END) {_UPTO} AS BIGINT) AS run,
    coalesce(last_value(CASE WHEN accepted THEN CASE event WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'cancelled' ELSE 'processing' END END IGNORE NULLS) {_UPTO}, 'none') AS status FROM j)"""


_TAIL = """, l AS (SELECT line_no, concat(lpad(CAST(line_no AS VARCHAR), 9, '0'), ' ', value) AS value FROM log_lines),
  b AS (SELECT *, sum(strlen(value) + 1) OVER (ORDER BY line_no DESC) AS bytes, sum(strlen(value) + 1) OVER () AS total, row_number() OVER (ORDER BY line_no DESC) AS k FROM l)
  SELECT value, CASE WHEN contains(value, '[ERROR]') THEN 'error' WHEN contains(value, '[DEBUG]') THEN 'debug' ELSE 'none' END AS level FROM b
  WHERE (total <= 100000 OR bytes <= 50000) AND k <= 1000 AND contains(value, '[app]') ORDER BY line_no DESC LIMIT 50"""
_SHOWN = """, v AS (SELECT * FROM items WHERE length(description) > 500 AND m_type IN ('en', 'de') AND collection_name IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9'))"""


def oracle_sql(batches: str) -> dict[str, str]:
    """``batches`` is SQL of the batch that each item is embedded in."""
    transitions = sql(f"{_TRANSITIONS} SELECT collection_id, seq, event, accepted, run, status FROM t", "run_events")
    return {
        "log_file_tail": sql(_TAIL, "log_lines"),
        "facet_bitmaps": sql(
            f"""{_SHOWN} SELECT 'collection' AS facet, collection_name AS value, count(*) AS n FROM v GROUP BY 2
            UNION ALL SELECT 'year', m_year, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'type', m_type, count(*) FROM v GROUP BY 2""", "items"),
        "indexed_text_search": sql(
            """, q AS (SELECT id, user_id, concat(query, ' on day ', day(created_at)) AS query FROM history)
            SELECT id, user_id, query FROM q WHERE contains(lower(query), '19 on day 17')""", "history"),
        "visible_bitmaps": sql(f"{_SHOWN} SELECT count(*) AS visible FROM v", "items"),
        "seek_page": sql("SELECT id, created_at, query FROM history ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100", "history"),
        "merged_statistics": sql(
            """, c AS (SELECT unnest(collections_used) AS collection FROM history WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-19')
            SELECT collection, count(*) AS searches, true AS users_near, true AS queries_near FROM c GROUP BY 1""", "history"),
        "indexing_run": """WITH i AS (SELECT doc_id % 10 AS collection_id, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'indexed' END AS outcome FROM documents)
            SELECT collection_id, count(*) AS total, count(*) AS processed, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
            100.0::DOUBLE AS progress, 'completed' AS status, count(*) FILTER (outcome <> 'failed') AS vectors FROM i GROUP BY 1""",
        "run_transitions": transitions,
        "stream_run_transitions": transitions,
        "run_states": sql(
            f"""{_TRANSITIONS} SELECT collection_id, run, arg_max(status, seq) AS status, min(ts) FILTER (accepted AND event = 'start') AS started_at,
            max(ts) FILTER (accepted AND event IN ('complete', 'cancel')) AS ended_at, count(*) FILTER (NOT accepted) AS rejected FROM t WHERE run > 0 GROUP BY 1, 2""", "run_events"),
        "bucket_upsert": sql(
            """, new AS (SELECT item_id * 2 AS item_id, collection_id, concat('new ', collection_name) AS collection_name, permalink FROM vectors)
            SELECT item_id, collection_id, collection_name, permalink FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.item_id = v.item_id AND n.collection_id = v.collection_id)
            UNION ALL SELECT * FROM new""", "vectors"),
        "stream_feedback": sql(
            """, f AS (SELECT h.id, arg_max(f.feedback, f.seq) AS feedback, arg_max(f.feedback_notes, f.seq) AS feedback_notes FROM history h JOIN feedback_events f
              ON f.id = h.id AND given_at BETWEEN created_at AND created_at + INTERVAL 7 DAY GROUP BY 1)
            SELECT h.id, query, f.feedback, f.feedback_notes FROM history h LEFT JOIN f ON f.id = h.id""", "history", "feedback_events"),
        "repeated_appends": sql("SELECT id, created_at, CAST(created_at AS DATE) AS created_date FROM history WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21'", "history"),
        "stream_log": sql("SELECT id, created_at, query, CAST(created_at AS DATE) AS created_date FROM history", "history"),
        "embedding_failures": f"""WITH a AS ({batches}), bad AS (SELECT DISTINCT bucket, batch FROM a WHERE item_id IN (7, 150))
            SELECT item_id, bucket, batch, b.batch IS NULL AS embedded, CASE WHEN b.batch IS NOT NULL THEN 'ValueError: refused' END AS error FROM a LEFT JOIN bad b USING (bucket, batch)""",
    }
