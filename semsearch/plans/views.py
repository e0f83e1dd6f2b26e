"""Views that give the tables of the test data the shapes of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 10).cast("long")
    chars = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("n_chars").cast("string"))  # blank values on purpose
    year = (1900 + F.col("doc_id") % 120).cast("string")
    return d.select(
        F.col("doc_id").alias("item_id"), number.alias("collection_id"), F.col("source").alias("collection_name"),
        F.concat(F.lit("Item "), F.col("doc_id").cast("string"), F.lit(" "), "lang").alias("title"), F.col("text").alias("description"), F.col("lang").alias("m_type"),
        year.alias("m_year"), F.create_map(F.lit("type"), F.col("lang"), F.lit("year"), year, F.lit("chars"), chars).alias("metadata"),
        F.concat(F.lit("https://example.org/item/"), F.col("doc_id").cast("string")).alias("url"),
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("source", 4, 10).cast("long")
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return d.select(number.alias("id"), F.col("source").alias("name"), (F.col("n") + number % 3).alias("items_count"), (number % 2 == 0).alias("enabled"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("collection_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection_name"),
        F.col("embedding").alias("vector"), F.concat(F.lit("https://example.org/item/"), F.col("vec_id").cast("string")).alias("permalink"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600).alias("last_updated"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a query."""
    return vectors(spark, sf_dir).where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "vector")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.array_distinct(F.array(F.concat(F.lit("c"), (k % 10).cast("string")), F.concat(F.lit("c"), (k % 7).cast("string"))))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), "user_id", F.concat("event_type", F.lit(" "), (F.col("user_id") % 20).cast("string")).alias("query"),
        F.concat(F.lit("answer for "), "event_type").alias("response"), names.alias("collections_used"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0).alias("feedback"),
    )


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").withColumns({"nrole": F.lead("role").over(turns), "nxt": F.lead("text").over(turns)})
    p = p.where("role = 'user' AND nrole = 'assistant'").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")
    return p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query"), F.col("nxt").alias("response"), F.col("quality").alias("feedback"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), "value")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).alias("collection_id"), F.to_date("ts").alias("run_day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("success"), F.count_if(F.col("event_type") == "error").alias("failed")
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to the indexing runs of ten collections."""
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "cancel").otherwise("progress")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("collection_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), event.alias("event"))


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events on each of the first searches, some of them long after it."""
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 3).alias("id"), F.col("ts").cast("timestamp").alias("given_at"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).cast("int").alias("feedback"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("feedback_notes"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("event_id") % 4 == 0, "[other] ").otherwise("[app] ")
    level = F.when(F.col("event_type") == "error", "[ERROR] ").when(F.col("event_type") == "view", "[DEBUG] ").otherwise("")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.concat(tag, level, "event_type").alias("value"))


#: The same views in DuckDB SQL.
SQL = {
    "items": """SELECT doc_id AS item_id, CAST(substr(source,4) AS BIGINT) AS collection_id, source AS collection_name,
      concat('Item ',doc_id,' ',lang) AS title, text AS description, lang AS m_type, CAST(1900+doc_id%120 AS VARCHAR) AS m_year,
      CASE WHEN doc_id%3=0 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS m_chars, concat('https://example.org/item/',doc_id) AS url FROM documents""",
    "collections": """SELECT CAST(substr(source,4) AS BIGINT) AS id, source AS name, count(*)+CAST(substr(source,4) AS BIGINT)%3 AS items_count,
      CAST(substr(source,4) AS BIGINT)%2=0 AS enabled FROM documents GROUP BY source""",
    "vectors": """SELECT vec_id AS item_id, CAST(label AS BIGINT) AS collection_id, concat('c',label) AS collection_name, embedding::DOUBLE[] AS vector,
      concat('https://example.org/item/',vec_id) AS permalink, make_timestamp((1704067200+vec_id*3600)*1000000) AS last_updated FROM embeddings""",
    "history": """SELECT event_id AS id, ts AS created_at, user_id, concat(event_type,' ',user_id%20) AS query, concat('answer for ',event_type) AS response,
      list_distinct([concat('c',k%10),concat('c',k%7)]) AS collections_used, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS feedback
      FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events) e""",
    "training_pairs": """SELECT p.conv_id*1000+p.turn AS id, p.text AS query, p.nxt AS response, l.quality AS feedback
      FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) p
      LEFT JOIN labels l ON l.doc_id=p.conv_id WHERE p.role='user' AND p.nrole='assistant'""",
    "changes": """SELECT user_id AS item_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS op, value FROM events""",
    "runs": """SELECT user_id%10 AS collection_id, CAST(ts AS DATE) AS run_day, count(*) AS total, sum(CASE WHEN event_type<>'error' THEN 1 ELSE 0 END) AS success,
      sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS failed FROM events GROUP BY user_id%10, CAST(ts AS DATE)""",
    "run_events": """SELECT user_id%10 AS collection_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'cancel' ELSE 'progress' END AS event FROM events""",
    "feedback_events": """SELECT CAST(floor(event_id/3) AS BIGINT) AS id, ts AS given_at, event_id AS seq, CAST(event_id%2 AS INTEGER) AS feedback, concat('note ',event_id) AS feedback_notes FROM events""",
    "log_lines": """SELECT event_id AS line_no, concat(CASE WHEN event_id%4=0 THEN '[other] ' ELSE '[app] ' END,
      CASE event_type WHEN 'error' THEN '[ERROR] ' WHEN 'view' THEN '[DEBUG] ' ELSE '' END, event_type) AS value FROM events""",
}


def sql(query: str, *names: str) -> str:
    """A query over views of ``SQL``, as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (query if query.startswith(",") else " " + query)
