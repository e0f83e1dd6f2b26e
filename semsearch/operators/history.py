"""The search log: filters, pages, period counts, top collections, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import inclusive_days, period_key, period_label
from ..functions.text import without_accents


def search_history(
    history: DataFrame, start: str | None = None, end: str | None = None, user_id: int | None = None,
    collection: str | None = None, search: str | None = None, feedback: int | None = None, accents: bool = True,
) -> DataFrame:
    """Searches that meet all given conditions; dates are inclusive, texts are parts in any case.

    Without ``accents`` a letter equals its accented forms.  A log kept in a folder
    per day (``created_date``) is read for the days in question alone.
    """
    conditions = []
    plain = F.lower if accents else without_accents
    if "created_date" in history.columns:
        conditions += [F.col("created_date") >= F.lit(start).cast("date")] if start else []
        conditions += [F.col("created_date") <= F.lit(end).cast("date")] if end else []
    if start:
        conditions.append(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end:
        conditions.append(F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if collection:
        conditions.append(F.exists("collections_used", lambda c: F.contains(plain(c), plain(F.lit(collection)))))
    if search:
        conditions.append(F.contains(plain(F.col("query")), plain(F.lit(search))) | F.contains(plain(F.col("response")), plain(F.lit(search))))
    if feedback is not None:
        conditions.append(F.col("feedback") == feedback)
    for c in conditions:
        history = history.where(c)
    return history


def last_days(history: DataFrame, days: int = 30, today: str | None = None, **conditions) -> DataFrame:
    """``search_history`` from ``days`` days ago (30 for the dashboard, 90 for training) to today."""
    end = F.lit(today).cast("date") if today else F.current_date()
    start, end = (str(x) for x in history.sparkSession.range(1).select(F.date_sub(end, days), end).first())
    return search_history(history, start, end, **conditions)


def history_page(history: DataFrame, limit: int = 100, offset: int = 0, order: str = "DESC") -> DataFrame:
    """A page by time and id."""
    if order.upper() not in ("ASC", "DESC"):
        raise ValueError("order must be ASC or DESC")
    way = F.desc if order.upper() == "DESC" else F.asc
    return history.orderBy(way("created_at"), way("id")).offset(offset).limit(limit)


def search_detail(history: DataFrame, search_id: int) -> DataFrame:
    """One search with a row for each of its collections, one row if it has none."""
    return history.where(F.col("id") == search_id).withColumn("collection", F.explode_outer("collections_used"))


def search_stats(history: DataFrame, period: str = "day", periods: int = 30) -> DataFrame:
    """label, total of the newest periods."""
    counts = history.groupBy(period_key(F.col("created_at"), period).alias("period")).agg(F.count("*").alias("total"), F.max("created_at").alias("last"))
    return counts.orderBy(F.desc("last")).limit(periods).select("period", period_label(F.col("last"), period).alias("label"), "total")


def top_collections(history: DataFrame, limit: int = 10, pre_limit: int | None = None) -> DataFrame:
    """The collections that most searches used. ``pre_limit`` counts the most frequent combinations alone."""
    used = F.array_sort("collections_used")
    combinations = history.where(F.size("collections_used") > 0).groupBy(used.alias("used")).agg(F.count("*").alias("n"))
    if pre_limit is not None:
        combinations = combinations.orderBy(F.desc("n"), F.array_join("used", ",")).limit(pre_limit)
    totals = combinations.select(F.explode("used").alias("collection"), "n").groupBy("collection").agg(F.sum("n").alias("total"))
    return totals.orderBy(F.desc("total"), "collection").limit(limit)


def dashboard_kpis(history: DataFrame, start: str, end: str) -> DataFrame:
    """One row: searches, days, searches per day, percent of positive among given feedback."""
    days = inclusive_days(F.lit(start).cast("date"), F.lit(end).cast("date"))
    given = F.count_if(F.col("feedback").isNotNull())
    positive = F.coalesce(F.try_divide(F.count_if(F.col("feedback") == 1) * 100, given), F.lit(0.0))
    return search_history(history, start, end).agg(
        F.count("*").alias("searches"), F.max(days).cast("long").alias("days"), F.round(F.count("*") / F.max(days), 1).alias("per_day"), F.round(positive, 0).alias("positive_percent")
    )


def latest_search_ids(history: DataFrame) -> DataFrame:
    """query, id of the newest search of each query text."""
    return history.groupBy("query").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def apply_feedback(history: DataFrame, events: DataFrame) -> DataFrame:
    """History with the latest feedback (id, seq, feedback, feedback_notes) of each search put in."""
    newest = F.max_by(F.struct("feedback", "feedback_notes"), F.struct("seq", "feedback", "feedback_notes"))
    latest = events.groupBy("id").agg(newest.alias("_l")).select("id", F.col("_l.feedback").alias("_f"), F.col("_l.feedback_notes").alias("_n"), F.lit(True).alias("_given"))
    joined = history.join(latest, "id", "left")
    for column, new in (("feedback", "_f"), ("feedback_notes", "_n")):
        if column in history.columns:
            joined = joined.withColumn(column, F.when(F.col("_given"), F.col(new)).otherwise(F.col(column)))
    return joined.drop("_f", "_n", "_given").select(*history.columns)


def items_per_search(history: DataFrame) -> DataFrame:
    return history.withColumn("n_items", F.greatest(F.coalesce(F.size("items_used"), F.lit(0)), F.lit(0)))
