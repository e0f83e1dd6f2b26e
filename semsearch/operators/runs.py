"""Indexing runs from an append-only run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_totals(runs: DataFrame) -> DataFrame:
    """Sums per collection, and over all (collection_id null), with the number of runs."""
    sums = [F.sum(c).alias(c) for c in ("total", "success", "failed")]
    return runs.rollup("collection_id").agg(*sums, F.count("*").alias("runs"))


def progress(done: Column, total: Column) -> Column:
    """Percent, at most 100, 0 of nothing."""
    return F.when(total > 0, F.least(F.round(100 * done / total, 0), F.lit(100.0))).otherwise(F.lit(0.0))


def latest_runs(runs: DataFrame, order: str = "last_update") -> DataFrame:
    """The latest row of each collection with its progress."""
    last = runs.groupBy("collection_id").agg(F.max_by(F.struct(*(c for c in runs.columns if c != "collection_id")), order).alias("_r"))
    return last.select("collection_id", "_r.*").select(*runs.columns).withColumn("progress", progress(F.col("success"), F.col("total")))


#: What happens to an indexing run; ``progress`` carries counters, the others move the run.
EVENTS = ("start", "progress", "complete", "cancel")
#: The status that an accepted event leaves.
STATUS = {"start": "processing", "progress": "processing", "complete": "completed", "cancel": "cancelled"}


def run_transitions(events: DataFrame) -> DataFrame:
    """Every event (collection_id, ts, seq, event) with its verdict: accepted, status after it, and the run of its collection, from 1.

    In the order of ts and seq, ``start`` is accepted unless a run of the collection is
    processing; the other events are accepted only while one is.  A rejected event
    changes nothing.  The last event that moves a run tells whether one is processing,
    accepted or not: after any ``start`` one is, after ``complete`` or ``cancel`` none is.
    Unknown events are rejected and change nothing.
    """
    order = Window.partitionBy("collection_id").orderBy("ts", "seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    moves = F.when(F.col("event").isin("start", "complete", "cancel"), F.col("event"))
    active = F.coalesce(F.last(moves, ignorenulls=True).over(before) == "start", F.lit(False))
    known = F.coalesce(F.col("event").isin(*EVENTS), F.lit(False))
    judged = events.select("collection_id", "ts", "seq", "event", (known & ((F.col("event") == "start") != active)).alias("accepted"))
    status = F.when(F.col("accepted"), F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))[F.col("event")])
    judged = judged.withColumn("run", F.sum(F.when(F.col("accepted") & (F.col("event") == "start"), 1).otherwise(0)).over(upto))
    return judged.withColumn("status", F.coalesce(F.last(status, ignorenulls=True).over(upto), F.lit("none")))


def run_states(transitions: DataFrame) -> DataFrame:
    """One row per run: collection_id, run, status, started_at, ended_at (null while processing), rejected events since its start."""
    accepted = lambda *events: F.col("accepted") & F.col("event").isin(*events)
    return transitions.where("run > 0").groupBy("collection_id", "run").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min(F.when(accepted("start"), F.col("ts"))).alias("started_at"),
        F.max(F.when(accepted("complete", "cancel"), F.col("ts"))).alias("ended_at"), F.count_if(~F.col("accepted")).alias("rejected"),
    )


def prune_runs(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Runs still processing, and others from ``cutoff`` on."""
    return runs.where((F.col("status") == "processing") | (F.col("last_update") >= cutoff))


def last_errors(errors: DataFrame, keep: int = 10) -> DataFrame:
    """The newest errors of each collection."""
    newest = Window.partitionBy("collection_id").orderBy(F.desc("seq"))
    return errors.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= keep)
