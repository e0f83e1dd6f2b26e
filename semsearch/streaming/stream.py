"""Structured Streaming: item changes into a state table, searches counted per day and met by their feedback, runs followed through their events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.buckets import BucketTable
from ..operators.index import apply_changes
from ..operators.runs import EVENTS, STATUS


def stream_search_counts(history: DataFrame, lateness: str = "1 day") -> DataFrame:
    """day, total of a stream of searches; a day is given out once the watermark has passed it."""
    days = history.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 day")).agg(F.count("*").alias("total"))
    return days.select(F.to_date("window.start").alias("day"), "total")


def stream_index(changes: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Apply a stream of changes to the ``state_table`` under ``root``, all there is, and stop.

    A micro-batch reads and writes only the buckets of the items that it changes, and is
    named by its number: one that is run again after a failure leaves the same state.
    """
    table = state_table(changes.sparkSession, root, changes.schema, buckets)

    def step(batch: DataFrame, number: int) -> None:
        table.change(batch, number, apply_changes)
        if number:
            table.forget(number - 1)  # this batch is only run once the one before is done

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_table(spark: SparkSession, root: str, schema: StructType, buckets: int = 64) -> BucketTable:
    """Items' latest changes by item id."""
    return BucketTable(spark, root, ("item_id",), schema, buckets)


def append_searches(searches: DataFrame, path: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Append a stream of searches to the log, a folder per day; a search id that comes again within ``lateness`` is not appended again."""
    once = searches.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])
    dated = once.withColumn("created_date", F.to_date("created_at"))
    return dated.writeStream.partitionBy("created_date").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet", outputMode="append")


def stream_feedback(searches: DataFrame, feedback: DataFrame, within: str = "7 days", lateness: str = "1 day") -> DataFrame:
    """Searches (id, created_at, ...) with the latest feedback that came in time: a stream-stream left outer join.

    ``feedback`` has id, given_at, seq, feedback and feedback_notes.  Feedback counts if it is
    given within ``within`` after its search.  A search comes out once, when the
    watermarks (``lateness`` behind the newest row of either stream) have passed the
    time in which feedback could still come: with the feedback of the highest seq, or
    with nulls.  Later feedback is left out; the batch ``apply_feedback`` can add it.
    """
    log = searches.withWatermark("created_at", lateness).drop("feedback", "feedback_notes")
    given = feedback.select(F.col("id").alias("_id"), "given_at", "seq", "feedback", "feedback_notes").withWatermark("given_at", lateness)
    in_time = (F.col("given_at") >= F.col("created_at")) & (F.col("given_at") <= F.col("created_at") + F.expr(f"INTERVAL {within}"))
    joined = log.join(given, (F.col("id") == F.col("_id")) & in_time, "left")
    latest = F.max_by(F.struct("feedback", "feedback_notes"), F.coalesce("seq", F.lit(-1)))
    per_search = joined.groupBy(*log.columns).agg(latest.alias("_f"))
    return per_search.select(*log.columns, "_f.feedback", "_f.feedback_notes")


class _Lifecycle(StatefulProcessor):
    """Events of a collection wait until the watermark has passed them and are then judged in their order."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, event string")
        self.state = handle.getValueState("state", "active boolean, run long, status string")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            if len(pdf):
                events = list(zip(pdf["at"].tolist(), pdf["seq"].tolist(), pdf["event"].tolist(), strict=True))
                self.waiting.appendList(events)
                least = min(events)[0] // 1000
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first)  # one per batch: when it fires, all events that the watermark has passed are due
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        due, rest = [e for e in events if e[0] // 1000 < passed], [e for e in events if e[0] // 1000 >= passed]
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000)
        if not due:
            yield pd.DataFrame()
            return
        if rest:
            self.waiting.put([tuple(e) for e in rest])
        else:
            self.waiting.clear()
        active, run, status = tuple(self.state.get()) if self.state.exists() else (False, 0, "none")
        out = []
        for at, seq, event in due:
            accepted = event in EVENTS and (event == "start") != active
            if accepted:
                active, run, status = STATUS[event] == "processing", run + (event == "start"), STATUS[event]
            out.append((key[0], at, seq, event, accepted, run, status))
        self.state.update((active, run, status))
        yield pd.DataFrame(out, columns=["collection_id", "at", "seq", "event", "accepted", "run", "status"])

    def close(self) -> None:
        pass


def stream_run_transitions(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """``run_transitions`` of a stream of events, which may come in any order within ``lateness``.

    An event is given out once the watermark has passed it; needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = events.withWatermark("ts", lateness).select("collection_id", "ts", F.unix_micros("ts").alias("at"), "seq", "event")
    schema = "collection_id long, at long, seq long, event string, accepted boolean, run long, status string"
    judged = timed.groupBy("collection_id").transformWithStateInPandas(_Lifecycle(), schema, "append", "eventtime")
    return judged.select("collection_id", F.timestamp_micros("at").alias("ts"), "seq", "event", "accepted", "run", "status")
