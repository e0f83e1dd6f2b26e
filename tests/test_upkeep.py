"""Runs that are stopped, bucketed tables, run events, feedback streams and batches of an embedder."""

import random
import re
from collections import Counter
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from semsearch.config import Config
from semsearch.operators import embed as E
from semsearch.operators import facets, pages, sketches, textindex
from semsearch.operators import history as H
from semsearch.operators import index as X
from semsearch.operators import runs as R
from semsearch.operators.buckets import BucketTable
from semsearch.sources import export, tail
from semsearch.sources.ingest import ITEM_PAGE
from semsearch.streaming import indexing, stream

ITEM = "item_id long, collection_id long, name string"


def table_of(spark, root, buckets=8):
    return BucketTable(spark, str(root), ("item_id", "collection_id"), spark.createDataFrame([], ITEM).schema, buckets)


def put(old, new):
    return X.upsert_vectors(old, new)


def part_files(root):
    return {f: f.stat().st_mtime_ns for f in Path(root, "rows").rglob("*.parquet")}


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    table = table_of(spark, tmp_path)
    rows = spark.createDataFrame([(k, k % 3, "a") for k in range(400)], ITEM)
    assert table.read().count() == 0 and table.change(rows.limit(0), 0, put) == []
    assert table.change(rows, 1, put) == list(range(8))
    before = part_files(tmp_path)
    changed = table.change(spark.createDataFrame([(5, 2, "b"), (999, 1, "b")], ITEM), 2, put)
    after = part_files(tmp_path)
    new = {f for f in after if f not in before}
    assert len(changed) <= 2 and {f.parent.name for f in new} == {f"bucket={b}" for b in changed}
    assert {f for f in before if f in after} == {f for f in before if f.parent.name not in {f"bucket={b}" for b in changed}}
    assert sum(f.stat().st_size for f in new) < sum(f.stat().st_size for f in after) / 3
    got = {(r.item_id, r.collection_id): r.name for r in table.read().collect()}
    assert len(got) == 401 and got[5, 2] == got[999, 1] == "b" and got[6, 0] == "a"
    # the rows of a bucket are read from its folder alone
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", table.part([1])._jdf.queryExecution().executedPlan().toString())


def test_a_change_that_crashes_is_run_again(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path)
    table.change(spark.createDataFrame([(k, 1, "a") for k in range(40)], ITEM), 1, put)
    install = BucketTable._install
    monkeypatch.setattr(BucketTable, "_install", lambda self, stage: (_ for _ in ()).throw(RuntimeError("killed")))
    new = spark.createDataFrame([(k, 1, "b") for k in range(20)], ITEM)
    with pytest.raises(RuntimeError):
        table.change(new, 2, put)
    assert table.read().where("name = 'b'").count() == 0
    monkeypatch.setattr(BucketTable, "_install", install)
    calls = []
    table.change(new, 2, lambda old, rows: calls.append(1) or put(old, rows))
    assert not calls and table.read().groupBy("name").count().collect() and {r.name: r["count"] for r in table.read().groupBy("name").count().collect()} == {"a": 20, "b": 20}


def test_a_bucket_may_lose_all_its_rows(spark, tmp_path):
    table = table_of(spark, tmp_path, 3)
    rows = spark.createDataFrame([(k, 1, "a") for k in range(30)], ITEM)
    table.change(rows, 1, put)
    table.change(rows, 2, lambda old, gone: old.join(gone.select("item_id"), "item_id", "left_anti").select(old.columns))
    assert table.read().count() == 0
    table.change(rows.limit(2), 3, put)
    assert table.read().count() == 2


PAGES = ITEM_PAGE + ", collection_id long"


def write_pages(spark, root, n=6):
    """Pages of ten items, a file each; every seventh item has no text."""
    for p in range(n):
        items = [(p * 10 + k, "" if (p * 10 + k) % 7 == 0 else f"title {p * 10 + k}", "", "", None) for k in range(10)]
        spark.createDataFrame([(items, p % 2)], PAGES).coalesce(1).write.mode("append").parquet(f"{root}/pages")


def run_index(spark, root, pages, **options):
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 2).parquet(f"{pages}/pages")
    indexing.stream_indexing(source, str(root), f"{root}/checkpoint", embedder=E.HashEmbedder(8), buckets=4, **options).awaitTermination()


def state_of(spark, root):
    vectors = sorted((r.item_id, r.collection_id, r.content, tuple(r.vector)) for r in indexing.vector_table(spark, str(root), 4).read().collect())
    return vectors, sorted((r.batch, r.collection_id, r.processed, r.indexed, r.skipped, r.failed, tuple(r.errors)) for r in indexing.run_rows(spark, str(root)).collect())


@pytest.mark.parametrize("where", ["write_run_rows", "put_vectors", "index_batch"])
def test_a_killed_run_goes_on_where_it_was(spark, tmp_path, monkeypatch, where):
    write_pages(spark, tmp_path)
    run_index(spark, tmp_path / "whole", tmp_path)
    calls, real = [], getattr(indexing, where)

    def once(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*args, **kwargs)

    monkeypatch.setattr(indexing, where, once)
    with pytest.raises(Exception, match="killed"):
        run_index(spark, tmp_path / "broken", tmp_path)
    totals = spark.createDataFrame([(0, 30), (1, 30), (2, 5)], "collection_id long, total long")
    stopped = {r.collection_id: r.status for r in indexing.run_summary(indexing.run_rows(spark, str(tmp_path / "broken")), totals).collect()}
    assert stopped[2] == "pending" and "processing" in stopped.values()
    run_index(spark, tmp_path / "broken", tmp_path)
    assert len(calls) > 2 and state_of(spark, tmp_path / "broken") == state_of(spark, tmp_path / "whole")
    done = {r.collection_id: (r.status, r.processed, r.indexed, r.skipped, r.failed) for r in indexing.run_summary(indexing.run_rows(spark, str(tmp_path / "broken")), totals).collect()}
    blank = {c: sum(k % 7 == 0 and k // 10 % 2 == c for k in range(60)) for c in (0, 1)}
    assert done == {0: ("completed", 30, 30 - blank[0], 0, blank[0]), 1: ("completed", 30, 30 - blank[1], 0, blank[1]), 2: ("pending", 0, 0, 0, 0)}


def test_a_second_run_skips_what_is_indexed(spark, tmp_path):
    write_pages(spark, tmp_path, 2)
    run_index(spark, tmp_path, tmp_path)
    vectors, _ = state_of(spark, tmp_path)
    write_pages(spark, tmp_path, 2)  # the same items again
    run_index(spark, tmp_path, tmp_path, collections=spark.createDataFrame([(0, "A")], "id long, name string"))
    again, rows = state_of(spark, tmp_path)
    assert again == vectors and sum(r[4] for r in rows) == len(vectors)


def plain_transitions(events):
    out, state = [], {}
    for c, ts, seq, event in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        status, run = state.get(c, ("none", 0))
        if event == "start" and status != "processing":
            status, run, ok = "processing", run + 1, True
        elif event in ("progress", "complete", "cancel") and status == "processing":
            status, ok = {"progress": status, "complete": "completed", "cancel": "cancelled"}[event], True
        else:
            ok = False
        state[c] = (status, run)
        out.append((c, seq, ok, run, status))
    return sorted(out)


def run_events(spark, n=200):
    rng = random.Random(3)
    rows = [(k % 4, 1_700_000_000 + rng.randrange(300), k, rng.choice(["start", "start", "progress", "complete", "cancel", "odd", None])) for k in range(n)]
    frame = spark.createDataFrame(rows, "collection_id long, t long, seq long, event string").select("collection_id", F.timestamp_seconds("t").alias("ts"), "seq", "event")
    return rows, frame


def test_run_transitions(spark):
    rows, events = run_events(spark)
    got = R.run_transitions(events)
    assert sorted((r.collection_id, r.seq, r.accepted, r.run, r.status) for r in got.collect()) == plain_transitions(rows)
    states = R.run_states(got).collect()
    assert all((r.ended_at is None) == (r.status == "processing") and r.started_at is not None for r in states)
    per_collection = {}
    for r in states:
        per_collection.setdefault(r.collection_id, []).append(r)
    assert all(sum(r.status == "processing" for r in of) <= 1 for of in per_collection.values())
    assert R.run_transitions(events.limit(0)).count() == 0


def test_streamed_run_transitions_in_any_order(spark, tmp_path):
    rows, events = run_events(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):  # every file has events of the whole time
            events.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

        def run():
            out = stream.stream_run_transitions(source, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
            out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

        run()
        spark.createDataFrame([(9, 1_800_000_000, -1, "odd")], "collection_id long, t long, seq long, event string").select("collection_id", F.timestamp_seconds("t").alias("ts"), "seq", "event").write.mode("append").parquet(f"{tmp_path}/in")
        run()
    finally:
        spark.conf.unset(provider)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.collection_id, r.seq, r.accepted, r.run, r.status) for r in got) == plain_transitions(rows)


def test_feedback_that_comes_late_is_left_to_the_batch(spark, tmp_path):
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c) * 3600)
    searches = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (-1, 10_000)], "id long, t long").select("id", at("t").alias("created_at"), F.lit("q").alias("query"))
    given = [(1, 5, 1, 1, "good"), (1, 6, 2, 0, "bad"), (2, 200, 3, 1, "too late"), (3, 1, 4, 1, "before its search"), (-2, 10_000, 5, 1, "")]
    feedback = spark.createDataFrame(given, "id long, t long, seq long, feedback int, feedback_notes string").select("id", at("t").alias("given_at"), "seq", "feedback", "feedback_notes")
    for ahead in (False, True):
        searches.where((F.col("id") < 0) == ahead).write.mode("append").parquet(f"{tmp_path}/s")
        feedback.where((F.col("id") < 0) == ahead).write.mode("append").parquet(f"{tmp_path}/f")
        joined = stream.stream_feedback(spark.readStream.schema(searches.schema).parquet(f"{tmp_path}/s"), spark.readStream.schema(feedback.schema).parquet(f"{tmp_path}/f"), "7 days", "1 hour")
        joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: (r.feedback, r.feedback_notes) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (0, "bad"), 2: (None, None), 3: (None, None)}


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    h = spark.createDataFrame([(k, f"2024-01-{1 + k % 5:02d} 10:00:00") for k in range(20)], "id long, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    for batch in (1, 2, 2, 1):
        export.append_history(h.where(F.col("id") % 2 == batch % 2), str(tmp_path / "log"), batch)
    log = export.read_history(spark, str(tmp_path / "log"))
    assert sorted(r.id for r in log.collect()) == list(range(20)) and log.columns == ["id", "created_at", "created_date"]


def test_one_call_of_the_embedder_gets_one_batch(spark, tmp_path):
    texts = [(k, "x" * (40 * (k % 5)) if k % 9 else None) for k in range(120)]
    df = spark.createDataFrame(texts, "item_id long, content string").repartition(3)
    config = Config(batch_texts=7, batch_tokens=120)
    calls = tmp_path / "calls"
    calls.mkdir()

    def recorded(batch):
        (calls / f"{random.random()}").write_text(f"{len(batch)} {sum(map(len, batch)) / 4}")
        if "x" * 160 in batch:
            raise RuntimeError("refused")
        return np.ones((len(batch), 3))

    got = E.embed_in_batches(df, embedder=recorded, buckets=4, config=config).collect()
    want = {r.item_id: (r.bucket, r.batch) for r in E.assign_embedding_batches(df, buckets=4, config=config).collect()}
    assert {r.item_id: (r.bucket, r.batch) for r in got} == want and len(got) == 120
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert len(list(calls.iterdir())) == len(batches)  # a call per batch, none has too much
    assert all(int(n) <= 7 and float(t) <= 120 for n, t in (f.read_text().split() for f in calls.iterdir()))
    for rows in batches.values():
        refused = any(r.item_id % 5 == 4 and r.item_id % 9 for r in rows)
        assert all((r.vector is None) == refused and (r.error == "RuntimeError: refused") == refused for r in rows)
    short = E.embed_in_batches(df, embedder=lambda batch: np.ones((1, 3)), buckets=1, config=Config(batch_texts=2)).collect()
    assert all(r.vector is None and r.error.startswith("ValueError: 2 texts") for r in short)


def test_batches_of_many_items_are_one_fill(spark, tmp_path):
    df = spark.range(9_000).select((8_999 - F.col("id")).alias("item_id"), F.format_string("text %d", 8_999 - F.col("id")).alias("content"))

    def recorded(batch):
        (tmp_path / f"{random.random()}").write_text("\n".join(batch))
        if "text 2048" in batch:
            raise RuntimeError("refused")
        return np.ones((len(batch), 2))

    got = E.embed_in_batches(df, embedder=recorded).collect()
    assert sorted((r.item_id, r.bucket, r.batch, r.content, r.error) for r in got) == [(k, 0, k // 2048, f"text {k}", "RuntimeError: refused" if k // 2048 == 1 else None) for k in range(9_000)]
    calls = sorted((f.read_text().split("\n") for f in tmp_path.iterdir()), key=lambda c: int(c[0][5:]))
    assert calls == [[f"text {k}" for k in range(a, min(a + 2048, 9_000))] for a in range(0, 9_000, 2048)]


def test_failed_batches_reach_the_outcomes(spark):
    rows = [(k, 1, "A", f"title {k}", "text", {"a": "b"}, "u") for k in range(30)]
    items = spark.createDataFrame(rows, "item_id long, collection_id long, collection_name string, title string, description string, metadata map<string,string>, url string")
    none = X.index_items(items, spark.createDataFrame([], "item_id long, collection_id long"), E.HashEmbedder(8)).limit(0)

    def refuses(texts):
        if any("title 3\n" in t for t in texts):
            raise RuntimeError("refused")
        return E.HashEmbedder(8)(texts)

    after, outcomes = X.index_collections(items, none, refuses, config=Config(batch_texts=10))
    counts = X.outcome_counts(outcomes).first()
    assert counts.indexed == after.count() == 20 and counts.failed == 10


def test_tail_reads_only_the_end(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [f"line {k} é" for k in range(3000)]
    (folder / "a.log").write_text("\n".join(lines) + "\n")
    (folder / "b.log").write_text("one\r\n\ntwo")
    (folder / "_SUCCESS").write_text("no log")
    (folder / "empty.log").write_text("")
    key = lambda df: sorted((r.file, r.line_no, r.value) for r in df.collect())
    whole = [("a.log", k - 3000, x) for k, x in enumerate(lines)] + [("b.log", -3, "one"), ("b.log", -2, ""), ("b.log", -1, "two")]
    assert key(tail.read_tail(spark, str(folder), tailLines=5000)) == sorted(whole)
    assert key(tail.read_tail(spark, str(folder))) == sorted(x for x in whole if x[1] >= -1000)
    cut = key(tail.read_tail(spark, f"file://{folder}/a.log", wholeBytes=1000, tailBytes=500))
    size, kept = 0, []
    for k, x in reversed(list(enumerate(lines))):
        size += len(x.encode()) + 1
        if size <= 500:
            kept.append(("a.log", k - 3000, x))
    assert cut == sorted(kept)
    exact = sum(len(x.encode()) + 1 for x in lines[-20:])  # the bytes begin at a line's first
    assert len(key(tail.read_tail(spark, str(folder / "a.log"), wholeBytes=1, tailBytes=exact))) == 20


def test_facet_bitmaps_count_all_hits(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(200_000), rng.choice("abc"), rng.choice(["x", "y", None])) for _ in range(500)]
    rows = list({r[0]: r for r in rows}.values())
    items = spark.createDataFrame(rows, "item_id long, kind string, place string")
    index, hits = facets.facet_index(items, {"kind": "kind", "place": "place"}), items.where("item_id % 3 > 0")
    for chosen in ({}, {"kind": ["a", "b"]}, {"kind": ["a"], "place": ["x"]}, {"kind": ["none"]}, {"kind": [], "place": ["y"]}):
        left = [r for r in rows if r[0] % 3 and (not chosen.get("kind") or r[1] in chosen["kind"]) and (not chosen.get("place") or r[2] in chosen["place"])]
        found = facets.visible(index, hits, chosen)
        assert facets.count_visible(found).first().visible == len(left)
        want = Counter(("kind", r[1]) for r in left) + Counter(("place", r[2]) for r in left if r[2])
        assert {(r.facet, r.value): r.n for r in facets.facet_totals(index, found).collect()} == dict(want)


def test_pages_read_at_most_two_files(spark, tmp_path):
    h = spark.createDataFrame([(k, 1_700_000_000 + k * 7919 % 300) for k in range(1000)], "id long, t long").select("id", F.timestamp_seconds("t").alias("created_at"))
    pages.write_sorted_log(h, str(tmp_path), 100)
    assert spark.read.parquet(f"{tmp_path}/directory").count() >= 8
    for order in ("DESC", "asc"):
        for limit, offset in ((10, 0), (50, 120), (30, 985), (5, 5000)):
            got = [r.id for r in pages.seek_page(spark, str(tmp_path), limit, offset, order).collect()]
            assert got == [r.id for r in H.history_page(h, limit, offset, order).collect()]
            assert len(pages.page_files(spark, str(tmp_path), limit, offset, order)[0]) <= 2
    with pytest.raises(ValueError):
        pages.page_files(spark, str(tmp_path), order="up")


def test_statistics_merge_and_late_days_replace(spark, tmp_path):
    rows = [(k, 1_700_000_000 + k * 3600, k % 37, f"q{k % 11}", ["a"] if k % 2 else ["a", "b"]) for k in range(400)]
    h = spark.createDataFrame(rows, "id long, t long, user_id long, query string, collections_used array<string>").withColumn("created_at", F.timestamp_seconds("t"))
    path = str(tmp_path / "daily")
    sketches.put_days(sketches.daily_stats(h.where("id < 200")), path)
    sketches.put_days(sketches.daily_stats(h.where("id >= 190")), path)  # the day of 190 comes again, in part
    day = F.to_date("created_at")
    again = h.where(day == F.to_date(F.timestamp_seconds(F.lit(1_700_000_000 + 190 * 3600))))
    sketches.put_days(sketches.daily_stats(again), path)
    sketches.put_days(sketches.daily_stats(h.where(day == F.to_date(F.timestamp_seconds(F.lit(1_700_000_000 + 199 * 3600))))), path)
    merged = {r.collection: r for r in sketches.merged_stats(sketches.read_days(spark, path), "2000-01-01", "2100-01-01").collect()}
    assert (merged["a"].searches, merged["b"].searches) == (400, 200)
    assert abs(merged["a"].users - 37) <= 2 and abs(merged["a"].queries - 11) <= 1


def test_texts_found_by_trigrams_are_those_of_a_scan(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abÇé ") for _ in range(rng.randrange(0, 9)))
    rows = [(k, f"2024-01-{1 + k % 9:02d} 10:00:00", k % 3, word(), None if k % 7 == 0 else word()) for k in range(300)]
    rows += [(1000, "2024-01-04 11:00:00", 1, "a rare Needle", "x"), (1001, None, 1, "no day", "needles")]
    h = spark.createDataFrame(rows, "id long, created_at string, user_id long, query string, response string").withColumn("created_at", F.to_timestamp("created_at"))
    textindex.write_text_index(h.where("created_at is not null"), str(tmp_path))
    for part in ("ab", "aba", "ÇÉa", "b a", "NEEDLE", "never", "", "aaaa"):
        want = sorted(r.id for r in H.search_history(h.where("created_at is not null"), search=part).collect())
        assert sorted(r.id for r in textindex.indexed_search(spark, str(tmp_path), part).collect()) == want
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(textindex.indexed_search(spark, str(tmp_path), "aba", user_id=1)) == ids(H.search_history(h, search="aba", user_id=1))
    # a rare part reads one day's folder and verifies one row
    found = textindex.indexed_search(spark, str(tmp_path), "needle")
    assert textindex.candidates(spark, str(tmp_path), "needle").count() == 1
    assert {r[0] for r in found.select("created_date").distinct().collect()} == {date(2024, 1, 4)}
