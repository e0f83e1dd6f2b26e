"""Ranked lexical search over an index stratified by length.

A document of n terms has the normaliser m = 50 + (50 * n * N) div L, N documents with
L terms in all; documents of equal m are a *stratum*.  The index is a Parquet table of
blocks, each of documents of one stratum: for every term its postings by tf.  As m and
tf alone make the impact of a posting, a block works it out once per tf.  A search
first takes each stratum's largest tf of the asked terms, which bounds the score of
any document in it, and visits strata by falling bound until none can hold a
document among the k best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, small_or_not, stored
from .encode import give_memory_back, in_slices
from .words import words

#: Bytes of text that are counted at once; documents and postings in a block; questions asked at once.
SLICE_BYTES, BLOCK_DOCS, BLOCK_POSTINGS, QUESTIONS = 4_000_000, 512, 400_000, 512

#: The first visit goes to the best strata with so many documents per wanted result, each later one to so many times as many.
FIRST_VISIT, NEXT_VISIT = 8, 32

#: Stands for a missing id: it comes after all others.
NO_ID = (1 << 63) - 1

COUNTED = "doc_id long, n long, terms array<string>, tfs array<int>"
BLOCKS = "m long, docs array<long>, terms array<string>, groups array<int>, tfs array<int>, holders array<int>, places array<int>"
HITS = "q int, doc_id long, score long"

_BETWEEN = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if b in _BETWEEN and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the number of every term in order, and where each text's terms end. Null: none.

    A term is a maximal run of ASCII letters and digits and of characters beyond
    ASCII, A-Z lower-cased; all that ends one is a single byte.
    """
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    plain = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(_TABLE) if data is not None and at[-1] > at[0] else b""
    return words(pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(plain)))


def count_terms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``COUNTED``: every row's terms, each once with its tf; a row without an id has ``NO_ID``."""

    def run(batches):
        for batch in batches:
            for a, b in in_slices(batch.column(1), SLICE_BYTES):
                names, numbers, ends = terms_of(batch.column(1)[a:b])
                lengths = np.diff(ends, prepend=0)
                v = max(1, len(names))
                pairs, tfs = np.unique(np.repeat(np.arange(len(lengths)), lengths) * v + numbers, return_counts=True)
                edges = np.concatenate([[0], np.cumsum(np.bincount(pairs // v, minlength=len(lengths)))]).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(edges), names.take(pa.array(pairs % v)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(lengths.astype(np.int64)), terms, pa.ListArray.from_arrays(pa.array(edges), pa.array(tfs.astype(np.int32)))], names=["doc_id", "n", "terms", "tfs"]
                )

    return for_python(df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)), df[text_col].cast("string"))).mapInArrow(run, COUNTED)


def _block(m: int, docs: list, terms: list, tfs: list) -> pa.RecordBatch:
    """A row of ``BLOCKS``: by term, then by tf, the places of the documents in ``docs``."""
    place = np.repeat(np.arange(len(docs), dtype=np.int32), [len(x) for x in tfs])
    coded = pa.concat_arrays(terms).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term, tf = rank[coded.indices.to_numpy()], np.concatenate(tfs).astype(np.int64)
    by = np.lexsort((place, tf, term))
    term, tf, place = term[by], tf[by], place[by]
    starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])) if len(term) else np.zeros(0, int)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), one(np.array(docs, np.int64), pa.int64()), one(coded.dictionary.take(pa.array(order)), pa.string()), one(np.bincount(term[starts], minlength=len(order)).astype(np.int32), pa.int32()),
         one(tf[starts].astype(np.int32), pa.int32()), one(np.diff(np.append(starts, len(term))).astype(np.int32), pa.int32()), one(place, pa.int32())],
        names=[x.split()[0] for x in BLOCKS.split(", ")],
    )


class Index:
    """Stored blocks, with the number of documents and the documents per stratum."""

    def __init__(self, blocks: DataFrame, strata: DataFrame, documents: int):
        self.blocks, self.strata, self.documents = blocks, strata, documents


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row that has a term.

    A stratum is dealt by hash into as many parts as make blocks of about
    ``BLOCK_DOCS`` documents or ``BLOCK_POSTINGS`` postings, so one length in a third
    of all rows is many blocks.  Texts are read once; their terms are shuffled once.
    """
    counted = stored(count_terms(df, id_col, text_col).where("n > 0"), "counted-terms", "zstd")
    total = counted.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    m = (F.lit(50) + F.expr(f"(50 * n * {total.N}) div {max(1, total.L)}")).cast("long")
    sized = counted.select(m.alias("m"), F.size("tfs").cast("long").alias("postings")).groupBy("m").agg(F.count("*").alias("docs"), F.sum("postings").alias("postings"))
    strata = stored(sized.withColumn("parts", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("postings") / BLOCK_POSTINGS)).cast("long")), "strata")
    dealt = counted.withColumn("m", m).join(small_or_not(strata.select("m", "parts")), "m")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "n"), F.col("parts"))).repartition("m", "part").sortWithinPartitions("m", "part")

    def run(batches):
        key, waiting = None, ([], [], [])
        for batch in batches:
            ms, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((ms[1:] != ms[:-1]) | (parts[1:] != parts[:-1])) + 1, [len(ms)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if key not in (None, (ms[a], parts[a])):
                    yield _block(int(key[0]), *waiting)
                    waiting = ([], [], [])
                key = (ms[a], parts[a])
                waiting[0].extend(batch.column(2)[a:b].to_pylist())
                waiting[1].append(batch.column(3)[a:b].flatten())
                tfs = batch.column(4)[a:b]
                ends = np.cumsum(pc.list_value_length(tfs).to_numpy(zero_copy_only=False))
                waiting[2].extend(np.split(tfs.flatten().to_numpy(), ends[:-1]))
            give_memory_back()
        if key is not None:
            yield _block(int(key[0]), *waiting)

    blocks = for_python(dealt.select("m", "part", "doc_id", "terms", "tfs")).mapInArrow(run, BLOCKS)
    return Index(stored(blocks, "stratified-index", "zstd"), strata, total.N)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf, m):
    """Of a posting, for whole numbers, arrays of them or columns' SQL names."""
    return f"((1000000000 * {tf}) div (1000 * {tf} + 20 * {m}))" if isinstance(tf, str) else (1000000000 * tf) // (1000 * tf + 20 * m)


def _asked_terms(index: Index, asked: pa.Array) -> DataFrame:
    """m, t (number of an asked term), df, most: per block and asked term its documents and largest tf."""

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                found = pc.index_in(batch.column(1)[row].values, value_set=asked)
                here = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                if not len(here):
                    continue
                groups, tfs, holders = (batch.column(c)[row].values.to_numpy() for c in (2, 3, 4))
                ends = np.cumsum(groups)
                counts = np.add.reduceat(holders, ends - groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(here), batch.column(0)[row].as_py())), pa.array(found.to_numpy(zero_copy_only=False)[here].astype(np.int32)), pa.array(counts[here].astype(np.int64)), pa.array(tfs[ends[here] - 1].astype(np.int64))],
                    names=["m", "t", "df", "most"],
                )
            give_memory_back()

    found = for_python(index.blocks.select("m", "terms", "groups", "tfs", "holders")).mapInArrow(run, "m long, t int, df long, most long")
    return found.groupBy("m", "t").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


class _Best:
    """The k best (score, doc_id) of a question so far; equal scores by ascending id."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.scores, self.docs = k, floor, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """A score below this is not among the k."""
        return max(self.floor, int(self.scores[-1]) if len(self.scores) == self.k else 1)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]


def _visit(index: Index, visitors: DataFrame, asked: pa.Array, questions: list[tuple[np.ndarray, np.ndarray]], floors: dict[int, int], k: int) -> DataFrame:
    """The k best documents per task and question among the strata that it visits (m, visitors: q and bound).

    ``questions`` holds each one's term numbers and weights, ``floors`` scores that are known to be needed.
    """
    held = index.blocks.sparkSession.sparkContext.broadcast((asked, questions, floors))

    def run(batches):
        asked, questions, floors = held.value
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in range(len(batch)):
                found = pc.index_in(batch.column(2)[row].values, value_set=asked).to_numpy(zero_copy_only=False)
                here = np.flatnonzero(~np.isnan(found)) if found.dtype.kind == "f" else np.arange(len(found))
                docs, groups, tfs, holders, places = (batch.column(c)[row].values.to_numpy() for c in (1, 3, 4, 5, 6))
                kinds, of = np.unique(tfs, return_inverse=True)
                impacts = np.repeat(impact(kinds.astype(np.int64), batch.column(0)[row].as_py())[of], holders)
                group_ends, posting_ends = np.cumsum(groups), np.cumsum(holders)
                last = posting_ends[group_ends[here] - 1]
                first = np.where(group_ends[here] > groups[here], posting_ends[np.maximum(group_ends[here] - groups[here] - 1, 0)], 0)
                at = dict(zip(found[here].astype(int).tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True))
                for v in batch.column(7)[row].as_py():
                    q = v["q"]
                    top = best.setdefault(q, _Best(k, floors.get(q, 1)))
                    if v["bound"] < top.least():
                        continue
                    scores = np.zeros(len(docs), np.int64)
                    for t, w in zip(*questions[q], strict=True):
                        if w and t in at:
                            a, b = at[t]
                            scores[places[a:b]] += w * impacts[a:b]  # a document stands once in a term's postings
                    some = np.flatnonzero(scores >= top.least())
                    if len(some):
                        top.add(scores[some], docs[some])
            give_memory_back()
        for q, top in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.docs), q, np.int32)), pa.array(top.docs), pa.array(top.scores)], names=["q", "doc_id", "score"])

    joined = index.blocks.join(small_or_not(visitors, 20_000), "m")
    return stored(for_python(joined.select("m", "docs", "terms", "groups", "tfs", "holders", "places", "visitors")).mapInArrow(run, HITS), "ranked-hits", "zstd")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: Index, texts: list[str | None], k: int) -> DataFrame | None:
    """q (place in ``texts``), doc_id, score, rank."""
    spark = index.blocks.sparkSession
    asked, numbers, ends = terms_of(pa.array(texts, pa.string()))
    mine = [np.unique(numbers[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    if not len(asked):
        return None
    known = stored(_asked_terms(index, asked), "asked-terms")
    df = {r.t: r.df for r in known.groupBy("t").agg(F.sum("df").alias("df")).collect()}  # at most the terms of these questions
    weights = {t: weight(index.documents, n) for t, n in df.items()}
    questions = [(terms[[t in weights for t in terms.tolist()]], np.array([weights[t] for t in terms.tolist() if t in weights], np.int64)) for terms in mine]
    pairs = pa.table({"q": pa.array(np.repeat(np.arange(len(questions), dtype=np.int32), [len(t) for t, _ in questions])), "t": pa.array(np.concatenate([t for t, _ in questions]).astype(np.int32)), "w": pa.array(np.concatenate([w for _, w in questions]).astype(np.int64))})
    if not len(pairs):
        return None
    bound = F.sum(F.col("w") * F.expr(impact("most", "m")))
    bounds = known.join(small_or_not(spark.createDataFrame(pairs)), "t").groupBy("q", "m").agg(bound.alias("bound")).where("bound > 0").join(small_or_not(index.strata.select("m", "docs")), "m")
    before = Window.partitionBy("q").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    bounds = stored(bounds.withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0))), "bounds")
    hits, floors, done, upto = None, {}, 0, FIRST_VISIT * k
    while True:
        floor = F.broadcast(spark.createDataFrame(list(floors.items()), "q int, floor long"))  # at most a row per question
        left = bounds.where(F.col("before") >= done).join(floor, "q", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(1)))
        if left.isEmpty():
            return None if hits is None else _ranked(hits, k)
        visitors = left.where(F.col("before") < upto).groupBy("m").agg(F.collect_list(F.struct("q", "bound")).alias("visitors"))  # at most QUESTIONS of them
        found = _visit(index, visitors, asked, questions, floors, k)
        hits = found if hits is None else hits.unionByName(found)
        floors = {r.q: r.score for r in _ranked(hits, k).where(F.col("rank") == k).select("q", "score").collect()}
        done, upto = upto, upto * NEXT_VISIT


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0.

    Items are asked in blocks of about ``QUESTIONS``, so nothing sent to the driver or
    all tasks grows with them or with the documents.  A repeated item row is asked once
    per row and its ranks stand in the result as often; an item without terms, or a term that
    no document has, finds nothing.  Equal scores: ascending doc_id, missing ids last.
    """
    spark = items.sparkSession
    rows = stored(items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")), "items")
    n_blocks = max(1, -(-rows.count() // QUESTIONS))
    found = None
    for b in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        part = _search_block(index, [r.text for r in block], k) if block else None
        if part is not None:
            names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(block)], "q int, item_id long")
            part = part.join(F.broadcast(names), "q").select("item_id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score")
            part = stored(part, "ranked") if n_blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` of ``items`` over an index of all ``docs``. Null texts have no terms; repeated rows are documents of their own; other columns are not read."""
    return search(build(docs), items, k)
