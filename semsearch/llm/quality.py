"""Quality rules: word counts of a document, and lines that too many documents of a host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, for_python, free_name, small_or_not, stored
from .encode import in_slices
from .words import windows, words

SYMBOLS = r"[#*$%&|<>]"

#: Bytes of text that are measured at once.
SLICE_BYTES = 4_000_000

#: A line in more documents of a host than this is frequent, however large the host is.
MAX_DOCUMENTS = 100

#: What a document is measured by; ``lines`` has its distinct normalised lines and their words.
MEASURES = (
    "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line: long, n: int>>"
)

MEASURE_NAMES = ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]


def repeated_words(numbers: np.ndarray) -> int:
    """Words that stand in a window of three found twice or more."""
    if len(numbers) < 4:
        return 0
    keys = windows(numbers, 3)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    inside = np.zeros(len(numbers), bool)
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def normal_line(line: str) -> str:
    """Lower case, white space as single blanks."""
    return " ".join(line.lower().split())


def _measures(doc_ids: pa.Array, hosts: pa.Array, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    texts = pc.fill_null(texts, "")
    names, numbers, ends = words(texts)
    starts = np.concatenate([[0], ends[:-1]])
    total = lambda per_word: np.diff(np.concatenate([[0], np.cumsum(per_word.to_numpy(zero_copy_only=False)[numbers], dtype=np.int64)])[np.concatenate([[0], ends])])
    repeats = np.fromiter((repeated_words(numbers[a:b]) for a, b in zip(starts, ends, strict=True)), np.int64, len(texts))

    parts = pc.split_pattern(texts, "\n")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    lines = parts.flatten().dictionary_encode()
    normal = [normal_line(x) for x in lines.dictionary.to_pylist()]
    n_in = np.fromiter((x.count(" ") + 1 if x else 0 for x in normal), np.int64, len(normal))
    has_word = pc.match_substring_regex(lines.dictionary, r"[^ \t\n\v\f\r]").to_numpy(zero_copy_only=False)
    code = lines.indices.to_numpy().astype(np.int64)
    real = has_word[code]
    doc, code = doc[real], code[real]
    distinct = np.unique(doc * max(1, len(normal)) + code)
    dup_lines = np.bincount(doc, minlength=len(texts)) - np.bincount(distinct // max(1, len(normal)), minlength=len(texts))

    # lines that differ only in case or space are one; ``first`` stands for all of them
    first = {}
    same = np.fromiter((first.setdefault(x, i) for i, x in enumerate(normal)), np.int64, len(normal))
    pairs, times = np.unique(doc * max(1, len(normal)) + same[code], return_counts=True)
    of, line = pairs // max(1, len(normal)), pairs % max(1, len(normal))
    hashes = {i: xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, i in first.items()}
    held = pa.StructArray.from_arrays(
        [pa.array(np.fromiter((hashes[i] for i in line.tolist()), np.int64, len(line))), pa.array((times * n_in[line]).astype(np.int32))], names=["line", "n"]
    )
    edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
    columns = [
        doc_ids, hosts, keys, pa.array(np.diff(ends, prepend=0)), pa.array(total(pc.utf8_length(names))),
        pa.array(total(pc.count_substring_regex(names, SYMBOLS))), pa.array(dup_lines), pa.array(repeats), pa.ListArray.from_arrays(pa.array(edges), held),
    ]
    return pa.RecordBatch.from_arrays(columns, names=MEASURE_NAMES)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``MEASURES`` of every row; a null text has no words, a null host is the host ``''``."""

    def run(batches):
        for batch in batches:
            for a, b in in_slices(batch.column(3), SLICE_BYTES):
                yield _measures(*(batch.column(i)[a:b] for i in range(4)))

    host = F.coalesce(df[host_col].cast("string"), F.lit(""))
    text = df[text_col].cast("string")
    return for_python(df.select(df[id_col].cast("long"), host, F.xxhash64(text), text)).mapInArrow(run, MEASURES)


def frequent_lines(docs: DataFrame, max_share: float, min_documents: int, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Lines of a host (host, line) in more than ``min_documents`` of its documents and more than ``max_share`` of all, or in more than ``max_documents``.

    Rows of equal text are one document, or copies would make their own lines frequent.
    """
    counts = docs.select("host", "text_key", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count_distinct("text_key").alias("n"))
    counts = stored(counts.where(F.col("n") > min_documents), "line-counts")
    hosts = stored(docs.groupBy("host").agg(F.count_distinct("text_key").alias("n_host")), "hosts")
    return stored(counts.join(small_or_not(hosts), "host").where((F.col("n") > F.col("n_host") * max_share) | (F.col("n") > max(min_documents, max_documents))).select("host", "line"), "frequent-lines")


def judge_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_share: float = 0.1, min_documents: int = 10, min_words: int = 50, max_repeat_percent: int = 50, max_removed: float = 0.5,
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """One row per document: doc_id, the counts of ``measure``, removed_words, base_failed, kept.

    A document fails the base rules with fewer than ``min_words`` words or more than
    ``max_repeat_percent`` repeated ones.  Lines found in more than ``max_share`` of the
    documents of a host (and more than ``min_documents``), or in more than
    ``max_documents`` of them, are taken out; a document that loses more than
    ``max_removed`` of its words so is depleted and not kept.  Documents of equal
    text are counted once.

    Only hashes of lines are shuffled, with counts formed where the rows are.  The
    table of frequent lines is broadcast only if a count shows it small.  A null or empty text has no words
    and fails; repeated rows are judged alike; an empty table gives no rows.
    Other columns are not read.
    """
    docs, frequent = _measured(df, id_col, text_col, host_col, max_share, min_documents, max_documents)
    return _judged(docs, frequent, min_words, max_repeat_percent, max_removed).drop("_row", "host")


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that ``judge_documents`` keeps, without the frequent lines of their host.

    Rejected rows are named by hash and filtered out; other columns stay as they are,
    whatever their names.  Null, empty and blank texts fail the base rules and go;
    repeated rows are kept or go alike; rows without an id are judged as others; a null
    host is the host ``''``; an empty table gives no rows.
    """
    docs, frequent = _measured(df, id_col, text_col, host_col)
    name = free_name(df, "_row")
    gone = stored(_judged(docs, frequent).where("not kept").select(F.col("_row").alias(name)).distinct(), "rejected")
    host = F.coalesce(df[host_col].cast("string"), F.lit(""))
    keyed = df.withColumn(name, F.xxhash64(df[id_col].cast("long"), host, F.xxhash64(df[text_col].cast("string"))))
    kept = keyed.join(small_or_not(gone, 1_000_000), name, "left_anti").drop(name)
    return without_frequent_lines(kept, frequent, text_col, host_col, docs)


def _measured(
    df: DataFrame, id_col: str, text_col: str, host_col: str, max_share: float = 0.1, min_documents: int = 10, max_documents: int = MAX_DOCUMENTS
) -> tuple[DataFrame, DataFrame]:
    """``measure`` of every row with the hash that names it, and the frequent lines."""
    docs = stored(measure(df, id_col, text_col, host_col), "measures").withColumn("_row", F.xxhash64("doc_id", "host", "text_key"))
    return docs, frequent_lines(docs, max_share, min_documents, max_documents)


def _judged(docs: DataFrame, frequent: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_removed: float = 0.5) -> DataFrame:
    bad = small_or_not(frequent)
    lines = docs.select("_row", "host", F.explode("lines").alias("l")).select("_row", "host", "l.line", "l.n")
    removed = lines.join(bad, ["host", "line"]).groupBy("_row", "line").agg(F.max("n").alias("n")).groupBy("_row").agg(F.sum("n").alias("removed_words"))
    judged = docs.drop("lines", "text_key").join(removed, "_row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = F.col("removed_words") > max_removed * F.col("n_words")
    return judged.select(
        "_row", "host", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words",
    )


def without_frequent_lines(df: DataFrame, frequent: DataFrame, text_col: str = "text", host_col: str = "source", docs: DataFrame | None = None) -> DataFrame:
    """``df`` with the ``frequent_lines`` of each host taken out of its texts; null texts stay null.

    A row meets only the frequent lines that it holds itself, from ``docs``, the
    measures of these or more rows; texts are shuffled only if those lines are too many to broadcast.
    """
    if docs is None:
        docs = measure(df.select(F.lit(0).alias("id"), df[text_col].alias("text"), df[host_col].alias("host")), "id", "text", "host")
    key, found = free_name(df, "_text"), free_name(df, "_frequent")
    lines = docs.select("host", "text_key", F.explode("lines.line").alias("line")).join(small_or_not(frequent), ["host", "line"])
    held = stored(lines.select(F.xxhash64("host", "text_key").alias(key), "line").distinct(), "held-lines")
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    per_text = held.groupBy(key).agg(F.collect_list("line").alias(found))

    def strip(batches):
        for batch in batches:
            for a, b in in_slices(batch[text_col], SLICE_BYTES):
                part = batch.slice(a, b - a)
                texts = [
                    t if t is None or bad is None else "\n".join(x for x in t.split("\n") if not (n := normal_line(x)) or xxhash.xxh3_64_intdigest(n) - (1 << 63) not in bad)
                    for t, bad in zip(part[text_col].to_pylist(), part[found].to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else part[n] for n in names], names=names)

    names = df.columns
    text = F.xxhash64(F.coalesce(df[host_col].cast("string"), F.lit("")), F.xxhash64(df[text_col].cast("string")))
    joined = df.withColumn(key, text).join(F.broadcast(per_text) if few else per_text, key, "left")
    return for_python(joined).mapInArrow(strip, df.schema)
