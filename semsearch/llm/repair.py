"""Token ids in files compressed by Re-Pair grammars, one grammar per shard.

File format: a Parquet table with one row per shard, in ``part``, ``shard`` order:

- part, shard: place of the shard; documents ascend by id over (part, shard)
- before: tokens of the same part before this shard; n_docs, n_tokens: what it holds
- doc_ids, doc_ends: little-endian int64; the ids, and where each document's tokens end;
  documents without an id are the last ones and have an end alone
- base: symbols below are token ids; symbol ``base + i`` is rule ``i``
- rules: little-endian uint32 pairs (left, right); lengths: uint32, tokens a rule expands to
- low, high: the sequence's symbols, the low 16 bits as uint16 and one bit plane per higher bit
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import for_python, small_or_not
from .encode import encoder, in_slices

#: Tokens after which a shard ends, at the next end of a document.
SHARD_TOKENS = 1 << 20
#: Bytes of text that are encoded at once; more than a batch has, as each call looks through all known pieces.
ENCODE_BYTES = 8_000_000
#: Pairs replaced in a round, and how often a pair must occur: a rarer one saves less than the 12 bytes of its rule.
PAIRS, LEAST = 16384, 8
#: Slots that pairs are counted in before the frequent ones are counted exactly, as a power of 2.
SLOT_BITS = 18
#: So many pairs are sorted at once instead, as the slots would take longer.
SORTED = 1 << 17

SHARD_SCHEMA = (
    "part int, shard int, before long, n_docs int, n_tokens long, doc_ids binary, doc_ends binary, base int, "
    "rules binary, lengths binary, low binary, high binary"
)


def _slots(keys: np.ndarray) -> np.ndarray:
    hashed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed >>= np.uint64(64 - SLOT_BITS)
    return hashed.view(np.int64)


def _frequent(keys: np.ndarray, pairs: int, least: int) -> np.ndarray:
    """The most frequent keys, the first most of all; equal counts by key."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    n = np.diff(np.append(first, len(keys)))
    found, n = keys[first[n >= least]], n[n >= least]
    return found[np.lexsort((found, -n))[:pairs]]


def _places(keys: np.ndarray, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent keys as in ``_frequent``, where any of them stands, and which it is there."""
    if len(keys) <= SORTED:
        chosen = _frequent(keys, pairs, least)
        if not len(chosen):
            return chosen, chosen, chosen
        order = np.argsort(chosen)
        found = order[np.minimum(np.searchsorted(chosen, keys, sorter=order), len(chosen) - 1)]
        at = np.flatnonzero(chosen[found] == keys)
        return chosen, at, found[at].astype(np.int32)
    slots = _slots(keys)
    counts = np.bincount(slots, minlength=1 << SLOT_BITS)
    # a slot may hold several keys, so its count only bounds theirs: those below can be left out
    above = np.cumsum(np.bincount(counts)[::-1])[::-1]
    bar = max(least, int(np.searchsorted(-above, -pairs, "right")) - 1)
    maybe = (counts >= bar)[slots]
    chosen = _frequent(keys[maybe], pairs, least)
    if not len(chosen) and bar > least:  # only crowded slots were above the bar
        maybe = (counts >= least)[slots]
        chosen = _frequent(keys[maybe], pairs, least)
    if not len(chosen):
        return chosen, chosen, chosen
    # a lookup is one comparison with the most frequent chosen key of a slot; others of the slot are searched for
    chosen_slots = _slots(chosen)
    first = np.zeros(len(chosen), bool)
    first[np.unique(chosen_slots, return_index=True)[1]] = True
    rank_at = np.full(1 << SLOT_BITS, len(chosen), np.int32)
    rank_at[chosen_slots[first]] = np.flatnonzero(first)
    at = np.flatnonzero(maybe)
    rank = rank_at[slots[at]]
    real = np.append(chosen, -1)[rank] == keys[at]
    others = np.flatnonzero(~first)
    if len(others):
        others = others[np.argsort(chosen[others])]
        shared = np.zeros(1 << SLOT_BITS, bool)
        shared[chosen_slots[others]] = True
        again = np.flatnonzero(~real & shared[slots[at]])
        found = others[np.minimum(np.searchsorted(chosen[others], keys[at[again]]), len(others) - 1)]
        hit = chosen[found] == keys[at[again]]
        rank[again[hit]], real[again[hit]] = found[hit], True
    return chosen, at[real], rank[real]


def compress(ids: np.ndarray, base: int, rounds: int | None = None, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of symbols and rules (n x 2) whose expansion is ``ids``.

    A round replaces the most frequent pairs at once; where two of them overlap
    the more frequent one is replaced, of equal ones every second from the left.
    Rounds end when no pair occurs ``least`` times, or after ``rounds``.
    """
    sequence, rules, symbols = ids.astype(np.int64), [np.empty((0, 2), np.int64)], base
    for _ in count() if rounds is None else range(rounds):
        if len(sequence) < 2:
            break
        keys = sequence[:-1] << 32
        keys |= sequence[1:]
        chosen, at, rank = _places(keys, pairs, least)
        if not len(chosen):
            break
        # the rank of every place and its neighbours; places of no chosen pair rank last
        ranks = np.full(len(keys) + 2, len(chosen), np.int32)
        ranks[at + 1] = rank
        left = ranks[at]
        run = np.maximum.accumulate(np.where(rank != left, at, 0))
        wins = (rank <= left) & (rank <= ranks[at + 2]) & ((at - run) % 2 == 0)
        at, rank = at[wins], rank[wins]
        used = np.unique(rank)
        renamed = np.zeros(len(chosen), np.int64)
        renamed[used] = symbols + np.arange(len(used))
        sequence[at] = renamed[rank]
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        rules.append(np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], 1))
        symbols += len(used)
    return sequence, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens that each rule expands to; rules refer only to earlier ones."""
    lengths = np.ones(len(rules), np.int64)
    pending = np.arange(len(rules))
    known = np.zeros(len(rules), bool)
    while len(pending):
        sides = rules[pending] - base
        ready = np.all((sides < 0) | known[np.maximum(sides, 0)], axis=1)
        of = np.where(sides < 0, 1, lengths[np.maximum(sides, 0)]).sum(1)
        lengths[pending[ready]] = of[ready]
        known[pending[ready]] = True
        pending = pending[~ready]
    return lengths


class Grammar:
    """The rules of a shard, expanded once; decodes any stretch of its sequence."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.base = base
        self.lengths = np.concatenate([np.ones(base, np.int64), lengths])
        self.first = np.concatenate([np.arange(base), base + np.cumsum(lengths) - lengths])
        self.flat = np.concatenate([np.arange(base, dtype=np.uint32), np.zeros(int(lengths.sum()), np.uint32)])
        # shorter expansions first: both sides of a rule are shorter than the rule
        for size in np.unique(lengths):
            of = np.flatnonzero(lengths == size)
            left, right = rules[of, 0], rules[of, 1]
            at = self.first[base + of]
            for symbol, to in ((left, at), (right, at + self.lengths[left])):
                self._copy(symbol, to)

    def _copy(self, symbols: np.ndarray, to: np.ndarray) -> None:
        n = self.lengths[symbols]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.flat[np.repeat(to, n) + step] = self.flat[np.repeat(self.first[symbols], n) + step]

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        after = np.cumsum(n)
        total = int(after[-1]) if len(after) else 0
        return self.flat[np.repeat(self.first[symbols] - (after - n), n) + np.arange(total)]

    def decode_range(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop; expansion lengths tell which symbols hold them, only those are expanded."""
        after = np.cumsum(self.lengths[symbols])
        a = int(np.searchsorted(after, start, "right"))
        b = int(np.searchsorted(after, stop, "left")) + 1
        before = int(after[a - 1]) if a else 0
        return self.decode(symbols[a:b])[start - before : stop - before]


def shard_row(part: int, shard: int, before: int, doc_ids: list, ids: np.ndarray, ends: np.ndarray, base: int) -> dict:
    """A row of the file format for the ids of some documents."""
    sequence, rules = compress(ids, base)
    high = sequence >> 16
    planes = [np.packbits((high >> k & 1).astype(bool)) for k in range(int(high.max(initial=0)).bit_length())]
    return {
        "part": part, "shard": shard, "before": before, "n_docs": len(doc_ids), "n_tokens": len(ids),
        "doc_ids": np.array([i for i in doc_ids if i is not None], "<i8").tobytes(), "doc_ends": ends.astype("<i8").tobytes(), "base": base,
        "rules": rules.astype("<u4").tobytes(), "lengths": rule_lengths(rules, base).astype("<u4").tobytes(),
        "low": (sequence & 0xFFFF).astype("<u2").tobytes(), "high": np.concatenate([np.empty(0, np.uint8), *planes]).tobytes(),
    }


def shard_symbols(row: dict) -> tuple[Grammar, np.ndarray]:
    """The grammar and the sequence of a row of the file format."""
    sequence = np.frombuffer(row["low"], "<u2").astype(np.int64)
    planes = np.frombuffer(row["high"], np.uint8)
    width = -(-len(sequence) // 8)
    for k in range(len(planes) // width if width else 0):
        sequence |= np.unpackbits(planes[k * width : (k + 1) * width], count=len(sequence)).astype(np.int64) << (16 + k)
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    return Grammar(row["base"], rules, np.frombuffer(row["lengths"], "<u4").astype(np.int64)), sequence


def write_shards(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write them in the file format to ``path``, by ascending id.

    Documents are dealt by ranges of the id, each task encodes its range in order
    and ends a shard after ``shard_tokens``, so a task holds one shard at a time.
    A null text is empty; ``end_id`` follows each document; repeated ids stand
    next to each other, by text; rows without an id come last, by text, over as many
    parts as they fill; an empty table gives no shards.  Other columns are not read.
    """

    def encode(batches):
        codec = encoder(vocabulary)
        base = max(codec.tokenizer.get_vocab_size(), end_id + 1)
        part = TaskContext.get().partitionId()
        shard = before = size = 0
        doc_ids, ids, sizes = [], [], []

        def flush():
            nonlocal shard, before, size
            row = shard_row(part, shard, before, doc_ids, np.concatenate(ids), np.cumsum(np.concatenate(sizes)), base)
            shard, before, size = shard + 1, before + row["n_tokens"], 0
            doc_ids.clear(), ids.clear(), sizes.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for a, b in in_slices(batch.column(1), ENCODE_BYTES):
                some, ends = codec.encode(batch.column(1)[a:b])
                some, ends = np.insert(some, ends, end_id), ends + np.arange(1, len(ends) + 1)
                names, done = batch.column(0)[a:b].to_pylist(), 0
                while done < len(names):
                    # a shard ends with the document that fills it
                    token = int(ends[done - 1]) if done else 0
                    stop = min(len(names), int(np.searchsorted(ends, token + shard_tokens - size)) + 1)
                    doc_ids += names[done:stop]
                    ids.append(some[token : ends[stop - 1]])
                    sizes.append(np.diff(ends[done:stop], prepend=token))
                    size += len(ids[-1])
                    done = stop
                    if size >= shard_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SHARD_SCHEMA.split(", "))])
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    order = F.asc_nulls_last("doc_id")
    # rows without an id are dealt by how their texts begin, in the order of the whole texts
    dealt = docs.repartitionByRange(order, F.when(F.col("doc_id").isNull(), F.left("text", F.lit(64))).asc())
    for_python(dealt.sortWithinPartitions(order, "text")).mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str, without_id: bool = False) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start (ids of all documents before it), ids (binary).

    Those without an id, the last ones, are read if ``without_id`` is set.

    A shard's start is its place in its part plus the tokens of the parts before;
    those are summed over one row per part.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("part_start"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grammar, sequence = shard_symbols(row)
                ends = np.frombuffer(row["doc_ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                data = pa.py_buffer(grammar.decode(sequence).astype("<u4").tobytes())
                edges = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32))
                named = np.frombuffer(row["doc_ids"], "<i8")
                doc_ids = pa.concat_arrays([pa.array(named), pa.nulls(len(ends) - len(named), pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), row["part"], np.int32)), doc_ids, pa.array(starts + row["before"]), pa.Array.from_buffers(pa.binary(), len(ends), [None, edges, data])],
                    names=["part", "doc_id", "at", "ids"],
                )

    docs = shards.mapInArrow(decode, "part int, doc_id long, at long, ids binary")
    docs = docs if without_id else docs.where("doc_id is not null")
    return docs.join(small_or_not(offsets), "part").select("doc_id", (F.col("at") + F.col("part_start")).alias("start"), "ids")
