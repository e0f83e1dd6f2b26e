"""Near duplicates by exact Jaccard similarity of word shingles.

Texts with equal shingle sets are one node.  Every shingle is a token, and all tokens
have one order: rarest first, by classes of how many documents hold them.  Two nodes
that are similar enough share a token in the prefixes of their sets, and a token that
no other document holds can't be shared, so most documents end there.

Tokens that are left list the nodes that hold them in their prefix.  The nodes of a
list meet one of them, its pivot.  What is not joined by that is compared pair by pair
in the lists of rare tokens.  Frequent tokens are combined with a second token: nodes
that reach the threshold together share more than they both share with the pivot, so
prefixes are extended by tokens that the pivot lacks, and lists are kept for pivot and
token.  These are searched in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, for_python, free_name, is_small, small_or_not, stored
from .encode import in_slices
from .words import words

#: Words of a shingle, percent of the union that must be shared.
SHINGLE, PERCENT = 5, 80
#: A token with more nodes in its list is frequent.
RARE = 64
#: A node of at most so many lists carries them, so that a pair is given out in the first one that it shares alone.
CARRIED = 256
#: How often frequent tokens are combined with another one before all pairs of a list are compared.
ROUNDS = 3
#: Members that are verified against a node by one task.
TOGETHER = 500
#: Bits of a token, of which a shared one has its class in front; their sum must fit 63.
TOKEN_BITS = 48
#: Classes to a doubling of the number of documents.  The last class is for tokens in more than ``HOT`` documents of a chunk.
CLASSES, LAST_CLASS, HOT = 16, 255, 64
#: Bytes of text in a chunk, and in a range of tokens that one task counts.
CHUNK_BYTES, RANGE_BYTES = 6_000_000, 8_000_000
#: Stands for a hot token's documents, which stay with their chunk.  A chunk has fewer documents.
ALL_DOCUMENTS = (1 << 16) - 1


def required(n):
    """Shingles that a set of n must share with any similar one."""
    return -(-n * PERCENT // 100)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; a text of fewer words has one, of none none."""
    known, numbers, ends = words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, known.to_pylist()), np.uint64, len(known))[numbers]
    mult = np.uint64(0x9E3779B97F4A7C15)

    def join(parts):
        key = np.zeros_like(parts[0])
        for x in parts:
            key = (key ^ x) * mult
            key ^= key >> np.uint64(29)
        return key

    n = max(0, len(hashed) - SHINGLE + 1)
    windows = join([hashed[k : k + n] for k in range(SHINGLE)]) if n else np.empty(0, np.uint64)
    sets, start = [], 0
    for end in ends.tolist():
        if end - start >= SHINGLE:
            sets.append(np.unique(windows[start : end - SHINGLE + 1]))
        elif end > start:
            sets.append(join([np.array([end - start], np.uint64), *(hashed[k : k + 1] for k in range(start, end))]))
        else:
            sets.append(np.empty(0, np.uint64))
        start = end
    return sets


def node_of(hashes: np.ndarray) -> int:
    """The node of a set: a 64-bit hash of all its shingles."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def packed(tokens: np.ndarray, docs: np.ndarray, classes: np.ndarray | None = None) -> bytes:
    """Ascending tokens as differences of 32 bits (larger ones apart), with a document of the chunk for each and perhaps a class."""
    steps = np.diff(tokens, prepend=tokens[:1])
    large = np.flatnonzero(steps >> 32)
    head = np.array([len(tokens), len(large), classes is not None, tokens[0] if len(tokens) else 0], "<i8")
    parts = [head, steps.astype("<u4"), large.astype("<u4"), (steps[large] >> 32).astype("<u4"), docs.astype("<u2"), *([] if classes is None else [classes.astype("u1")])]
    return b"".join(x.tobytes() for x in parts)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, documents and classes (the last class where none are given)."""
    n, m, classed, first = np.frombuffer(data, "<i8", 4).tolist()
    steps = np.frombuffer(data, "<u4", n, 32).astype(np.int64)
    at = 32 + 4 * n
    steps[np.frombuffer(data, "<u4", m, at)] |= np.frombuffer(data, "<u4", m, at + 4 * m).astype(np.int64) << 32
    at += 8 * m
    docs = np.frombuffer(data, "<u2", n, at)
    return first + np.cumsum(steps), docs, np.frombuffer(data, "u1", n, at + 2 * n) if classed else np.full(n, LAST_CLASS, np.uint8)


#: Rows between the steps below: a document (kind 0), tokens of a chunk (1), hot tokens of a chunk (2).
PARTS = "range long, kind int, chunk long, _row long, doc_id long, key long, n long, node long, at int, data binary"
PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]
PART_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in PARTS.split(", ")]


def _parts(rows: int, /, **columns) -> pa.RecordBatch:
    """A batch of so many rows of ``PARTS``; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[x], t) if x in columns else pa.nulls(rows, t) for x, t in zip(PART_NAMES, PART_TYPES, strict=True)], names=PART_NAMES)


def _chunk(doc_ids: pa.Array, texts: pa.Array, keys: pa.Array, row: int, chunk: int, edges: np.ndarray) -> list[pa.RecordBatch]:
    """``PARTS`` of the documents of one chunk, as in ``chunks``; ``edges`` are the first tokens of the ranges."""
    sets = shingle_sets(texts)
    nodes, n, of_chunk = np.array([node_of(s) for s in sets]), np.array([len(s) for s in sets]), np.full(len(sets), chunk)
    docs_of = _parts(
        len(sets), range=of_chunk % len(edges), kind=np.zeros(len(sets), np.int32), chunk=of_chunk, _row=row + np.arange(len(sets)),
        doc_id=doc_ids, key=keys, n=n, node=nodes, at=np.arange(len(sets), dtype=np.int32),
    )
    first = np.sort(np.unique(nodes, return_index=True)[1])
    tokens = (np.concatenate([sets[k] for k in first]) >> np.uint64(64 - TOKEN_BITS)).view(np.int64)
    docs = np.repeat(first, n[first]).astype(np.uint16)
    del sets
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    begin = np.flatnonzero(np.diff(tokens, prepend=-1))
    of = np.diff(np.append(begin, len(tokens)))
    hot = np.repeat(of > HOT, of)
    out = []
    if hot.any():
        out.append((chunk % len(edges), 2, packed(tokens[hot], docs[hot])))
        docs = np.where(hot, ALL_DOCUMENTS, docs)
        keep = ~hot
        keep[begin] = True
        tokens, docs = tokens[keep], docs[keep]
    cuts = np.append(np.searchsorted(tokens, edges), len(tokens))
    out += [(r, 1, packed(tokens[i:j], docs[i:j])) for r, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
    return [docs_of, _parts(len(out), range=[x[0] for x in out], kind=[x[1] for x in out], chunk=np.full(len(out), chunk), data=[x[2] for x in out])]


def chunks(df: DataFrame, ranges: int) -> DataFrame:
    """``PARTS`` of ``df`` (doc_id, text, key): each document in short, and the tokens of each chunk by range of token.

    Equal sets of a chunk give their tokens once; a token in more than ``HOT`` of
    its documents goes to its range once, and with its documents to the chunk alone.
    """
    edges = np.array([-(-(r << TOKEN_BITS) // ranges) for r in range(ranges)], np.int64)

    def run(batches):
        row = chunk = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start, stop in in_slices(batch.column(1), CHUNK_BYTES):
                for a in range(start, stop, ALL_DOCUMENTS):
                    b = min(stop, a + ALL_DOCUMENTS)
                    yield from _chunk(*(batch.column(k)[a:b] for k in range(3)), row, chunk, edges)
                    row, chunk = row + b - a, chunk + 1

    return for_python(df).mapInArrow(run, PARTS)


def _shared(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """The tokens of one range, by chunk, that more than one document holds, with their classes."""
    parts = [unpacked(data)[:2] for _, data in held]
    tokens, docs = (np.concatenate([p[k] for p in parts]) for k in range(2))
    order = np.argsort(tokens, kind="stable")
    begin = np.flatnonzero(np.diff(tokens[order], prepend=-1))
    of = np.diff(np.append(begin, len(tokens)))
    hot = np.logical_or.reduceat(docs[order] == ALL_DOCUMENTS, begin)
    class_of = np.where(hot, LAST_CLASS, np.minimum(LAST_CLASS - 1, (CLASSES * np.log2(of)).astype(np.int64)))
    classes, shared = np.empty(len(tokens), np.uint8), np.empty(len(tokens), bool)
    classes[order], shared[order] = np.repeat(class_of, of), np.repeat(hot | (of > 1), of)
    shared &= docs != ALL_DOCUMENTS
    out, start = [], 0
    for (chunk, _), part in zip(held, parts, strict=True):
        stop = start + len(part[0])
        keep = shared[start:stop]
        if keep.any():
            out.append((chunk, packed(part[0][keep], part[1][keep], classes[start:stop][keep])))
        start = stop
    return _parts(len(out), kind=np.ones(len(out), np.int32), chunk=[c for c, _ in out], data=[d for _, d in out])


def shared_tokens(parts: DataFrame, ranges: int) -> DataFrame:
    """``chunks`` with the tokens alone that more than one document holds. A task holds one range of tokens at a time."""

    def run(batches):
        current, held = None, []
        for batch in batches:
            counted = pc.equal(batch.column("kind"), 1)
            yield batch.filter(pc.invert(counted))
            rows = batch.select(["range", "chunk", "data"]).filter(counted)
            for r, chunk, data in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                if r != current and held:
                    yield _shared(held)
                    held = []
                current = r
                held.append((chunk, data))
        if held:
            yield _shared(held)

    return parts.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(run, PARTS)


#: Words of 64 parity bits that stand for a set's shared tokens.
PARITY_WORDS = 8

SETS = "_row long, node long, n long, s long, weight double, tokens binary, prefix array<long>, bits array<long>"


def parity_words(tokens: np.ndarray) -> np.ndarray:
    """One parity bit per slot of tokens; two sets differ in at least as many tokens as bits."""
    slots = 64 * PARITY_WORDS
    return np.packbits((np.bincount(tokens & (slots - 1), minlength=slots) & 1).astype(bool)).view("<i8")


def similar_sets(parts: DataFrame) -> DataFrame:
    """Documents that share enough tokens to be similar to any other one.

    ``tokens`` are the ``s`` shared ones of a set of ``n``, each with its class in
    front and so in the order of all tokens; ``prefix`` are the first of them that
    stand in the prefix of the set; ``weight`` is the mean class.
    """

    def sets_of(docs: list, held: list):
        at, rows, nodes, n = (np.array(x) for x in zip(*docs, strict=True))
        if not held:
            return
        found = [unpacked(x) for x in held]
        tokens, of, classes = (np.concatenate([f[k] for f in found]) for k in range(3))
        tokens |= classes.astype(np.int64) << TOKEN_BITS
        order = np.lexsort((tokens, of))
        tokens, of = tokens[order], of[order]
        size = np.zeros(int(at.max()) + 1, np.int64)
        size[at] = n
        s = np.bincount(of, minlength=len(size))
        start = np.cumsum(s) - s
        kept = np.flatnonzero((s > 0) & (s >= required(size)))
        place = np.zeros(len(size), np.int64)
        place[at] = np.arange(len(at))
        own = [tokens[start[k] : start[k] + s[k]] for k in kept]
        place = place[kept]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[place]), pa.array(nodes[place]), pa.array(n[place]), pa.array(s[kept]), pa.array([float((x >> TOKEN_BITS).mean()) for x in own], pa.float64()),
             pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x[: len(x) - required(int(k)) + 1] for x, k in zip(own, n[place], strict=True)], pa.list_(pa.int64())),
             pa.array([parity_words(x) for x in own], pa.list_(pa.int64()))],
            names=[x.split()[0] for x in SETS.split(", ")],
        )

    def run(batches):
        current, docs, held = None, [], []
        for batch in batches:
            names = ("chunk", "kind", "at", "_row", "node", "n", "data")
            for chunk, kind, at, row, node, n, data in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if chunk != current:
                    if held:
                        yield sets_of(docs, held)
                    current, docs, held = chunk, [], []
                if kind == 0:
                    docs.append((at, row, node, n))
                else:
                    held.append(data)
        if held:
            yield sets_of(docs, held)

    return parts.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, SETS)


class _Search:
    """State of one search: the documents in short, the nodes that may be similar to others, and the components so far."""

    def __init__(self, df: DataFrame):
        n_bytes = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(1, -(-n_bytes // RANGE_BYTES))
        self.parts = stored(shared_tokens(chunks(df, ranges), ranges), "tokens")
        self.docs = self.parts.where("kind = 0").select("_row", "doc_id", "key", "n", "node")
        found = stored(similar_sets(self.parts), "sets")
        several = found.groupBy("node").agg(F.min("_row").alias("_first"), F.count("*").alias("_of")).where("_of > 1").select("node", "_first")
        copies = stored(found.select("_row", "node").join(small_or_not(stored(several, "several")), "node").where("_row != _first").select("_row"), "copies")
        self.found = found
        self.nodes = found.join(small_or_not(copies), "_row", "left_anti").drop("_row")
        self.labels = None  # node, label of the linked nodes

    def with_labels(self, rows: DataFrame, of: str = "node", label: str = "label") -> DataFrame:
        """``rows`` with the component of a node."""
        if self.labels is None:
            return rows.withColumn(label, F.col(of))
        labels = self.labels.select(F.col("node").alias(of), F.col("label").alias(label))
        return rows.join(labels, of, "left").withColumn(label, F.coalesce(label, of))

    def link(self, met: DataFrame) -> None:
        """Join the components of the pairs (a, b) that are linked."""
        links = met.where("link").select("a", "b")
        new = self.with_labels(self.with_labels(links, "a", "_a"), "b", "_b").where("_a != _b").select("a", "b")
        if not new.limit(1).count():
            return
        if self.labels is not None:
            new = new.unionByName(self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b"))
        self.labels = components(new)

    def met(self, pairs: DataFrame) -> DataFrame:
        """a, b, shared, link, extra of pairs of nodes, from their sets: whether they are similar, and the prefix of what b has and a lacks.

        A node meets its partners in parts of ``TOGETHER``.
        """
        sets = self.nodes.select("node", "n", "tokens")
        pairs = stored(pairs.distinct(), "pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("_parts"))
        members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"))
        heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node"))
        dealt = sets.join(small_or_not(stored(heads.unionByName(members), "dealt")), "node").select("a", "part", "role", "node", "n", "tokens")

        def verify(batches):
            own, size = None, 0
            for batch in batches:
                rows = []
                for a, role, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "node", "n", "tokens")), strict=True):
                    tokens = np.frombuffer(data, "<i8")
                    if role == 0:
                        own, size = tokens, n
                    else:
                        here = own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens
                        shared = int(here.sum())
                        extra = tokens[~here]
                        # similar nodes share at least so many tokens that a lacks, or none of these need be shared
                        extra = extra[: max(0, len(extra) - max(1, required(n) - shared) + 1)]
                        rows.append((a, b, shared, 100 * shared >= PERCENT * (size + n - shared), extra))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=["a", "b", "shared", "link", "extra"])

        met = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(verify, "a long, b long, shared long, link boolean, extra array<long>")
        return stored(met, "met")

    def led(self, rows: DataFrame) -> DataFrame:
        """Those of (key, node, n, s, weight) whose list holds several components, with its pivot.

        The smaller of two similar sets shares so many of its tokens that it is
        *full*; others stay only if a full one of the list is small enough for them.
        The pivot is the full node that shares most.
        """
        rows = self.with_labels(rows)
        full = 2 * PERCENT * F.col("n") <= (100 + PERCENT) * F.col("s")
        lists = rows.groupBy("key").agg(
            F.min("label").alias("_low"), F.max("label").alias("_high"), F.min(F.when(full, F.col("n"))).alias("_least"),
            F.max_by(F.struct("node", "n"), F.when(full, F.struct("weight", "node"))).alias("_pivot"),
        )
        lists = stored(lists.where("_low != _high and _least is not null").select("key", "_least", F.col("_pivot.node").alias("pivot"), F.col("_pivot.n").alias("pivot_n")), "lists")
        able = PERCENT * (F.col("n") + F.col("_least")) <= (100 + PERCENT) * F.col("s")
        return stored(rows.join(small_or_not(lists), "key").where(full | able).drop("_least", "label"), "list-rows")

    def around_fewer(self, frequent: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
        """pivot, pivot_n, node, n, s, weight around fewer pivots, and what these have met.

        Lists of one family choose many pivots, and a node would be combined around each
        of them.  A node votes for that of its pivots which shares most with all its nodes,
        and a pivot gives its nodes to the one that most of them vote for.  Combinations
        find all pairs around one pivot, so nodes that meet around the old pivot meet
        around the new one.
        """
        pivots = stored(frequent.groupBy("pivot").agg(F.first("pivot_n").alias("pivot_n"), F.sum("shared").alias("_of")), "pivots")
        votes = frequent.select("pivot", "node").join(small_or_not(pivots), "pivot")
        votes = votes.groupBy("node").agg(F.max(F.struct("_of", "pivot", "pivot_n")).alias("_to"))
        leads = frequent.select("pivot", "node").join(votes, "node").groupBy("pivot", "_to").count()
        leads = stored(leads.groupBy("pivot").agg(F.max(F.struct("count", "_to")).alias("_to")).select("pivot", F.col("_to._to.pivot").alias("leader"), F.col("_to._to.pivot_n").alias("leader_n")), "leads")
        rows = frequent.drop("pivot_n", "shared").join(small_or_not(leads), "pivot")
        rows = stored(rows.select(F.col("leader").alias("pivot"), F.col("leader_n").alias("pivot_n"), "node", "n", "s", "weight").distinct(), "around-fewer")
        pairs = rows.where("pivot != node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        more = self.met(pairs.join(met.select("a", "b"), ["a", "b"], "left_anti"))
        self.link(more)
        return rows, met.unionByName(more)

    def look(self) -> None:
        """Find all links."""
        rows = self.nodes.select(F.explode("prefix").alias("key"), "node", "n", "s", "weight")
        for turn in range(ROUNDS):
            rows = self.led(rows)
            met = self.met(rows.where("pivot != node").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
            self.link(met)
            labelled = self.with_labels(rows)
            lists = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("length"))
            lists = stored(lists.where("_low != _high").select("key", "length"), "mixed")
            left = labelled.join(small_or_not(lists), "key").join(met.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "shared"), ["pivot", "node"], "left")
            left = stored(left.withColumn("shared", F.coalesce("shared", "s")), "mixed-rows")  # a pivot shares all with itself
            last = turn == ROUNDS - 1
            rare = left if last else left.where(F.col("length") <= RARE)
            self.link(self.met(pairs_in(rare.join(self.nodes.select("node", "bits"), "node"), carry=turn > 0)))
            frequent = stored(left.where(F.col("length") > RARE).select("pivot", "pivot_n", "node", "n", "s", "weight", "shared").distinct(), "frequent")
            if last or not frequent.limit(1).count():
                return
            frequent, met = self.around_fewer(frequent, met)
            rows = self.with_labels(self.with_labels(frequent), "pivot", "_pivot_label").join(met.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "shared", "extra"), ["pivot", "node"])
            # a pair that the pivot's component doesn't hold shares at least ``need`` tokens besides the pivot's; those within it need only what one outside does
            outside, need = F.col("label") != F.col("_pivot_label"), F.greatest(F.ceil(F.col("n") * PERCENT / 100) - F.col("shared"), F.lit(1))
            rows = stored(rows.select("pivot", "pivot_n", "node", "n", "s", "weight", "shared", "extra", outside.alias("outside"), need.alias("need")), "around-pivots")
            rows = rows.join(small_or_not(stored(rows.where("outside").groupBy("pivot").agg(F.min("need").alias("least")), "needs")), "pivot")
            fewer = F.when(F.col("outside"), F.lit(0)).otherwise(F.greatest(F.col("least") - F.col("need"), F.lit(0)))
            extra = F.slice("extra", F.lit(1), F.greatest(F.size("extra") - fewer, F.lit(0)).cast("int"))
            # or it shares no more than each of it shares with the pivot, and one of it is smaller than the pivot
            within = (100 * F.col("shared") >= PERCENT * F.col("n")) & (F.col("outside") | (F.col("n") < F.col("pivot_n")))
            extra = F.when(within, F.array_append(extra, F.lit(-1).cast("long"))).otherwise(extra)
            rows = rows.select(F.explode(extra).alias("token"), "pivot", "node", "n", "s", "weight")
            rows = stored(rows.select(F.xxhash64("pivot", "token").alias("key"), "node", "n", "s", "weight"), "combinations")


def pairs_in(rows: DataFrame, carry: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes in one list that are not yet joined, unless what they share with others and with the pivot, or their parity bits, rule it out.

    Nodes share a list for each pivot and token that they have in common.  With
    ``carry`` a pair comes out of the first of these alone, if both nodes are in few enough.
    """
    rows, lists = stored(rows, "list-nodes"), F.lit(None).cast("array<long>")
    if carry:
        of_node = rows.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("lists")).where(F.size("lists") <= CARRIED)
        rows, lists = stored(rows.join(of_node, "node", "left"), "list-members"), F.col("lists")
    rows = rows.withColumn("lists", lists)
    side = lambda x: rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "s", "label", "shared", "bits", "lists")))
    met = side("a").join(side("b"), "key").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")))
    # similar sets share at least PERCENT / (100 + PERCENT) of the sum of their sizes
    least, whole = PERCENT * (F.col("n_a") + F.col("n_b")), 100 + PERCENT
    most = F.least("shared_a", "shared_b") + F.least(F.col("s_a") - F.col("shared_a"), F.col("s_b") - F.col("shared_b"))
    differ = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    possible = (least <= whole * most) & (2 * least <= whole * (F.col("s_a") + F.col("s_b") - differ)) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    if carry:
        possible &= F.coalesce(F.element_at(F.array_intersect("lists_a", "lists_b"), 1) == F.col("key"), F.lit(True))
    return met.where(possible).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, label of every linked node; the label is the smallest node of its component.

    Labels spread to neighbours and each label is then looked up in turn, so long
    chains shorten by half or more in every round.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), "labels")
    hint = F.broadcast if is_small(labels) else lambda df: df  # labels stay as many
    while True:
        near = edges.join(hint(labels.select(F.col("node").alias("b"), "label")), "b").groupBy("a").agg(F.min("label").alias("_near"))
        spread = labels.join(hint(near), labels["node"] == near["a"]).select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        target = hint(spread.select(F.col("node").alias("label"), F.col("label").alias("_to")))
        new = stored(spread.join(target, "label", "left").select("node", "_old", F.least("label", F.coalesce("_to", "label")).alias("label")), "labels")
        discard(labels)
        labels = new.select("node", "label")
        if not new.where("label != _old").limit(1).count():
            return hint(labels)


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a row's id and text; identical rows have the same."""
    return F.xxhash64(doc_id.cast("long"), F.xxhash64(text.cast("string")))


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, key (``row_key``), n, node, component_id and label (of its component; null if the row is alone)."""
    key = row_key(df[id_col], df[text_col])
    search = _Search(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), key.alias("key")))
    search.look()
    discard(search.found)
    nodes = search.docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("_of"))
    nodes = stored(search.with_labels(nodes), "node-labels")
    several = stored(nodes.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("_of").alias("_of")).where("_of > 1").select("label", "component_id"), "components")
    of_node = stored(nodes.select("node", "label").join(small_or_not(several), "label"), "node-components").select("node", "label", "component_id")
    rows = search.docs.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    joined = rows.join(small_or_not(of_node), "node", "left")
    return joined.select("doc_id", "key", "n", "node", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    Documents are linked if their sets of five-word shingles share 80 percent of their
    union; ``component_id`` is the smallest doc_id reachable, ``class_id`` the node of
    equal sets (null without shingles).  Shingles are counted by 64-bit hashes and
    compared between documents by their first 48 bits.

    Copies are one node; very similar texts are joined along stars, so a group of n
    gives about n pairs.  Texts are read once; hashes of shingles are shuffled once,
    and after that only documents of whose shingles four fifths occur elsewhere.  A
    task that runs again must find the same rows in the same order, as in a scan of
    tables.  A null, empty or blank text has no shingles and is linked with nothing;
    repeated rows are linked with each other; rows without an id are kept, and their
    group has an id if another row does.  An empty table gives no rows.  Other columns
    are not read.
    """
    rows = grouped(df, id_col, text_col)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("node").alias("class_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one document of each group, that of the smallest id, and every row without shingles.

    All columns stay as they are, whatever their names.  Rows that go are named by key
    and filtered out; texts are shuffled only if there are too many keys to broadcast.
    Of identical rows one stays; null, empty and blank texts all stay, repeated ones too;
    of a group without ids one row stays; an empty table gives no rows.
    """
    rows = stored(grouped(df, id_col, text_col).where("label is not null").select("doc_id", "key", "label"), "groups")
    kept = rows.groupBy("label").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("kept"))
    several = stored(rows.join(small_or_not(stored(kept, "kept")), "label"), "several")
    name = free_name(df, "_key")
    gone = stored(several.where("key != kept").select(F.col("key").alias(name)).distinct(), "gone")
    twice = stored(several.where("key = kept").groupBy(F.col("key").alias(name)).count().where("count > 1").select(name), "twice")
    keyed = df.withColumn(name, row_key(df[id_col], df[text_col]))
    stays = keyed.join(small_or_not(gone), name, "left_anti")
    if twice.limit(1).count():
        repeated = small_or_not(twice)
        stays = stays.join(repeated, name, "left_anti").unionByName(stays.join(repeated, name, "left_semi").dropDuplicates([name]))
    return stays.drop(name)
