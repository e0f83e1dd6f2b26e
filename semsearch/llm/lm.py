"""Brown class-based bigrams: log10 P(text) = sum of log10 P(class | class before) P(word | class).

All words seen often enough are put into classes by exchange clustering; all other words
fall into a class by their last character, and the end of a text is a class of its own.
Words never seen share what their class holds back by their spelling.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .encode import in_slices
from .words import words

#: Words sent to every task at most, and how often a word must occur to be clustered.
FREQUENT, LEAST = 1 << 18, 100
#: Classes to the fourth root of the number of clustered words.
CLASSES = 12
#: Rounds of exchange end when the likelihood of the classes rises by a smaller share than this.
GAIN = 1e-3
#: Weight of a class's overall share against what follows the class before.
TRANSITION_PRIOR = 20.0
#: Classes of the other words by what they end with: a full stop, a comma, a letter or digit, anything else.
SHAPES = 4


def shape_of(words_: pa.Array) -> np.ndarray:
    """The shape, 0 to 3, of each word."""
    last = pc.utf8_slice_codeunits(words_, -1)
    stop, comma, letter = (pc.match_substring_regex(last, x).to_numpy(zero_copy_only=False) for x in (r"\.", ",", r"[\p{L}\p{N}]"))
    return np.select([stop, comma, letter], [0, 1, 2], 3)


def shape_column(word: Column) -> Column:
    last = F.right(word, F.lit(1))
    return F.when(last == ".", 0).when(last == ",", 1).when(last.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all texts; every task counts before anything is shuffled."""

    def count(batches):
        names, counts = [], []

        def merged():
            coded = pa.chunked_array(names).combine_chunks().dictionary_encode()
            return coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate(counts), len(coded.dictionary)).astype(np.int64)

        for batch in batches:
            for a, b in in_slices(batch.column(0)):
                known, numbers, _ = words(pc.ascii_lower(pc.fill_null(batch.column(0)[a:b], "")))
                n = np.bincount(numbers, minlength=len(known))
                names.append(known.filter(pa.array(n > 0)))
                counts.append(n[n > 0])
                if len(names) == 8:
                    one, n = merged()
                    names, counts = [one], [n]
        if names:
            one, n = merged()
            for k in range(0, len(one), 50_000):
                yield pa.RecordBatch.from_arrays([one[k : k + 50_000], pa.array(n[k : k + 50_000])], names=["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _items(texts: pa.Array, frequent: pa.Array, clustered: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of lower-cased texts: each word's item (a clustered word, or a shape after these), where texts end, distinct words, their numbers, ranks."""
    known, numbers, ends = words(texts)
    rank = pc.fill_null(pc.index_in(known, value_set=frequent), -1).to_numpy(zero_copy_only=False)
    item = np.where((rank >= 0) & (rank < clustered), rank, clustered + shape_of(known))
    return item[numbers], ends, known, numbers, rank


def _with_ends(items: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    return np.insert(items, ends, end)


def count_pairs(texts: DataFrame, held) -> DataFrame:
    """pair, n: how often an item follows another; pair = before * items + after. Texts start after an end."""

    def count(batches):
        frequent, clustered = held.value
        size = clustered + SHAPES + 1
        keys, counts = [], []

        def merged():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for a, b in in_slices(batch.column(0)):
                items, ends, *_ = _items(pc.ascii_lower(pc.fill_null(batch.column(0)[a:b], "")), frequent, clustered)
                line = _with_ends(items, ends, size - 1).astype(np.int64)
                key, n = np.unique(np.concatenate([[size - 1], line[:-1]]) * size + line, return_counts=True)
                keys.append(key)
                counts.append(n)
                if len(keys) == 8:
                    key, n = merged()
                    keys, counts = [key], [n]
        if keys:
            key, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


#: Bits of an item's number beside the count and the side in an entry of ``contexts``.
ITEM_BITS = 22


def contexts(pairs: DataFrame, size: int) -> DataFrame:
    """Each item's neighbours, as arrays no longer than there are items: item, after, n_after, before, n_before.

    A neighbour is shuffled as one number: its count, its item, its side.
    """
    a, b = F.floor(F.col("pair") / size), F.col("pair") % size
    entry = lambda other, side: F.shiftleft("n", ITEM_BITS + 1) + other.cast("long") * 2 + side
    both = F.array(F.struct(a.cast("int").alias("item"), entry(b, 0).alias("e")), F.struct(b.cast("int").alias("item"), entry(a, 1).alias("e")))
    lists = pairs.select(F.explode(both).alias("s")).groupBy("s.item").agg(F.collect_list("s.e").alias("l"))
    on = lambda side: F.filter("l", lambda x: x.bitwiseAND(F.lit(1)) == side)
    other = lambda side: F.transform(on(side), lambda x: F.shiftright(x, 1).bitwiseAND(F.lit((1 << ITEM_BITS) - 1)).cast("int"))
    count = lambda side: F.transform(on(side), lambda x: F.shiftright(x, ITEM_BITS + 1))
    return lists.select("item", other(0).alias("after"), count(0).alias("n_after"), other(1).alias("before"), count(1).alias("n_before"))


def _by_class(batch: pa.RecordBatch, side: int, classes: np.ndarray, total: int) -> np.ndarray:
    """For every item of a batch its neighbours on a side, counted by class."""
    others, n = batch.column(1 + 2 * side), batch.column(2 + 2 * side)
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(others).to_numpy(zero_copy_only=False))
    return np.bincount(row * total + classes[others.flatten().to_numpy()], n.flatten().to_numpy(), len(batch) * total).reshape(-1, total)


def class_counts(around: DataFrame, classes: np.ndarray, total: int) -> np.ndarray:
    """How often a class follows another: each task sums its items, and the small matrices are added up."""

    def count(batches):
        sums = np.zeros((total, total))
        for batch in batches:
            np.add.at(sums, classes[batch.column(0).to_numpy()], _by_class(batch, 0, classes, total))
        row, col = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(sums[row, col].astype(np.int64))], names=["a", "b", "n"])

    sums = np.zeros((total, total))
    for r in around.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        sums[r.a, r.b] = r.n
    return sums


def best_class(own: int, after: np.ndarray, before: np.ndarray, itself: float, counts: np.ndarray, n_movable: int, logs: np.ndarray | None = None) -> int:
    """The class whose likelihood gains most from a word; it stays on equal gains.

    ``after`` and ``before`` count the classes on its right and left; ``counts`` are
    those of all classes, the word still in ``own``, and ``logs`` their x log x.  Only
    classes next to the word make a difference.
    """
    logs = _xlogx(counts) if logs is None else logs
    after, before = after.astype(float), before.astype(float)
    n_after, n_before = after.sum(), before.sum()

    def side(counts, logs, beside, across):
        """What a row of counts gains if the word's neighbours on one side are added to it; the word is taken away first."""
        alone = beside.copy()
        alone[own] -= itself
        at = np.flatnonzero(alone)
        rows, base = counts[:n_movable, at], logs[:n_movable, at]
        rows[own] -= beside[at]
        base[own] = _xlogx(rows[own])
        if alone[own]:
            k = int(np.searchsorted(at, own))
            rows[:, k] -= across[:n_movable]
            rows[own, k] += itself  # it was taken away twice
            base[:, k] = _xlogx(rows[:, k])
        return alone, (_xlogx(rows + alone[at]) - base).sum(1)

    right, gain = side(counts, logs, after, before)
    left, gain_left = side(counts.T, logs.T, before, after)
    gain += gain_left
    k = np.arange(n_movable)
    corner = counts[k, k].copy()  # a class before or after itself is in both sums
    if own < n_movable:
        corner[own] += itself - after[own] - before[own]
    gain += _xlogx(corner + right[k] + left[k] + itself) - _xlogx(corner + right[k]) - _xlogx(corner + left[k]) + _xlogx(corner)
    # what stands left of the word counts for its class whatever class the word is in, and so on its right
    for total, n in ((counts.sum(1)[:n_movable], n_after), (counts.sum(0)[:n_movable], n_before)):
        if own < n_movable:
            total[own] -= n
        gain -= _xlogx(total + n) - _xlogx(total)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-9 else own


def exchange(around: DataFrame, clustered: int, n_classes: int, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the items and the counts of class pairs, from ``contexts``.

    In a round every task finds the best class of its words against the same
    counts; half of the words, the others in the next round, move, as words that
    move together would follow each other.  Rounds end when two of them together
    raise the likelihood by a share below ``gain``.
    """
    spark, total = around.sparkSession, n_classes + SHAPES + 1
    classes = np.concatenate([np.arange(clustered) % n_classes, np.arange(n_classes, total)])
    best, before_last, turn = (-np.inf, classes, np.zeros((total, total))), -np.inf, 0
    while True:
        counts = class_counts(around, classes, total)
        likelihood = _xlogx(counts).sum() - _xlogx(counts.sum(0)).sum() - _xlogx(counts.sum(1)).sum()
        if turn % 2 == 0:
            stop = turn and likelihood - before_last < gain * abs(before_last)
            before_last = likelihood
        if likelihood > best[0]:
            best = (likelihood, classes, counts)
        if stop or clustered < 2 or n_classes < 2:
            return best[1], best[2]
        held = spark.sparkContext.broadcast((classes, counts))

        def choose(batches, held=held, turn=turn):
            classes, counts = held.value
            logs = _xlogx(counts)
            for batch in batches:
                items = batch.column(0).to_numpy()
                batch = batch.filter(pa.array((items < clustered) & ((items // n_classes + items + turn) % 2 == 0)))
                chosen = []
                for a in range(0, len(batch), 1024):
                    part = batch.slice(a, 1024)
                    after, before = _by_class(part, 0, classes, total), _by_class(part, 1, classes, total)
                    for k, item in enumerate(part.column(0).to_pylist()):
                        others, n = part.column(1)[k].values.to_numpy(), part.column(2)[k].values.to_numpy()
                        chosen.append(best_class(int(classes[item]), after[k], before[k], float(n[others == item].sum()), counts, n_classes, logs))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32())], names=["item", "class"])

        classes = classes.copy()
        for r in around.mapInArrow(choose, "item int, class int").collect():  # a row per clustered word at most
            classes[r["item"]] = r["class"]
        held.destroy()
        turn += 1


def byte_pairs(words_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte before each byte of the words (256 before the first), the bytes, and where words end."""
    at = np.frombuffer(words_.buffers()[1], np.int32)[words_.offset : words_.offset + len(words_) + 1].astype(np.int64)
    data = np.frombuffer(words_.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.int64)
    before = np.concatenate([[256], data[:-1]])[: len(data)]
    before[at[:-1] - at[0]] = 256
    return before, data, at[1:] - at[0]


def spelling(words_: DataFrame, weight: float = 0.1) -> np.ndarray:
    """log10 P(byte | byte before) over the distinct words (one string column), 257 x 257; 256 is the edge of a word."""

    def count(batches):
        sums = np.zeros((257, 257), np.int64)
        for batch in batches:
            if len(batch):
                before, data, ends = byte_pairs(batch.column(0))
                np.add.at(sums, (before, data), 1)
                np.add.at(sums, (data[ends - 1], np.full(len(ends), 256)), 1)
        a, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[a, b])], names=["a", "b", "n"])

    sums = np.full((257, 257), weight)
    sums[256, 256] = 0  # a word has a byte
    for r in words_.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        sums[r.a, r.b] += r.n
    return np.log10(np.maximum(sums, 1e-300) / sums.sum(1, keepdims=True))


def spelled(words_: pa.Array, table: np.ndarray) -> np.ndarray:
    """log10 of each word's probability by its spelling."""
    if not len(words_):
        return np.empty(0)
    before, data, ends = byte_pairs(words_)
    sums = np.concatenate([[0], np.cumsum(table[before, data])])
    return np.diff(sums[np.concatenate([[0], ends])]) + table[data[ends - 1], 256]


@dataclass
class BrownModel:
    """What scoring needs: bounded tables for the driver and tasks, and ``rare`` (word, n) for all other words."""

    n_tokens: int  #: training tokens, ends included
    n_distinct: int
    n_ends: int
    frequent: pa.Array  #: words by falling count
    counts: np.ndarray  #: their counts
    clustered: int
    classes: np.ndarray  #: of the clustered words, the shapes and the end
    transitions: np.ndarray  #: log10 P(class | class before)
    emissions: np.ndarray  #: log10 P(word | class) of the frequent words
    shapes: list[tuple[float, float, float]] = field(default_factory=list)  #: discount, log10 of tokens, log10 of the unseen share
    spelling: np.ndarray | None = None  #: log10 P(byte | byte before), by which unseen words divide that share
    rare: DataFrame | None = None


def fit(texts: DataFrame, frequent: int = FREQUENT, least: int = LEAST, classes: int | None = None, gain: float = GAIN) -> BrownModel:
    """Learn from all ``texts`` (one string column).

    Counts of all words stay a table; at most ``frequent`` of them, the bound of
    what is sent to tasks, are read by the driver, and class tables.  Of these all
    that occur ``least`` times are clustered, into ``CLASSES`` times the fourth root
    of their number unless ``classes`` are given.  Words under a shape give up a
    discount (from their words seen once and twice), the share of words never seen,
    of which each one gets its part by its spelling.
    """
    spark = texts.sparkSession
    vocabulary = stored(count_words(texts), "vocabulary")
    n_ends = texts.count()
    step = F.floor(F.log2("n") * 16)
    by_count = vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("of"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # a thousand steps at most
    n_words, n_distinct = sum(r.n for r in by_count), sum(r.of for r in by_count)
    bar, so_far = float("inf"), 0
    for r in by_count:  # all words with a count from ``bar`` on are no more than ``frequent``
        so_far += r.of
        if so_far > frequent:
            break
        bar = r.least
    top = [] if bar == float("inf") else vocabulary.where(F.col("n") >= bar).orderBy(F.desc("n"), "word").collect()
    names, counts = pa.array([r.word for r in top], pa.string()), np.array([r.n for r in top], np.int64)
    clustered = int((counts >= least).sum())
    classes = classes or round(CLASSES * clustered**0.25)
    classes = max(1, min(classes, clustered))
    held = spark.sparkContext.broadcast((names, clustered))
    around = stored(contexts(count_pairs(texts, held), clustered + SHAPES + 1), "contexts")
    of, between = exchange(around, clustered, classes, gain)

    total = between.sum()
    share = (between.sum(0) + 1) / (total + len(between))
    transitions = np.log10((between + TRANSITION_PRIOR * share) / (between.sum(1, keepdims=True) + TRANSITION_PRIOR))
    in_class = np.bincount(of[:clustered], counts[:clustered], len(between))

    rare = vocabulary.where(F.col("n") < (int(counts[clustered - 1]) if clustered else 1 << 62))  # all that are not clustered
    measures = rare.groupBy(shape_column(F.col("word")).alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("of"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"))
    found = {r["shape"]: [float(r["n"]), r["of"], r["one"], r["two"]] for r in measures.collect()}
    shape = shape_of(names)
    shapes = []
    for k in range(SHAPES):
        n, of_, one, two = found.get(k, [0.0, 0, 0, 0])
        discount = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
        shapes.append((discount, float(np.log10(n)) if n else 0.0, float(np.log10(discount * of_ / n)) if n else 0.0))
    emissions = np.empty(len(names))
    emissions[:clustered] = np.log10(counts[:clustered] / np.maximum(in_class[of[:clustered]], 1))
    for k in range(SHAPES):
        under = (np.arange(len(names)) >= clustered) & (shape == k)
        emissions[under] = np.log10(counts[under] - shapes[k][0]) - shapes[k][1]
    return BrownModel(
        n_tokens=int(n_words + n_ends), n_distinct=int(n_distinct + (n_ends > 0)), n_ends=n_ends, frequent=names, counts=counts, clustered=clustered,
        classes=of, transitions=transitions, emissions=emissions, shapes=shapes, spelling=spelling(rare.select("word")), rare=vocabulary.where(F.col("n") < (bar if top else 1 << 62)),
    )


def score(df: DataFrame, model: BrownModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of every row with n_tokens, n_known, train_tokens, base_score, score.

    A task adds up what frequent words and classes give.  Only other words are
    shuffled, once per row and word, to meet their counts.
    """
    carry = carry or []
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((model.frequent, model.counts, model.clustered, model.classes, model.transitions, model.emissions, model.spelling))
    n_ends = model.n_ends
    kinds = df.select(*carry).schema
    partial = "_row long, n_tokens long, _known long, _base double, _score double, _rare array<struct<word: string, n: int, spelled: float>>"

    def add_up(batches):
        frequent, counts, clustered, classes, transitions, emissions, table = held.value
        row, end = TaskContext.get().partitionId() << 36, clustered + SHAPES
        logs = np.log10(counts + 1.0)
        for batch in batches:
            for a, b in in_slices(batch.column(len(carry))):
                texts = pc.ascii_lower(pc.fill_null(batch.column(len(carry))[a:b], ""))
                items, ends, known, numbers, rank = _items(texts, frequent, clustered)
                starts = np.concatenate([[0], ends[:-1]])
                seen = rank >= 0
                of_word = np.stack([np.where(seen, logs[rank] if len(logs) else 0, 0), np.where(seen, emissions[rank] if len(logs) else 0, 0), seen])
                sums = np.concatenate([np.zeros((3, 1)), np.cumsum(of_word[:, numbers], 1)], 1)
                sums = sums[:, ends] - sums[:, starts]
                line = classes[_with_ends(items, ends, end)]
                step = np.concatenate([[0], np.cumsum(transitions[np.concatenate([[classes[end]], line[:-1]]), line])])
                edges = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                moves = step[edges[1:]] - step[edges[:-1]]
                # other words, once for each text
                other = ~seen[numbers]
                doc = np.repeat(np.arange(len(ends)), ends - starts)[other].astype(np.int64)
                pair, n = np.unique(doc * max(1, len(known)) + numbers[other], return_counts=True)
                at = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(known)), minlength=len(ends)))]).astype(np.int32)
                word = pair % max(1, len(known))
                by_letters = spelled(known, table).astype(np.float32)
                rare = pa.StructArray.from_arrays([known.take(pa.array(word)), pa.array(n.astype(np.int32)), pa.array(by_letters[word])], names=["word", "n", "spelled"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[a:b] for k in range(len(carry))), pa.array(row + np.arange(len(ends))), pa.array(ends - starts + 1), pa.array(sums[2].astype(np.int64) + (n_ends > 0)),
                     pa.array(sums[0] + np.log10(n_ends + 1)), pa.array(sums[1] + moves), pa.ListArray.from_arrays(pa.array(at), rare)],
                    names=[*carry, *(x.split()[0] for x in ("_row", "n_tokens", "_known", "_base", "_score", "_rare"))],
                )
                row += len(ends)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), partial])
    rows = stored(df.select(*carry, df[text_col].cast("string")).mapInArrow(add_up, schema), "partial-scores")
    word = F.col("word")
    used = rows.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.spelled", F.col("r.n").alias("_n"))
    met = used.join(model.rare.select("word", F.col("n").alias("_c")), "word", "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    shape, emission = shape_column(word), F.lit(0.0)
    for k, (discount, tokens, unseen) in enumerate(model.shapes):
        emission = F.when(shape == k, F.when(F.col("_c") > 0, F.log10(F.col("_c") - discount) - tokens).otherwise(F.col("spelled") + unseen)).otherwise(emission)
    n = F.col("_n")
    rest = met.groupBy("_row").agg(
        F.sum(n * F.log10(F.col("_c") + 1.0)).alias("_base2"), F.sum(n * emission).alias("_score2"), F.sum(F.when(F.col("_c") > 0, n).otherwise(0)).alias("_known2")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    spread = float(np.log10(model.n_tokens + model.n_distinct + 1))
    return rows.drop("_rare").join(rest, "_row", "left").select(
        *carry, "n_tokens", (F.col("_known") + zero("_known2")).cast("long").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + zero("_base2") - F.col("n_tokens") * spread).alias("base_score"), (F.col("_score") + zero("_score2")).alias("score"),
    )


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, **fitting) -> DataFrame:
    """Fit on the documents outside the held-out fold and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The fold is crc32 of the id as text modulo ``folds``; a null id counts as ``''``.
    A null or empty text is a single end.  Repeated rows are learned from and scored
    as often as they occur; without training rows every class is equally likely.
    Other columns are not read.
    """
    fold = F.crc32(F.coalesce(df[id_col].cast("string"), F.lit(""))) % folds
    docs = df.select(df[id_col].cast("long").alias("doc_id"), (fold == held_fold).alias("held_out"), df[text_col].cast("string").alias("text"))
    model = fit(docs.where(~F.col("held_out")).select("text"), **fitting)
    return score(docs, model, "text", ["doc_id", "held_out"])
