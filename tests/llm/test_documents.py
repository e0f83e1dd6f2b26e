"""Sharding, quality rules, mixing, near duplicates, language model and the pipeline against plain versions."""

import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from semsearch.llm import lm, mixing, neardup, quality, shard
from semsearch.llm.common import scratch_path, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared passages and odd ones: (doc_id, text, source)."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Ä.", "the", "The"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, footer = text(60), "All rights reserved by all"
    rows = [text(rng.randrange(5, 150)) for _ in range(n)]
    rows += [rows[3]] * 7 + [rows[4].upper()]
    base = text(120)
    for _ in range(40):
        w = base.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    rows += [f"{text(20)} {passage} {text(20)}" for _ in range(45)] + [f"{passage} {rng.choice(words)}" for _ in range(10)]
    rows += [f"{text(60)}\n{footer}\n{text(10)}" for _ in range(30)] + [f"{footer}\n{text(2)}" for _ in range(3)]
    rows += [None, "", " \n\t", "one two", "one two", "One\ttwo", "a b c d e", "x" * 5000, text(6000), "same " * 100]
    rng.shuffle(rows)
    return [(k, t, None if k % 50 == 49 else f"src{k % 3}") for k, t in enumerate(rows)]


def frame(spark, rows):
    # extra columns whose names clash with ones the operators use
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else "de", s, len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, n string")


# --- sharding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(1, 5))
def test_schedule_is_that_of_a_heap(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    count = Counter()
    for s in sorted(sizes, reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + s, k))
        count[s, k] += 1
    plan = shard.lpt(sorted(Counter(sizes).items(), reverse=True), shards)
    loads = [0] * shards
    for (s, n), upto in zip(sorted(Counter(sizes).items(), reverse=True), plan, strict=True):
        taken = np.diff([0, *upto])
        assert taken.sum() == n
        loads = [x + s * int(t) for x, t in zip(loads, taken, strict=True)]
    assert sorted(loads) == sorted(x for x, _ in heap)


def test_sharding(spark):
    rows = corpus() + [(7, "repeated row", "a"), (7, "repeated row", "a"), (None, "no id", "a")]
    got = shard.shard_documents(frame(spark, rows), 4).collect()
    assert len(got) == len(rows)
    slots, together, loads = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        together[r.text_crc32, r.size].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in together.values())
    heap = [(0, k) for k in range(4)]
    sizes = Counter()
    for _, t, _ in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    for s in sorted(sizes.values(), reverse=True):
        heapq.heapreplace(heap, (heap[0][0] + s, heap[0][1]))
    assert sorted(loads.values()) == sorted(x for x, _ in heap)
    assert shard.shard_documents(frame(spark, []), 4).count() == 0


# --- quality rules


def measures(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def verdicts(rows, max_share, least, max_removed):
    """A plain version: text of each row -> kept."""
    normal = lambda x: " ".join(x.lower().split())
    hosts, having = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        hosts[s or ""].add(t or "")
        for line in set(map(normal, (t or "").split("\n"))) - {""}:
            having[s or "", line].add(t)
    out = []
    for _, t, s in rows:
        n, _, _, _, repeated = measures(t)
        limit = max_share * len(hosts[s or ""])
        gone = sum(len(x.split()) for x in map(normal, (t or "").split("\n")) if x and len(having[s or "", x]) > least and len(having[s or "", x]) > limit)
        failed = n < 50 or 100 * repeated > 50 * n
        out.append((failed, not failed and gone <= max_removed * n))
    return out


def test_quality_rules(spark):
    rows = [(k, t, s) for k, t, s in corpus()]
    rows += [(k, "\n".join(["common line of quite a few words here and there"] * 6 + [f"own {k} text"]), "src0") for k in range(1000, 1012)]
    rows += [(1000, rows[-12][1], "src0")]
    got = quality.judge_documents(frame(spark, rows), max_share=0.05, min_documents=4, max_repeat_percent=100).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        r = by_id[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t)
    plain_kept = [(not f or measures(t)[0] >= 50) and k for (f, k), (_, t, _) in zip(verdicts(rows, 0.05, 4, 0.5), rows, strict=True)]
    frequent = {k for k in range(1000, 1012)}
    assert not any(by_id[k].kept for k in frequent)  # depleted
    for (k, t, _), kept in zip(rows, plain_kept, strict=True):
        if k not in frequent and 100 * measures(t)[4] <= 50 * measures(t)[0]:
            assert by_id[k].kept == kept, k
    clashing = frame(spark, rows).withColumns({x: F.lit(x) for x in ("_row", "_text", "_frequent")})
    kept = quality.kept_documents(clashing)
    assert kept.columns == clashing.columns and {(r["_row"], r["_text"], r["_frequent"]) for r in kept.collect()} == {("_row", "_text", "_frequent")}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for (k, _, _), (_, ok) in zip(rows, verdicts(rows, 0.1, 10, 0.5), strict=True) if ok)
    assert quality.judge_documents(frame(spark, [])).count() == 0


def test_frequent_lines_are_taken_out(spark):
    df = frame(spark, [(k, f"Shared  LINE\nown {k}", "h") for k in range(9)] + [(9, None, "h"), (10, "shared line\nx", "other")])
    docs = stored(quality.measure(df), "m")
    bad = quality.frequent_lines(docs, 0.5, 3)
    texts = {r.doc_id: r.text for r in quality.without_frequent_lines(df, bad).collect()}
    assert texts[3] == "own 3" and texts[9] is None and texts[10] == "shared line\nx"


def test_bar_does_not_rise_with_the_host(spark):
    """A line in less than a tenth of a host is frequent beyond the bound; copies of one text are not."""
    rows = [(k, f"own {k}" + ("\nspread line" if k < 101 else "") + ("\nrarer line" if k < 100 else ""), "hot") for k in range(1300)]
    rows += [(k, "copied line\nits own text", "hot") for k in range(2000, 2200)]
    got = quality.judge_documents(frame(spark, rows), min_words=1, max_removed=1).collect()
    assert {r.doc_id for r in got if r.removed_words} == set(range(101)) and {r.removed_words for r in got} == {0, 2}


# --- mixing


def test_budgets_reach_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "z", 50)], "d string, l string, supply long")
    got = {(r.d, r.l): r.budget for r in mixing.leaf_budgets(leaves, ["d", "l"], {}, 400, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 150, ("b", "z"): 50}
    got = {(r.d, r.l): r.budget for r in mixing.leaf_budgets(leaves, ["d", "l"], {"d": {"a": 3}, "l": {"z": 0}}, 10_000, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000, ("b", "z"): 0}


def fill(nodes, budget):
    """Plain water filling: {name: (capacity, weight)} -> {name: share}."""
    shares, open_ = {}, {n: cw for n, cw in nodes.items() if cw[1]}
    while open_:
        weight = sum(w for _, w in open_.values())
        full = {n: c for n, (c, w) in open_.items() if c * weight <= w * budget}
        if not full:
            break
        for n, c in full.items():
            shares[n] = c
            budget -= c
            del open_[n]
    weight = sum(w for _, w in open_.values())
    return {n: shares.get(n, open_[n][1] * budget // weight if n in open_ else 0) for n in nodes}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("wxyz"), st.integers(0, 500)), min_size=1, max_size=8, unique_by=lambda x: x[:2]), st.integers(0, 2000))
def test_budgets_equal_plain_filling(spark, leaves, budget):
    weights = {"d": {"a": 3}, "l": {"w": 5, "x": 0}}
    df = spark.createDataFrame(leaves, "d string, l string, supply long")
    got = {(r.d, r.l): r.budget for r in mixing.leaf_budgets(df, ["d", "l"], weights, budget, 2).collect()}
    caps = {(d, x): 2 * s * (weights["l"].get(x, 1) > 0) for d, x, s in leaves}
    tops = {d: (sum(c for (e, _), c in caps.items() if e == d), weights["d"].get(d, 1)) for d in {x[0] for x in leaves}}
    top = fill(tops, min(budget, sum(c for c, _ in tops.values())))
    for d in tops:
        below = fill({x: (c, weights["l"].get(x, 1)) for (e, x), c in caps.items() if e == d}, top[d])
        assert {x: got[d, x] for x in below} == below


def test_mixture(spark):
    rows = corpus() + [(5, corpus()[5][1], corpus()[5][2])] * 2
    df = frame(spark, rows)
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(df, levels, {"lang": {"de": 5}}, 60, max_epochs=3).collect()
    total = sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    used = Counter()
    for r in got:
        used[r.lang, r.source] += r.n_tokens
    supply = Counter()
    for i, t, s in rows:
        supply["en" if i % 3 else "de", s or ""] += len(WORD.findall(t or ""))
    tree = {lang: fill({s: (3 * n, 1) for (x, s), n in supply.items() if x == lang}, b) for lang, b in
            fill({x: (3 * sum(n for (y, _), n in supply.items() if y == x), {"de": 5}.get(x, 1)) for x in ("en", "de")}, total * 60 // 100).items()}
    sizes = {k: len(WORD.findall(t or "")) for k, t, _ in rows}
    for (lang, s), n in supply.items():
        budget, longest = tree[lang][s], max(sizes[i] * (3 if i == 5 else 1) for i, _, q in rows if ("en" if i % 3 else "de", q or "") == (lang, s))
        assert budget - longest < used[lang, s] <= budget
        epochs = Counter(r.epoch for r in got if (r.lang, r.source) == (lang, s))
        for e in range(budget // n if n else 0):
            assert epochs[e] == len({i for i, _, q in rows if ("en" if i % 3 else "de", q or "") == (lang, s)})
    assert [r.copies for r in got if r.doc_id == 5] == [3] * sum(r.doc_id == 5 for r in got)
    assert sorted(mixing.mix(df, levels, {"lang": {"de": 5}}, 60, max_epochs=3).collect()) == sorted(got)
    kept = mixing.mixed_documents(df, levels, {}, 50)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
    assert mixing.mix(frame(spark, []), levels, {}, 50).count() == 0


# --- near duplicates


def shingles(text):
    w = WORD.findall((text or "").translate(A_Z))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """Plain version: doc_id -> smallest doc_id reachable."""
    sets = [(i, shingles(t)) for i, t, _ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                i, j = sorted((find(i), find(j)))
                root[j] = i
    return {i: find(i) for i, _ in sets}, dict(sets)


def small_parts(monkeypatch, **values):
    """Limits so small that every way of the search is taken."""
    for name, value in ({"CHUNK_BYTES": 4000, "RANGE_BYTES": 20_000, "TOGETHER": 5} | values).items():
        monkeypatch.setattr(neardup, name, value)


@pytest.mark.parametrize("rare,rounds,hot", [(32, 3, 64), (3, 2, 2), (1, 3, 1), (2, 1, 3)])
def test_near_duplicates(spark, monkeypatch, rare, rounds, hot):
    small_parts(monkeypatch, RARE=rare, ROUNDS=rounds, HOT=hot)
    rows = corpus()
    expected, sets = groups(rows)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id])


@pytest.mark.parametrize("rare,rounds", [(2, 1), (2, 3), (8, 2)])
def test_families_of_near_copies(spark, monkeypatch, rare, rounds):
    """Copies at every distance of two texts that share a passage, and of copies: many lists hold several components."""
    small_parts(monkeypatch, RARE=rare, ROUNDS=rounds, HOT=20)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)]
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for family in range(3):
        base = passage + [f"f{family}x{k}" for k in range(40)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(words)
            w = w[: len(w) - rng.choice([0, 0, 0, 4, 9])]
            rows.append(" ".join(w))
    rows += [" ".join(passage + [rng.choice(words)] * k) for k in range(12)] + rows[:5]
    rng.shuffle(rows)
    rows = [(k, t, "s") for k, t in enumerate(rows)]
    expected, _ = groups(rows)
    assert 5 < len(set(expected.values())) < len(rows) - 20
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()} == expected


def test_one_of_each(spark):
    rows = corpus() + [(500, "one two", "src0"), (501, "a repeated row of words", "src0"), (501, "a repeated row of words", "src0"), (502, "", "s"), (502, "", "s")]
    expected, sets = groups([r for k, r in enumerate(rows) if r not in rows[:k]])
    df = frame(spark, rows).withColumns({x: F.lit(x) for x in ("_key", "_row", "key", "node", "label")})
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns and {(r["_key"], r["_row"], r["label"]) for r in kept.collect()} == {("_key", "_row", "label")}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: 2 if i == 502 else 1 for i, s in sets.items() if not s or expected[i] == i})


def test_combinations_of_production_parameters(spark, monkeypatch):
    """A passage in many documents: lists of more than ``RARE`` nodes are combined, and lose no link."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, rows = [word() for _ in range(200)], []
    for _ in range(35):  # pairs that differ in a word, and from other pairs in all but the passage
        tail = [word() for _ in range(45)]
        rows += [passage + tail, passage + tail[:20] + [word()] + tail[21:]]
    rows += [passage + rows[k][200:220] + rows[k + 2][220:] for k in range(0, 20, 2)]  # between two of them
    rows = [(k, " ".join(w), "s") for k, w in enumerate(rows)]
    combined, stored_ = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name, *rest: combined.append(stored_(df, name, *rest)) or combined[-1] if name == "around-pivots" else stored_(df, name, *rest))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == groups(rows)[0]
    assert combined and all(x.count() > neardup.RARE for x in combined[:1])


def test_a_family_is_combined_around_few_pivots(spark, monkeypatch):
    """Parts of a text and edited copies of it choose many pivots; nodes are combined around few of them, and lose no link."""
    small_parts(monkeypatch, RARE=8)
    rng = random.Random(3)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(3, 9)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(6)}"
        a = rng.randrange(60) if k % 3 == 0 else 0
        rows.append((k, " ".join(w[a : a + 90] if k % 3 == 0 else w), "s"))
    kept, stored_ = [], neardup.stored

    def store(df, name, *rest):
        kept.append((name, stored_(df, name, *rest)))
        return kept[-1][1]

    monkeypatch.setattr(neardup, "stored", store)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == groups(rows)[0]
    before, after = (next(x for n, x in kept if n == name) for name in ("frequent", "around-pivots"))
    nodes = before.select("node").distinct().count()
    assert before.count() > 2 * nodes and after.count() <= 1.2 * nodes


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    alone = neardup.near_duplicates(frame(spark, [(1, None, "s"), (2, "", "s"), (None, "a b", "s"), (3, "a b", "s")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in alone) == [(0, 1, 3), (1, 0, 1), (2, 0, 2), (3, 1, 3)]


@pytest.mark.parametrize("rare", [32, 1])
def test_near_copies_without_an_id(spark, monkeypatch, rare):
    small_parts(monkeypatch, RARE=rare)
    text = lambda tag, *swapped: " ".join(f"{tag}{k}" + ("x" if k in swapped else "") for k in range(100))
    rows = [(None, text("a"), "s"), (7, text("a"), "s"), (9, text("a", 50), "s")]  # the node's first row has no id
    rows += [(None, text("b", k), "s") for k in (1, 50, 90)] + [(None, text("c"), "s"), (11, text("c", 99), "s"), (12, text("d"), "s")]
    df = frame(spark, rows).coalesce(1)
    got = Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == Counter({(None, 7): 1, (7, 7): 1, (9, 7): 1, (None, None): 3, (None, 11): 1, (11, 11): 1, (12, 12): 1})
    kept = [(r.doc_id, r.text[0]) for r in neardup.one_of_each(df).collect()]
    assert Counter(kept) == Counter([(7, "a"), (None, "b"), (11, "c"), (12, "d")])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, (1 << 48) - 1), st.integers(0, 65535), st.integers(0, 255))), st.integers(0, 47))
def test_packed_tokens_are_read_again(rows, bits):
    rows = sorted((t >> bits, d, c) for t, d, c in rows)
    tokens, docs, classes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    assert [x.tolist() for x in neardup.unpacked(neardup.packed(tokens, docs, classes))] == [tokens.tolist(), docs.tolist(), classes.tolist()]
    assert [x.tolist() for x in neardup.unpacked(neardup.packed(tokens, docs))] == [tokens.tolist(), docs.tolist(), [neardup.LAST_CLASS] * len(rows)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(0, 60), st.integers(0, 60))
def test_parity_bits_never_differ_more_than_the_sets(common, a, b):
    rng = np.random.default_rng(common * 1000 + a * 61 + b)
    x = np.unique(rng.integers(0, 1 << 56, common + a + b))
    left, right = neardup.parity_words(x[: common + a]), neardup.parity_words(np.concatenate([x[:common], x[common + a :]]))
    assert int(np.bitwise_count((left ^ right).view(np.uint64)).sum()) <= a + b


def test_components_of_chains(spark):
    rng = random.Random(3)
    chain = list(range(60))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in chain} | {100: 100, 101: 100, 102: 100, 200: 200}


# --- language model


def test_model_is_a_distribution_and_base_is_exact(spark):
    rows = [(i, t, s) for i, t, s in corpus() if len(t or "") < 3000]
    fitting = {"frequent": 300, "least": 45, "classes": 4}
    got = {r.doc_id: r for r in lm.score_documents(frame(spark, rows), **fitting).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    words = {i: [*WORD.findall((t or "").translate(A_Z)), 0] for i, t, _ in rows}
    counts = Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, w in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))

    # the score of every text by a plain version, from the model's classes alone
    model = lm.fit(frame(spark, [r for r in rows if not held[r[0]]]).select("text"), **fitting)
    assert 10 < model.clustered < v and model.clustered == sum(c >= 45 for w, c in counts.items() if w != 0)
    rank = {w: k for k, w in enumerate(model.frequent.to_pylist())}
    shape = lambda w: int(lm.shape_of(pa.array([w]))[0])
    class_of = lambda w: int(model.classes[model.clustered + lm.SHAPES if w == 0 else rank[w] if rank.get(w, v) < model.clustered else model.clustered + shape(w)])
    end, pairs = class_of(0), Counter()
    for i, w in words.items():
        if not held[i]:
            pairs.update(zip([end, *map(class_of, w)], map(class_of, w), strict=False))
    size, total = 4 + lm.SHAPES + 1, sum(pairs.values())
    into, out_of = Counter(), Counter()
    for (a, b), k in pairs.items():
        out_of[a] += k
        into[b] += k
    move = lambda a, b: math.log10((pairs[a, b] + lm.TRANSITION_PRIOR * (into[b] + 1) / (total + size)) / (out_of[a] + lm.TRANSITION_PRIOR))
    in_class = Counter()
    for w, c in counts.items():
        in_class[class_of(w)] += c
    once, twice, types = Counter(), Counter(), Counter()
    for w, c in counts.items():
        if w != 0 and class_of(w) >= 4:
            once[shape(w)] += c == 1
            twice[shape(w)] += c == 2
            types[shape(w)] += 1

    def emit(w):
        if w == 0 or class_of(w) < 4:
            return math.log10(counts[w] / in_class[class_of(w)]) if w else 0.0
        k = shape(w)
        d = min(0.95, max(0.05, once[k] / (once[k] + 2 * twice[k]))) if once[k] + twice[k] else 0.5
        if counts[w]:
            return math.log10(counts[w] - d) - math.log10(in_class[class_of(w)])
        held_back = math.log10(d * types[k] / in_class[class_of(w)]) if types[k] else 0.0
        b = [256, *w.encode(), 256]
        return held_back + sum(model.spelling[x, y] for x, y in zip(b, b[1:], strict=False))

    for i, w in words.items():
        line = [end, *map(class_of, w)]
        assert got[i].score == pytest.approx(sum(move(a, b) for a, b in zip(line, line[1:], strict=False)) + sum(map(emit, w)), rel=1e-5), i
    # what may follow a word: known words, the end, and what is held back for unseen words, which their spelling divides up
    first = class_of("the")
    known = sum(10 ** (move(first, class_of(w)) + emit(w)) for w in counts)
    unseen = sum(10 ** (move(first, 4 + k) + model.shapes[k][2]) for k in range(lm.SHAPES))
    assert known + unseen == pytest.approx(1, abs=1e-6)
    assert np.allclose((10.0**model.spelling).sum(1), 1) and model.spelling[256, 256] < -200


def test_contexts_are_the_neighbours(spark):
    size = 7
    pairs = {(0, 1): 3, (1, 0): 5_000_000_000, (2, 2): 4, (6, 0): 1}
    df = spark.createDataFrame([(a * size + b, n) for (a, b), n in pairs.items()], "pair long, n long")
    got = {r.item: (dict(zip(r.after, r.n_after)), dict(zip(r.before, r.n_before))) for r in lm.contexts(df, size).collect()}
    assert got == {i: ({b: n for (a, b), n in pairs.items() if a == i}, {a: n for (a, b), n in pairs.items() if b == i}) for i in (0, 1, 2, 6)}


def test_random_letters_score_below_known_texts(spark):
    rng = random.Random(8)
    syllables = ["ka", "to", "mi", "re", "su", "no"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(150)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)) for _ in range(20)]
    unseen = [" ".join("".join(rng.choice(syllables) for _ in range(7)) for _ in range(60)) for _ in range(20)]
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), least=20)
    rows = [(k, t) for k, t in enumerate(texts[:20] + unseen + noise)]
    score = {r.k: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "k long, text string"), model, carry=["k"]).collect()}
    assert min(score[k] for k in range(20)) > max(score[k] for k in range(20, 40)) > min(score[k] for k in range(20, 40)) > max(score[k] for k in range(40, 60))


def test_spelling_of_odd_words():
    table = np.random.default_rng(3).normal(size=(257, 257))
    words = pa.array(["", "x", "é", "a longer", "ab"])[1:]
    plain = []
    for w in words.to_pylist():
        b = [256, *w.encode(), 256]
        plain.append(sum(table[x, y] for x, y in zip(b, b[1:], strict=False)))
    assert lm.spelled(words, table) == pytest.approx(plain) and len(lm.spelled(words[:0], table)) == 0


def likelihood(pairs, classes):
    c = Counter()
    for (a, b), n in pairs.items():
        c[classes[a], classes[b]] += n
    left, right = Counter(), Counter()
    for (a, b), n in c.items():
        left[a] += n
        right[b] += n
    f = lambda xs: sum(x * math.log(x) for x in xs.values() if x)
    return f(c) - f(left) - f(right)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 5)), st.integers(1, 9), min_size=3, max_size=20), st.lists(st.integers(0, 2), min_size=6, max_size=6), st.integers(0, 5))
def test_best_class_has_the_highest_likelihood(pairs, classes, word):
    counts, after, before = np.zeros((3, 3)), np.zeros(3), np.zeros(3)
    for (a, b), n in pairs.items():
        counts[classes[a], classes[b]] += n
        after[classes[b]] += n * (a == word)
        before[classes[a]] += n * (b == word)
    best = lm.best_class(classes[word], after, before, pairs.get((word, word), 0), counts, 3)
    assert best == lm.best_class(classes[word], after, before, pairs.get((word, word), 0), counts, 3, lm._xlogx(counts))
    at = [likelihood(pairs, [*classes[:word], k, *classes[word + 1 :]]) for k in range(3)]
    assert at[best] == pytest.approx(max(at))


def test_classes_beat_single_words(spark):
    """Words of two kinds in turn: held-out text is far likelier than by their shares alone."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"{'ab'[j % 2]}{rng.randrange(30)}" for j in range(40)), "s") for k in range(200)]
    got = lm.score_documents(frame(spark, rows), least=5, classes=4).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.25  # log10(2) = 0.30 at best
    none = lm.score_documents(frame(spark, [])).count()
    only_held = lm.score_documents(frame(spark, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2])).collect()
    assert none == 0 and all(r.n_known == 0 and r.train_tokens == 0 for r in only_held)


# --- pipeline


def test_pipeline_against_plain_stages(spark):
    rows = [r for r in corpus(4) if r[0] % 50 != 49]
    folder = scratch_path(spark, "tables")
    frame(spark, rows).drop("n").write.parquet(f"{folder}/documents.parquet")
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard_join", "mix_sources", "pack_sequences"]
    columns = docs.columns
    first = stored(stages["quality_rules"](spark, docs, folder), "s1")
    expected = {k for (k, _, _), (_, ok) in zip(rows, verdicts(rows, 0.1, 10, 0.5), strict=True) if ok}
    assert {r.doc_id for r in first.collect()} == expected and first.columns == columns
    second = stored(stages["ngram_jaccard_join"](spark, first, folder), "s2")
    of, _ = groups([r for r in rows if r[0] in expected])
    expected = {i for i, least in of.items() if i == least}
    assert {r.doc_id for r in second.collect()} == expected and second.columns == columns
    third = stored(stages["mix_sources"](spark, second, folder), "s3")
    assert {r.doc_id for r in third.collect()} <= expected and third.columns == columns
    tokens = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert 0.5 * tokens(second) < tokens(third) <= 0.9 * tokens(second)
    last = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in third.collect()}


def stripped(rows, share=0.1, least=10, most=math.inf):
    """A plain version: each row's text without the lines that are frequent in its host."""
    normal = lambda x: " ".join(x.lower().split())
    hosts, having = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        hosts[s or ""].add(t or "")
        for line in set(map(normal, (t or "").split("\n"))) - {""}:
            having[s or "", line].add(t)
    bad = {k for k, v in having.items() if len(v) > least and len(v) > min(most, share * len(hosts[k[0]]))}
    return {k: t and "\n".join(x for x in t.split("\n") if (s or "", normal(x)) not in bad) for k, t, s in rows}


@pytest.mark.parametrize("few", [True, False])
def test_pipeline_takes_frequent_lines_out(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(quality, "BROADCAST_ROWS", 3)
    rows = [(k, t, None if s == "src1" else s) for k, t, s in corpus(6)]
    own = lambda k: " ".join(f"o{k}x{j}" for j in range(60))
    rows += [(k, f"{own(k)}\n\nShared  LINE of host\n{own(-k)}\nshared line of host", ["hot", None][k % 2]) for k in range(2000, 2040)]
    rows += [(k, f"shared line of host\n{own(k)}", "other") for k in range(2050, 2055)] + [(2000, rows[-40][1], "hot")]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text"))
    got = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "")
    assert got.schema == docs.schema
    plain = stripped(rows)
    kept = [k for (k, _, _), (_, ok) in zip(rows, verdicts(rows, 0.1, 10, 0.5), strict=True) if ok]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == sorted((k, plain[k], len(plain[k])) for k in kept)
    assert plain[2001] == f"{own(2001)}\n\n{own(-2001)}" and "shared" in plain[2050]
