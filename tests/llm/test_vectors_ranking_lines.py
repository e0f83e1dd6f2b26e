"""Whitening, ranked search and shared lines against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semsearch.llm import lines, rank, whiten

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# --- whitening


def plain_whitening(rows, k=4):
    """vec_id -> values by numpy's eigenvectors of the covariance of distinct vectors; n, sums, e, trace."""
    x = np.unique(np.array([v for _, v in rows], np.int64), axis=0)
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    e, vectors = np.linalg.eigh(y.T @ y / n)
    return n, sums, e[::-1][:k], vectors[:, ::-1][:, :k], e.sum()


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, component int")


def whitening_rows(dims, n, seed=3, spread=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)) * (spread if spread is not None else np.arange(dims, 0, -1))
    return [(i, [float(c) for c in row]) for i, row in enumerate(base)]


def assert_whitened(got, rows, k=4):
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    n, sums, e, vectors, trace = plain_whitening(whole, k)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    signs = {}
    assert sum(map(len, by_id.values())) == len(rows) * len(e)
    for i, x in whole:
        for r in by_id[i]:
            c = r.component - 1
            assert r.n == n and r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(x, sums, strict=True))
            assert abs(r.explained - e[c] / trace) <= 1e-9 and r.identity_error < 1e-9
            want = float((np.array(x) - sums / n) @ vectors[:, c] / math.sqrt(e[c]))
            sign = signs.setdefault(c, 1.0 if abs(want) < 1e-3 or want * r.whitened > 0 else -1.0)
            if abs(want) < 1e-3:
                signs.pop(c)
            assert abs(abs(r.whitened) - abs(want)) < 1e-8 and (abs(want) < 1e-3 or sign * want * r.whitened > 0)


def test_whitening(spark):
    rows = whitening_rows(6, 80)
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0])]
    repeated = [(500, rows[3][1]), (501, rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]
    got = whiten.whiten(vectors_frame(spark, rows + repeated + odd)).collect()
    assert_whitened([r for r in got if r.vec_id is not None], rows + repeated[:2])
    assert sum(r.vec_id is None for r in got) == 8 and {r.vec_id for r in got}.isdisjoint({i for i, _ in odd})


def test_whitening_of_ill_conditioned_rows(spark):
    spread = 10.0 ** -np.linspace(-3, 1, 5)  # from 1000 to a tenth: singular values four digits apart
    rows = whitening_rows(5, 120, 5, spread)
    assert_whitened(whiten.whiten(vectors_frame(spark, rows), 4).collect(), rows)


def test_whitening_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(30)]  # one direction
    got = whiten.whiten(vectors_frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in got)
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component > 1)
    first = np.array(sorted((r.vec_id, r.whitened) for r in got if r.component == 1))[:, 1]
    assert abs(first.var() - 1) < 1e-9 and abs(first.mean()) < 1e-9
    one = whiten.whiten(vectors_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, 0.0, 0.0) for r in one)
    assert whiten.whiten(vectors_frame(spark, [])).count() == 0 and whiten.whiten(vectors_frame(spark, [(1, None)])).count() == 0


def test_triangular_solve_and_shift():
    rng = np.random.default_rng(0)
    r, q = np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5), rng.normal(size=(7, 5))
    assert np.allclose(whiten._solve(q @ r, r), q)
    singular = np.ones((3, 3))
    f = whiten._cholesky(singular, 1e-12)
    assert np.allclose(f.T @ f, singular, atol=1e-6) and np.allclose(whiten._root(singular).T @ whiten._root(singular), singular)


# --- ranked search


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ09_ \n\x00\x7f.é")))), max_size=8), st.integers(0, 3))
def test_terms_are_those_of_the_pattern(texts, start):
    column = pa.array(texts, pa.string())[start:]
    names, numbers, ends = rank.terms_of(column)
    names, got, a = names.to_pylist(), [], 0
    for b in ends.tolist():
        got.append([names[i] for i in numbers[a:b]])
        a = b
    assert got == [TERM.findall((t or "").translate(A_Z)) for t in texts[start:]]


def plain_ranking(docs, items, k):
    counted = [(i, Counter(TERM.findall((t or "").translate(A_Z)))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        terms = set(TERM.findall((text or "").translate(A_Z)))
        for i, c, n in counted:
            m = 50 + 50 * n * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranking_corpus(seed=2, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "x1", "日本"]
    text = lambda k: " ".join(rng.choices(words, [1 / (r + 1) for r in range(len(words))], k=k))
    docs = [(i, text(rng.choice([5, 5, 5, 9, 30, 31, 200]))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[7][1]), (2000, None), (2001, ""), (2002, "... --"), (2003, text(6000)), (2004, "x1 " * 3000)]
    items = [(i, text(rng.randrange(1, 40)).upper()) for i in range(25)] + [(100, None), (101, "!!"), (102, "never seen"), (103, "x1 never x1"), (5, "w1 w2"), (None, "w3")]
    return docs, items


@pytest.mark.parametrize("limits", [None, dict(BLOCK_DOCS=7, BLOCK_POSTINGS=60, QUESTIONS=6, FIRST_VISIT=1, NEXT_VISIT=2)])
def test_ranking(spark, monkeypatch, limits):
    for name, value in (limits or {}).items():
        monkeypatch.setattr(rank, name, value)
    docs, items = ranking_corpus()
    d = spark.createDataFrame([(i, t, "q", 3) for i, t in docs], "doc_id long, text string, m string, n int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = rank.rank_documents(d, q, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(docs, items, 10)


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank.rank_documents(docs.limit(0), items).count() == 0 and rank.rank_documents(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in rank.rank_documents(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
    assert rank.rank_documents(docs.where("doc_id = 2"), items).count() == 0


def test_strata_hold_equal_normalisers_and_bounds_hold(spark, monkeypatch):
    monkeypatch.setattr(rank, "BLOCK_DOCS", 16)
    docs, _ = ranking_corpus()
    index = rank.build(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = index.blocks.collect()
    assert sum(len(r.docs) for r in rows) == index.documents == sum(bool(TERM.search(t or "")) for _, t in docs)
    assert {r.m: r.docs for r in index.strata.collect()} == dict(Counter(r.m for r in rows for _ in r.docs))
    assert max(len(r.docs) for r in rows) <= 48 and len([r for r in rows if r.m == Counter(x.m for x in rows).most_common(1)[0][0]]) > 1
    for r in rows:
        assert r.terms == sorted(r.terms, key=lambda t: t.encode()) and sum(r.groups) == len(r.tfs) == len(r.holders) and sum(r.holders) == len(r.places)


# --- shared lines


def plain_lines(rows):
    """doc_id -> (n_lines, n_dropped, digest) of every row."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(A_Z)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-math.inf if i is None else i)
    out = []
    for i, t in rows:
        at = -math.inf if i is None else i
        every = (t or "").split("\n")
        stay = [x for x in every if not (len(held[key(x)]) >= 3 and at != max(held[key(x)]))]
        out.append((i, len(every), len(every) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(seed=4, n=150):
    rng = random.Random(seed)
    shared = [f"This line number {k} is found in many documents" for k in range(12)] + ["Ünïcödé line of twenty chars", "short line", "twenty points exactly"[:20], "nineteen points here"[:19]]
    rows = []
    for i in range(n):
        text = [rng.choice(shared) if rng.random() < 0.5 else f"own line of document {i} {rng.random()}" for _ in range(rng.randrange(1, 12))]
        text = [rng.choice(["{}", "  {}\t", "{}\r", "\v{} "]).format(x.upper() if rng.random() < 0.3 else x) for x in text]
        rows.append((i * 3, "\n".join(text)))
    rows += [(5000, None), (5001, ""), (5002, "\n\n"), (5003, "\n".join([shared[0]] * 5 + ["", shared[0]])), (6, rows[2][1]), (6, "other text\n" + shared[1]), (None, shared[0] + "\nx"), (None, shared[2])]
    rows += [(7000, " " * 50_000 + "x"), (7001, "\n".join([shared[3], "y"] * 4000)), (7002, shared[3])] + [(8000 + i, "a line that only two documents hold") for i in range(2)]
    rows += [(i, rows[10][1]) for i in range(9000, 9100)]
    return rows


@pytest.mark.parametrize("n", [1, 7])
def test_shared_lines(spark, n):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, lost string").repartition(4)
    got = lines.without_shared_lines(df, n_batches=n)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=repr) == plain_lines(rows)
    if n == 1:
        assert sorted(map(tuple, lines.line_digest(df).collect()), key=repr) == plain_lines(rows) and lines.line_digest(df.limit(0)).count() == 0


def test_shared_lines_beyond_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(lines, "is_small", lambda df: False)
    monkeypatch.setattr(lines, "small_or_not", lambda df: df)
    rows = line_rows(9)
    got = lines.line_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lines(rows)


def test_runs_are_compacted_and_know_their_keys(spark):
    rows = [r for r in line_rows(5) if r[0] != 7001]  # its many lines would fill most batches
    occurrences = lines.line_occurrences(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").cache()
    runs, seen = lines.LineRuns(spark), set()
    for batch in lines.batches(occurrences, 5):
        keys = {(r.h1, r.h2) for r in batch.collect()}
        written = runs.add(batch)
        new = {(r.h1, r.h2) for r in runs._read(written).where("last is not null").collect()} if written in runs.runs else keys - seen
        assert new == keys - seen
        seen |= keys
    assert runs.compactions == 3 and [r.level for r in runs.runs] == [2, 0]
    plan = runs._merged(runs.runs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # sorted runs meet as they lie
    got = {(r.h1, r.h2): (r.docs, r.last) for r in runs.frequent(1).collect()}
    want = occurrences.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last")).collect()
    assert got == {(r.h1, r.h2): (r.docs, r.last) for r in want}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
