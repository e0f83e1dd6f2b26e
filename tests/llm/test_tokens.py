"""Encoding, Re-Pair shards and packing."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from semsearch.llm import pack, repair
from semsearch.llm.common import scratch_path
from semsearch.llm.encode import UnitEncoder, _stems_and_tails, in_slices

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", None, "a  b", "\n\nx y\n", " lead", "trail ", "tab\there", "nb sp x", "it's we'll 'tis", "x\x00y z", "é é ́x", "a \n b", "<|endoftext|> hi", "a\x1cb c",
    "ΣΑΣ Σ İ x y ", "日本 語　x", "x…. y…,", "it's, don't... 's.", "a². ½, É, ", "n'. o’, p’s.", "Ǆ. ß, İ.", "a_ b_c. 1,2 3.5% (x) [y]", "word " * 3000,
]


def plain(file):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def split(ids, ends):
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("file", FILES)
def test_encoder_equals_the_library(file):
    codec = UnitEncoder(public_tokenizers.path(file))
    assert split(*codec.encode(pa.array(ODD))) == [plain(file)(t) for t in ODD]
    assert split(*codec.encode(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé 'st.,\n\t ́#1²…ß"), max_size=30), max_size=4))
def test_encoder_on_any_text(file, texts):
    codec = test_encoder_on_any_text.codecs.setdefault(file, UnitEncoder(public_tokenizers.path(file)))
    assert split(*codec.encode(pa.array(texts, pa.string()))) == [plain_of(file)(t) for t in texts]


test_encoder_on_any_text.codecs = {}
_plain = {}


def plain_of(file):
    return _plain.setdefault(file, plain(file))


def test_slices_cover_all():
    texts = pa.array(["x" * 10, None, "y" * 50, "", "z"])
    assert list(in_slices(texts, 20)) == [(0, 2), (2, 3), (3, 5)]
    assert list(in_slices(pa.array([], pa.string()))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6))
def test_grammar_round_trip(ids, rounds):
    ids = np.array(ids, np.int64)
    sequence, rules = repair.compress(ids, 4, rounds, 5, 2)
    lengths = repair.rule_lengths(rules, 4)
    grammar = repair.Grammar(4, rules, lengths)
    assert grammar.decode(sequence).tolist() == ids.tolist()
    assert len(sequence) + len(rules) <= max(1, len(ids))
    for a in range(0, len(ids), 7):
        assert grammar.decode_range(sequence, a, min(len(ids), a + 5)).tolist() == ids[a : a + 5].tolist()


def test_grammar_finds_repetition():
    ids = np.tile(np.arange(8), 500)
    sequence, rules = repair.compress(ids, 8, 6, 100, 2)
    assert len(sequence) <= 500 and repair.Grammar(8, rules, repair.rule_lengths(rules, 8)).decode(sequence).tolist() == ids.tolist()
    wide = repair.shard_row(0, 0, 0, [1], np.arange(1 << 18), np.array([1 << 18]), 1 << 18)  # more than 16 bits
    assert repair.shard_symbols(wide)[1].tolist() == list(range(1 << 18))


def test_rounds_go_on_until_no_pair_is_frequent(monkeypatch):
    ids = np.tile(np.random.default_rng(1).permutation(3000), 40)
    for bits in (18, 2):  # also where many pairs share a slot
        monkeypatch.setattr(repair, "SLOT_BITS", bits)
        sequence, rules = repair.compress(ids, 3000)
        assert np.unique(np.stack([sequence[:-1], sequence[1:]], 1), axis=0, return_counts=True)[1].max(initial=0) < repair.LEAST
        assert repair.Grammar(3000, rules, repair.rule_lengths(rules, 3000)).decode(sequence).tolist() == ids.tolist()
        assert len(sequence) <= 40  # a copy is no more than a symbol


def docs(spark, texts, **more):
    # a clashing extra column must do no harm
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, start string")


@pytest.mark.parametrize("spread", [3, 40, 4000])
def test_sorted_pairs_are_found_as_in_slots(monkeypatch, spread):
    """Short sequences are sorted at once; all keys that occur often stand where the slots find them."""
    rng = np.random.default_rng(spread)
    ids = rng.integers(0, spread, 5000).astype(np.int64)
    keys = ids[:-1] << 32 | ids[1:]
    monkeypatch.setattr(repair, "SLOT_BITS", 6)
    found = []
    for most in (1 << 17, 0):
        monkeypatch.setattr(repair, "SORTED", most)
        found.append(repair._places(keys, 1 << 14, 2))
    for a, b in zip(*found, strict=True):
        assert a.tolist() == b.tolist()
    chosen, at, rank = found[0]
    assert chosen[rank].tolist() == keys[at].tolist() and len(at) == np.isin(keys, chosen).sum()


def test_tails_are_the_bytes_after_the_stems():
    units = pa.array(["x", " é!?", "äß.", "", "日本。,", "a,b;", "...", " \U0001f600!", "Ж)"]).slice(1)
    stems, tails = _stems_and_tails(units)
    assert [s + t for s, t in zip(stems.to_pylist(), tails.to_pylist(), strict=True)] == units.to_pylist()
    assert tails.to_pylist()[:2] == ["!?", "."] and [len(x) for x in _stems_and_tails(units[:0])] == [0, 0]


def test_shards_round_trip(spark):
    texts = [(k * 3 % 29, t) for k, t in enumerate(ODD)] + [(5, "again"), (5, "again"), (None, "no place")]
    path = scratch_path(spark, "shards")
    repair.write_shards(docs(spark, texts), path, public_tokenizers.path(FILES[0]), shard_tokens=50)
    got = repair.read_shards(spark, path).orderBy("start").collect()
    expected = sorted(((i, t) for i, t in texts if i is not None), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in expected]
    start = 0
    for r, (_, t) in zip(got, expected, strict=True):
        ids = [*plain_of(FILES[0])(t), 2]
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert spark.read.parquet(path).count() > 1  # several shards were read


def test_documents_without_an_id_are_in_the_files(spark):
    from semsearch.llm.queries import op2_repair_tokens

    texts = [(None, f"text {k} without an id") for k in range(40)] + [(None, None), (4, "four"), (-1, "minus one")]
    folder = scratch_path(spark, "tables")
    docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    got = op2_repair_tokens(spark, folder).orderBy("start").collect()
    expected = [(-1, "minus one"), (4, "four"), (None, None), *sorted(texts[:40], key=lambda x: x[1])]
    start = 0
    for r, (i, t) in zip(got, expected, strict=True):
        ids = [*plain_of(FILES[0])(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_no_shards_of_an_empty_table(spark):
    path = scratch_path(spark, "shards")
    repair.write_shards(docs(spark, []), path, public_tokenizers.path(FILES[0]))
    assert repair.read_shards(spark, path).count() == 0


def test_packing(spark):
    texts = [(k, t) for k, t in enumerate(ODD)] + [(3, "a  b"), (3, "a  b"), (None, "no id")]
    got = pack.pack_documents(docs(spark, texts), public_tokenizers.path(FILES[1]), max_tokens=64).collect()
    whole = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 64 and r.start == r.piece * 64
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in whole.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    by_doc = {}
    for r in sorted((r for r in got if r.doc_id not in (3, None)), key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    for k, t in enumerate(ODD):
        if k != 3:
            assert by_doc[k] == [*plain_of(FILES[1])(t), 0]
    assert sum(r.doc_id == 3 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1
    assert pack.pack_documents(docs(spark, []), public_tokenizers.path(FILES[1])).count() == 0


def test_packing_with_and_without_kept_pieces_is_alike(spark):
    texts = [None, "", *(f"Some words, {i} of them! " * (i % 40 + 1) + chr(97 + i % 26) * (i % 9) for i in range(300))]
    some = docs(spark, list(enumerate(texts))).repartition(5, "doc_id")
    kept, forgotten = (
        {tuple(r) for r in pack.pack_documents(some, public_tokenizers.path(FILES[1]), max_tokens=64, keep_pieces=k).drop("sequence_id", "offset").collect()}
        for k in (True, False)
    )
    assert kept == forgotten and {r[0] for r in kept} == set(range(len(texts)))


def test_forgetting_pieces_keeps_the_ids():
    whole, small = UnitEncoder(public_tokenizers.path(FILES[1])), UnitEncoder(public_tokenizers.path(FILES[1]))
    for k in range(4):
        texts = pa.array([None, "", f"one two, three{k}!", " ".join(f"w{i}x{i * k}" for i in range(50))])
        want, got = whole.encode(texts), small.encode(texts)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
        small.forget()
        assert len(small.places) <= len(whole.places) and sorted(small.places.values()) == list(range(len(small.places)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_sequences_hold_what_fits(lengths):
    room, used = pack.OpenSequences(20, 0), {}
    for n in sorted(lengths, reverse=True):
        sequence, offset = room.place(n)
        assert offset == used.get(sequence, 0)
        used[sequence] = offset + n
    assert all(v <= 20 for v in used.values())
    # a new sequence is opened only when nothing fits, so no two are half empty
    assert sum(v <= 10 for v in used.values()) <= 1


def test_sum_of_squares_choice():
    room = pack.OpenSequences(10, 0)
    for n in (6, 6, 5):  # two with room 4, one with room 5
        room.place(n)
    # 3 leaves room 1 where two pile up, or room 2 of the one with 5: 1+1+1 is less than 4+1
    assert room.place(3) == (1, 6)


def test_crc_of_ids_is_that_of_bytes(spark):
    from semsearch.llm.queries import op5_sum_of_squares_packing

    folder = scratch_path(spark, "tables")
    docs(spark, [(1, "some words"), (2, None)]).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.ids_crc32 for r in op5_sum_of_squares_packing(spark, folder).collect()}
    for i, t in ((1, "some words"), (2, None)):
        assert got[i] == zlib.crc32(np.array([*plain_of(FILES[1])(t), 0], "<u4").tobytes())


def test_single_words_go_to_the_model_alone():
    """The whole of a text's new words must not pass the splitting of the library once more."""
    codec, library, seen = UnitEncoder(public_tokenizers.path(FILES[0])), plain_of(FILES[0]), []
    words = [chr(k) for k in [*range(33, 127), *range(0xC0, 0x530)]]
    texts = [*words, *(f"{w}{w} {w}" for w in words), "it's over, isn't it? 12 34a <|endoftext|> 日本 x²"]
    whole = codec.tokenizer

    class Watched:
        model = whole.model

        def encode_batch_fast(self, pieces, **how):
            seen.extend(pieces)
            return whole.encode_batch_fast(pieces, **how)

    codec.tokenizer = Watched()
    assert split(*codec.encode(pa.array(texts))) == [library(t) for t in texts]
    assert {"it's", " 日本", "<|endoftext|>"} & set(seen) and not {" over", " é", " Ж", "A", " 12", "?"} & set(seen)


def test_a_shard_ends_with_the_document_that_fills_it(spark):
    path = scratch_path(spark, "shards")
    one_task = docs(spark, [(k, "word " * (k % 17)) for k in range(300)]).coalesce(1)
    repair.write_shards(one_task, path, public_tokenizers.path(FILES[0]), shard_tokens=50)
    rows = spark.read.parquet(path).orderBy("part", "shard").collect()
    for r, after in zip(rows, [*rows[1:], None], strict=True):
        ends = np.frombuffer(r.doc_ends, "<i8")
        assert (len(ends) == 1 or ends[-2] < 50) and (ends[-1] >= 50 or after is None or after.part != r.part)
    assert sum(r.n_docs for r in rows) == 300
