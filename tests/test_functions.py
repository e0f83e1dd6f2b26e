import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from semsearch.functions import text as T
from semsearch.functions.periods import inclusive_days, period_key, period_label
from semsearch.functions.vectors import cosine_similarity, score
from semsearch.operators.embed import HashEmbedder, batch_size
from semsearch.operators.runs import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "a,b,expected",
    [([1, 0], [0, 1], 0), ([1, 2], [2, 4], 1), ([0, 0], [1, 1], 0), ([3, 4], [3], 0.6), ([1], [1, 9], 1), ([1, 0], [-1, 0], -1)],
)
def test_cosine(spark, a, b, expected):
    arrays = [F.array(*(F.lit(float(x)) for x in v)) for v in (a, b)]
    assert one(spark, cosine_similarity(*arrays)) == pytest.approx(expected, abs=1e-6)


def test_score(spark):
    assert one(spark, score(F.lit(0.36994))) == 37.0


@pytest.mark.parametrize("text,expected", [("abcdefgh", "abcdefgh"), ("abcdefg.hij", "abcdefg."), ("abcdef.ghij", "abcdef.g"), ("abc.efghij", "abc.efgh"), ("", ""), (None, None)])
def test_truncate(spark, text, expected):
    assert one(spark, T.truncate_text(F.lit(text).cast("string"), 8)) == expected


@pytest.mark.parametrize("text,expected", [("TÍTULO: A\n\nDESCRIÇÃO: b b", "A"), ("TÍTULO: \n\nDESCRIÇÃO: x", "DESCRIÇÃO: x"), ("none", "")])
def test_title(spark, text, expected):
    assert one(spark, T.extract_title(F.lit(text))) == expected


def test_sections(spark):
    assert one(spark, T.extract_description(F.lit("x DESCRIÇÃO: b b\n\nMETADADOS: y"))) == "b b"
    assert one(spark, T.extract_metadata(F.lit("METADADOS:\nk: v\nu: http://x\n\nURL: z"))) == {"k": "v", "u": "http://x"}
    assert one(spark, T.extract_metadata(F.lit("METADADOS: k: v, u: w"))) == {}
    assert one(spark, T.extract_metadata(F.lit("METADADOS:\na: 0\nb:\nc: 1\nc: 2"))) == {"c": "2"}


@pytest.mark.parametrize(
    "text,query,expected",
    [
        ("TÍTULO: Vase.\n\nDESCRIÇÃO: An art vase. Art deco lamp! Last art deco", "art deco", "<mark>Art</mark> <mark>deco</mark> lamp..."),
        ("nothing here", "zzz", "nothing here..."),
        ("A party.", "art", "A party..."),
        ("a mark and a mark", "mark mark", "a <mark>mark</mark> and a <mark>mark</mark>..."),
        ("plain", "", "plain..."),
        (r"a \Eb c", r"\Eb", r"a \Eb c..."),
    ],
)
def test_snippet(spark, text, query, expected):
    assert one(spark, T.snippet(F.lit(text), F.lit(query))) == expected


def test_strip_tags(spark):
    assert one(spark, T.strip_tags(F.lit('a<b title="x>y">b</b><!-- c\n> -->d 1 < 2'))) == "abd 1 < 2"


def test_small_text_functions(spark):
    assert one(spark, T.trim_words(F.lit("a  b c"), 2)) == "a b…"
    assert one(spark, T.trim_words(F.lit("a b"), 2)) == "a b"
    assert one(spark, T.word_tokens(F.lit("don't stop-now 12"))) == 8
    assert one(spark, T.char_tokens(F.lit("abcdef"))) == 1.5
    assert one(spark, T.id_list(F.lit("1, 2,x"))) == [1, 2, 0]
    assert one(spark, T.client_address(F.lit(""), F.lit("1.2.3.4"), F.lit("5"))) == "1.2.3.4"
    assert [one(spark, T.is_blank(F.lit(x).cast("string"))) for x in (None, "", "0", "00")] == [True, True, True, False]
    assert [one(spark, T.feedback_label(F.lit(x).cast("int"))) for x in (1, 0, None)] == ["positive", "negative", "none"]
    assert one(spark, T.log_level(F.lit("[a] [ERROR] [DEBUG]"))) == "error"


def test_periods(spark):
    ts = F.lit("2023-12-31 10:00:00").cast("timestamp")
    assert one(spark, period_key(ts, "week")) == dt.date(2023, 12, 31)
    assert one(spark, period_label(ts, "week")) == "2023 Week 52"
    assert one(spark, period_label(ts, "month")) == "2023-12"
    assert one(spark, inclusive_days(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))) == 30
    with pytest.raises(ValueError):
        period_key(ts, "year")


@pytest.mark.parametrize("n,size", [(100, 50), (101, 30), (500, 30), (501, 20), (1000, 20), (1001, 10)])
def test_batch_size(spark, n, size):
    assert one(spark, batch_size(F.lit(n))) == size


def test_progress(spark):
    assert [one(spark, progress(F.lit(a), F.lit(b))) for a, b in ((3, 8), (9, 8), (0, 0))] == [38.0, 100.0, 0.0]


def test_hash_embedder():
    counts = [0.0] * 8
    for term in "one two two ärger 3".split():
        counts[int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % 8] += 1
    assert list(HashEmbedder(8)(["One two, two Ärger 3"])[0]) == pytest.approx([c / sum(x * x for x in counts) ** 0.5 for c in counts])
    assert list(HashEmbedder(4)(["", None])[0]) == [0, 0, 0, 0]
