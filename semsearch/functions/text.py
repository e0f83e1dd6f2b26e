"""Text expressions: blank test, markup, truncation, sections, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels of the sections of an assembled text
TITLE, DESCRIPTION, METADATA, URL = "TÍTULO:", "DESCRIÇÃO:", "METADADOS:", "URL:"

#: Comments and tags; the text inside scripts stays.
MARKUP = r"""(?s)<!--.*?-->|</?[A-Za-z!?](?:"[^"]*"|'[^']*'|[^'">])*>"""


def is_blank(c: Column) -> Column:
    """Null, empty, or the string 0."""
    return c.isNull() | c.isin("", "0")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, MARKUP, "")


# fixed values: accented Latin letters and the letters they count as
ACCENTED, PLAIN = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def without_accents(c: Column) -> Column:
    """Lower-cased, with accented letters as plain ones."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def truncate_text(c: Column, size: int) -> Column:
    """``c`` cut to ``size`` characters, back to the last full stop if that lies beyond 80 % of the cut."""
    cut = F.substring(c, 1, size)
    dot = F.length(cut) - F.instr(F.reverse(cut), ".")  # from 0
    at_dot = F.when((F.instr(cut, ".") > 0) & (dot > 0.8 * size), F.substring(cut, F.lit(1), dot + 1)).otherwise(cut)
    return F.when(F.length(c) <= size, c).otherwise(at_dot)


def trim_words(c: Column, n: int, suffix: str = "…") -> Column:
    """The first ``n`` words, and the suffix if there are more."""
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, F.lit(suffix)).otherwise(F.lit("")))


def word_tokens(c: Column, per_word: int = 4) -> Column:
    """Tokens estimated from words of letters, apostrophes and hyphens."""
    return F.regexp_count(c, F.lit("[A-Za-z'-]+")) * per_word


def char_tokens(c: Column, per_token: int = 4) -> Column:
    """Tokens estimated from characters."""
    return F.length(c) / per_token


def extract_title(c: Column) -> Column:
    """The line after the title label; with an empty title the next line, as white space is skipped."""
    return F.trim(F.regexp_extract(c, rf"(?s){TITLE}\s*(.*?)(\n|\z)", 1))


def extract_description(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, rf"(?s){DESCRIPTION}\s*(.*?)(\n\n|\z)", 1))


def extract_metadata(c: Column) -> Column:
    """Map of the metadata block, a ``name: value`` in each line; blank values go, the last of equal names stays."""
    block = F.regexp_extract(c, rf"(?s){METADATA}\n(.*?)(\n\n{URL}|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return last_of_each(F.filter(entries, lambda e: ~is_blank(e["value"])))


def last_of_each(entries: Column) -> Column:
    """A map of (key, value) structs in which the last of equal keys stays."""
    later = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, later))


def query_terms(c: Column) -> Column:
    """Lower-case terms at single blanks, blank ones left out."""
    return F.filter(F.split(F.lower(c), " "), lambda t: ~is_blank(t))


def best_sentence(text: Column, terms: Column) -> Column:
    """The first sentence that holds most terms, as substrings; the first 150 characters if none does."""
    sentences = F.split(text, r"[.!?]+")
    score = lambda s: F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t)))
    scored = F.transform(sentences, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("place"), F.trim(s).alias("text")))
    best = F.array_max(F.filter(scored, lambda s: (s["score"] > 0) & (s["text"] != "")))
    return F.coalesce(best["text"], F.substring(text, 1, 150))


def highlight(text: Column, terms: Column) -> Column:
    """Whole words that are terms, marked in one pass."""
    quoted = F.transform(F.array_distinct(terms), lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?iu)\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>"))).otherwise(text)


def plain_text(content: Column) -> Column:
    return F.trim(collapse_space(strip_tags(content)))


def snippet(content: Column, query: Column) -> Column:
    """The best sentence of the content for the query, its terms marked, and three dots."""
    text, terms = plain_text(content), query_terms(query)
    return F.concat(highlight(best_sentence(text, terms), terms), F.lit("..."))


def preview(c: Column, n: int = 100) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def client_address(client_ip: Column, forwarded_for: Column, remote_addr: Column) -> Column:
    """The first of these that is not empty."""
    return F.coalesce(F.nullif(client_ip, F.lit("")), F.nullif(forwarded_for, F.lit("")), remote_addr)


def id_list(c: Column) -> Column:
    """Numbers of a comma-separated list."""
    return F.transform(F.split(c, ","), lambda x: F.coalesce(F.trim(x).try_cast("long"), F.lit(0)))


def feedback_label(c: Column) -> Column:
    return F.when(c == 1, "positive").when(c == 0, "negative").otherwise("none")


def log_level(c: Column) -> Column:
    """error before debug, else none."""
    return F.when(F.contains(c, F.lit("[ERROR]")), "error").when(F.contains(c, F.lit("[DEBUG]")), "debug").otherwise("none")
