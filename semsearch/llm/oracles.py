"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from .queries import MIXING_WEIGHTS

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VECTORS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c
  WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
grams AS (
  SELECT doc_id, i, concat_ws(chr(31), w[i], w[i+1], w[i+2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
real AS (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS normal FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM real GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT text) AS n_host FROM d GROUP BY 1),
frequent AS (SELECT host, normal FROM real JOIN hosts USING (host) GROUP BY host, normal, n_host HAVING count(DISTINCT text) > 10 AND (count(DISTINCT text) > n_host * 0.1 OR count(DISTINCT text) > 100)),
removed AS (SELECT doc_id, sum(len(string_split(normal, ' '))) AS n FROM real SEMI JOIN frequent USING (host, normal) GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND removed_words <= 0.5 * n_words AS kept, removed_words FROM f"""

COMPONENTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], chr(31)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, chr(31)) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON a = doc_id"""


def _level(depth: int, path: list[str], budgets: str) -> str:
    """Budgets of one level of the tree: tables n, o, f and b of that depth."""
    name, parent = path[-1], path[:-1]
    weight = f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in MIXING_WEIGHTS[name].items()) + " ELSE 1 END" if MIXING_WEIGHTS.get(name) else "1"
    keys, by = ", ".join(path), f"PARTITION BY {', '.join(parent)}" if parent else ""
    given = f"JOIN b{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN total"
    return f"""
n{depth} AS (SELECT {keys}, CAST(sum(supply) * 2 AS BIGINT) AS cap, {weight} AS w FROM leaf GROUP BY {keys}),
o{depth} AS (
  SELECT {keys}, cap, w, least(budget, sum(cap) OVER ({by})) AS given,
    coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM n{depth} {given}),
f{depth} AS (SELECT *, cap * rest <= w * (given - before) AS isfull FROM o{depth}),
b{depth} AS (
  SELECT {keys}, CAST(CASE WHEN isfull THEN cap ELSE
    w * (given - coalesce(sum(cap) FILTER (isfull) OVER ({by}), 0)) // sum(w) FILTER (NOT isfull) OVER ({by}) END AS BIGINT) AS budget FROM f{depth})"""


MIXTURE = rf"""
WITH d AS (
  SELECT doc_id, concat('d', coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % 3) AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, len({_WORDS.format("coalesce(text, '')")}) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
total AS (SELECT CAST(sum(supply) AS BIGINT) * 60 // 100 AS budget FROM leaf),{_level(1, ["domain"], "")},{_level(2, ["domain", "lang"], "")},{_level(3, ["domain", "lang", "source"], "")},
p AS (SELECT d.*, budget // supply AS whole, budget % supply AS rest FROM d JOIN leaf USING (domain, lang, source) JOIN b3 USING (domain, lang, source) WHERE supply > 0),
last AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('-', '1', whole, doc_id)), doc_id ROWS UNBOUNDED PRECEDING) AS running FROM p)
SELECT doc_id, domain, lang, source, n_tokens, CAST(1 AS BIGINT) AS copies, CAST(epoch AS INTEGER) AS epoch FROM (SELECT *, unnest(range(whole)) AS epoch FROM p)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, 1, CAST(whole AS INTEGER) FROM last WHERE rest > 0 AND running <= rest"""


_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKING = rf"""
WITH d AS (SELECT doc_id, {_TERMS.format(_LOWER.format("coalesce(text, '')"))} AS t FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
m AS (SELECT doc_id, t, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, total WHERE len(t) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format(_LOWER.format("coalesce(text, '')"))}) AS term FROM benchmark),
postings AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(t) AS term FROM m) SEMI JOIN asked USING (term) GROUP BY 1, 2, 3),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY 1),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SHARED_LINES = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM l),
frequent AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS dropped FROM k LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_vector_approximation": VECTORS,
        "op7_line_frequency": LINES,
        "op8_hierarchical_budgets": MIXTURE,
        "op9_ngram_jaccard": COMPONENTS,
        "op12_stratified_ranking": RANKING,
        "op13_line_runs": SHARED_LINES,
    }
