"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..config import DEFAULT
from . import upkeep
from .views import SQL, sql

# the text of an item in each layout
_TAGS = r"""<!--.*?-->|</?[A-Za-z!?](?:"[^"]*"|''[^'']*''|[^''">])*>"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '(?s){_TAGS}', '', 'g')"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR {c} IN ('', '0'))"


def _meta(sep: str) -> str:
    """Entries that are not blank, by name."""
    parts = ", ".join(f"CASE WHEN NOT {_blank(c)} THEN concat('{n}: ', {c}) END" for n, c in (("chars", "m_chars"), ("type", "m_type"), ("year", "m_year")))
    return f"concat_ws({sep}, {parts})"


BLOCK = f"""concat_ws(chr(10)||chr(10), concat('TÍTULO: ', title), CASE WHEN NOT {_blank('description')} THEN concat('DESCRIÇÃO: ', {_strip('description')}) END,
  CASE WHEN {_meta('chr(10)')} <> '' THEN concat('METADADOS:', chr(10), {_meta('chr(10)')}) END, concat('URL: ', url))"""
INLINE = f"""concat_ws(chr(10)||chr(10), CASE WHEN NOT {_blank('title')} THEN concat('TÍTULO: ', title) END, CASE WHEN NOT {_blank('description')} THEN concat('DESCRIÇÃO: ', {_strip('description')}) END,
  CASE WHEN {_meta("', '")} <> '' THEN concat('METADADOS: ', {_meta("', '")}) END)"""
CUSTOM = f"""concat_ws(chr(10)||chr(10), CASE WHEN NOT {_blank('title')} THEN concat('TÍTULO: ', title) END, CASE WHEN {_meta("', '")} <> '' THEN concat('METADADOS: ', {_meta("', '")}) END,
  CASE WHEN NOT {_blank('m_type')} THEN concat('M_TYPE: ', m_type) END, CASE WHEN NOT {_blank('m_year')} THEN concat('M_YEAR: ', m_year) END)"""

# hits of a search among all vectors for every twentieth
_SCORED = """scored AS (SELECT q.item_id AS query_id, v.*, round(list_cosine_similarity(q.vector, v.vector), 12) AS s FROM vectors v, vectors q WHERE q.item_id % 20 = 0),
  hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM scored)"""
_ONE = """one AS (SELECT v.*, round(list_cosine_similarity(q.vector, v.vector), 12) AS s FROM {rows} v, vectors q WHERE q.item_id = 0)
  SELECT item_id, row_number() OVER (ORDER BY s DESC, item_id) AS rank, round(s, 6) AS similarity, round(s * 100, 1) AS score FROM one {where} QUALIFY rank <= 10"""


def _search(query: str, *more: str) -> str:
    return f"WITH vectors AS ({SQL['vectors']}), {_SCORED}{''.join(f', {m} AS ({SQL[m]})' for m in more)} {query}"


# 16 buckets of a hashed embedding
def _hashed(source: str, key: str, text: str) -> str:
    return f"""terms AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {source}),
      counts AS (SELECT k, ('0x'||substr(md5(t),1,6))::INT % 16 AS b, count(*)::DOUBLE AS n FROM terms GROUP BY 1, 2),
      lengths AS (SELECT k, sqrt(sum(n*n)) AS length FROM counts GROUP BY 1)"""


_DOT = "CAST(round(coalesce(n / length, 0) * 10000) AS BIGINT)"
_META_KV = "concat_ws(';', CASE WHEN m_chars NOT IN ('', '0') THEN concat('chars=', m_chars) END, concat('type=', m_type), concat('year=', m_year))"
_TEXT = f"trim(regexp_replace({_strip('{c}')}, '\\s+', ' ', 'g'))"


def _snippet(text: str, terms: str) -> str:
    """The best sentence for a list of terms (letters alone), marked."""
    best = f"""(SELECT trim(x) FROM (SELECT unnest(regexp_split_to_array({text}, '[.!?]+')) AS x, generate_subscripts(regexp_split_to_array({text}, '[.!?]+'), 1) AS i)
      WHERE trim(x) <> '' AND len(list_filter({terms}, lambda t: contains(lower(x), t))) > 0 ORDER BY len(list_filter({terms}, lambda t: contains(lower(x), t))) DESC, i LIMIT 1)"""
    # RE2's word boundary knows ASCII alone, so words are wrapped first and the wrappers taken out again
    words = f"""regexp_replace(coalesce({best}, substr({text}, 1, 150)), '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"""
    terms = f"""array_to_string(list_transform(list_distinct({terms}), lambda t: regexp_escape(t)), '|')"""
    marked = f"""regexp_replace({words}, '(?i)' || chr(1) || '(' || {terms} || ')' || chr(2), '<mark>\\1</mark>', 'g')"""
    return f"concat(translate({marked}, chr(1) || chr(2), ''), '...')"


def _stats(period: str, limit: int = 30) -> str:
    day = "CAST(created_at AS DATE)"
    key = {"day": day, "week": f"CAST({day} - CAST(dayofweek({day}) AS INTEGER) AS DATE)", "month": f"CAST(date_trunc('month', {day}) AS DATE)"}[period]
    last = "CAST(last AS DATE)"
    first = f"((dayofweek(date_trunc('year', {last})) + 6) % 7)"
    week = f"CAST(floor((dayofyear({last}) - 1 + {first}) / 7) AS INTEGER) + CASE WHEN {first} <= 3 THEN 1 ELSE 0 END"
    label = {"day": f"strftime({last}, '%Y-%m-%d')", "week": f"concat(year({last}), ' Week ', lpad(CAST({week} AS VARCHAR), 2, '0'))", "month": f"strftime({last}, '%Y-%m')"}[period]
    return sql(f"SELECT period, {label} AS label, total FROM (SELECT {key} AS period, count(*) AS total, max(created_at) AS last FROM history GROUP BY 1 ORDER BY last DESC LIMIT {limit})", "history")


# the three best items of a search with their query
_FORMATTED = f"""f AS (SELECT query_id, rank, round(h.s * 100, 1) AS score, concat('the of item ', query_id) AS query, i.*, {BLOCK} AS content FROM hits h JOIN items i USING (item_id) WHERE rank <= 3),
  g AS (SELECT *, {_TEXT.format(c='content')} AS plain, list_filter(string_split(lower(query), ' '), lambda t: t NOT IN ('', '0')) AS terms,
    list_filter(regexp_split_to_array({_strip("trim(regexp_extract(content, '(?s)DESCRIÇÃO:[ \\t\\n\\r]*(.*?)(\\n\\n|\\z)', 1))")}, '\\s+'), lambda x: x <> '') AS words FROM f),
  asked AS (SELECT item_id AS query_id, concat('the of item ', item_id) AS query FROM vectors WHERE item_id % 20 = 0)"""


def _formatted(query: str) -> str:
    return _search("", "items").rstrip() + ", " + _FORMATTED + " " + query


_PREFIXED = "SELECT list_sort(collections_used) AS used, count(*) AS n FROM history WHERE len(collections_used) > 0 GROUP BY 1"
_TOP = "SELECT collection, CAST(sum(n) AS BIGINT) AS total FROM (SELECT unnest(used) AS collection, n FROM c) GROUP BY 1 ORDER BY total DESC, collection LIMIT 10"
_WORDS = "len(regexp_extract_all({c}, '[A-Za-z''-]+')) * 4"
_TOKENS = f"({_WORDS.format(c='query')} + {_WORDS.format(c='response')})"
_LIVE = "SELECT item_id, seq, op, round(value, 6) AS value FROM changes QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) = 1"


def oracle_sql() -> dict[str, str]:
    facets = "collection_name, m_year, m_type"
    found = _search(f"SELECT query_id, {facets}", "items").split(" SELECT query_id, ")[0]
    facet_rows = f"{found}, f AS (SELECT query_id, i.collection_name, i.m_year, i.m_type FROM hits h JOIN items i USING (item_id) WHERE rank <= 10)"
    asked = f"""asked AS (SELECT item_id % 40 AS b, min(array_to_string(string_split(text, ' ')[1:3], ' ')) AS query FROM benchmark GROUP BY 1),
      a AS (SELECT i.*, query, {_TEXT.format(c='description')} AS plain, list_filter(string_split(lower(query), ' '), lambda t: t NOT IN ('', '0')) AS terms FROM items i JOIN asked ON i.item_id % 40 = b)"""
    semantic = f"""WITH {_hashed('documents', 'doc_id', 'text')}, {_hashed('benchmark', 'item_id', 'text').replace('terms', 'terms2').replace('counts', 'counts2').replace('lengths', 'lengths2')},
            dots AS (SELECT b.k AS query_id, a.k AS item_id, sum(a.n * b.n) AS d FROM counts a JOIN counts2 b ON a.b = b.b GROUP BY 1, 2),
            alle AS (SELECT b.item_id AS query_id, a.doc_id AS item_id FROM documents a, benchmark b),
            s AS (SELECT query_id, item_id, round(coalesce(d / (x.length * y.length), 0), 12) AS s FROM alle LEFT JOIN dots USING (query_id, item_id) LEFT JOIN lengths x ON x.k = item_id LEFT JOIN lengths2 y ON y.k = query_id)"""
    examples = f"""SELECT id, concat('{{"messages":[{{"role":"system","content":', to_json('{DEFAULT.system_prompt}'), '}},{{"role":"user","content":', to_json(query), '}},{{"role":"assistant","content":', to_json(response), '}}]}}') AS value
            FROM training_pairs WHERE feedback = 1"""
    core = {
        "composed_search": semantic + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM s QUALIFY rank <= 5)
            SELECT query_id, any_value(b.text) AS query, string_agg(CAST(r.item_id AS VARCHAR), ',' ORDER BY rank) AS items, count(*) AS total_results FROM r JOIN benchmark b ON b.item_id = query_id GROUP BY query_id""",
        "exported_examples": sql(f", e AS ({examples}) SELECT value FROM e", "training_pairs"),
        "topk_single": sql(", " + _ONE.format(rows="vectors", where=""), "vectors"),
        "topk_filtered": sql(", " + _ONE.format(rows="vectors", where="WHERE collection_id IN (1, 2, 3)"), "vectors"),
        "topk_candidate_cap": sql(", " + _ONE.format(rows="(SELECT * FROM vectors ORDER BY item_id LIMIT 30)", where=""), "vectors"),
        "topk_multi": _search("SELECT query_id, item_id, rank, round(s, 6) AS similarity, round(s * 100, 1) AS score FROM hits WHERE rank <= 10"),
        "cosine_all": sql(
            """, x AS (SELECT item_id, collection_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vectors), c AS (SELECT collection_id, i, avg(x) AS x FROM x GROUP BY 1, 2),
            cc AS (SELECT collection_id, list(x ORDER BY i) AS centre FROM c GROUP BY 1) SELECT item_id, round(list_cosine_similarity(centre, vector), 6) AS similarity FROM vectors JOIN cc USING (collection_id)""", "vectors"),
        "trace_hits": _search("SELECT query_id, item_id, collection_name AS collection, round(s * 100, 1) AS score, round(s, 4) AS similarity FROM hits WHERE rank <= 5"),
        "search_trace": _search("SELECT query_id, (SELECT count(*) FROM vectors) AS vectors, (SELECT count(DISTINCT collection_id) FROM vectors) AS collections, count(*) AS hits FROM hits WHERE rank <= 5 GROUP BY 1"),
        "ranked_report": _search("SELECT query_id, rank, concat('Item ', item_id) AS title, collection_name AS collection, concat(printf('%.1f', round(s * 100, 1)), '%') AS score, permalink AS url FROM hits WHERE rank <= 5"),
        "documents_block": sql(f"SELECT item_id, {BLOCK} AS content FROM items", "items"),
        "documents_inline": sql(f"SELECT item_id, {INLINE} AS content FROM items", "items"),
        "documents_custom_fields": sql(f"SELECT item_id, {CUSTOM} AS content FROM items", "items"),
        "truncate_text": sql(
            f""", d AS (SELECT item_id, {INLINE} AS c FROM items), e AS (SELECT *, substr(c, 1, 2048) AS cut FROM d), f AS (SELECT *, length(cut) - strpos(reverse(cut), '.') AS dot FROM e)
            SELECT item_id, CASE WHEN length(c) <= 2048 THEN c WHEN strpos(cut, '.') > 0 AND dot > 0.8 * 2048 THEN substr(cut, 1, CAST(dot + 1 AS BIGINT)) ELSE cut END AS content FROM f""", "items"),
        "extract_sections": sql(
            f"""SELECT item_id, title AS x_title, trim(regexp_extract({BLOCK}, '(?s)DESCRIÇÃO:\\s*(.*?)(\\n\\n|\\z)', 1)) AS x_description, {_META_KV} AS x_metadata FROM items""", "items"),
        "strip_tags_pages": f"SELECT page_id, {_TEXT.format(c='html')} AS text FROM pages",
        "snippets": f"WITH items AS ({SQL['items']}), {asked} SELECT item_id, {_snippet('plain', 'terms')} AS snippet FROM a",
        "hash_embed": f"""WITH {_hashed('documents', 'doc_id', 'text')}, grid AS (SELECT doc_id AS k, unnest(range(16)) AS b FROM documents)
            SELECT k AS item_id, string_agg(CAST({_DOT} AS VARCHAR), ' ' ORDER BY b) AS vector FROM grid LEFT JOIN counts USING (k, b) LEFT JOIN lengths USING (k) GROUP BY k""",
        "semantic_search": semantic + " SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank, round(s, 6) AS similarity, round(s * 100, 1) AS score FROM s QUALIFY rank <= 10",
        "facet_counts": f"""{facet_rows}, g AS (SELECT query_id, 'collection' AS facet, collection_name AS value FROM f UNION ALL SELECT query_id, 'year', m_year FROM f UNION ALL SELECT query_id, 'type', m_type FROM f),
            n AS (SELECT query_id, facet, value, count(*) AS n FROM g GROUP BY 1, 2, 3), v AS (SELECT query_id, facet, count(*) AS k FROM n GROUP BY 1, 2)
            SELECT n.query_id, n.facet, value, n, n.facet IN ('collection', 'year') AND v.k > 1 AND c.k > 1 AS shown FROM n JOIN v USING (query_id, facet) JOIN v c ON c.query_id = n.query_id AND c.facet = 'collection'""",
        "facet_filter": f"""{facet_rows} SELECT query_id, count(*) FILTER (m_type IN ('en', 'de') AND collection_name IN ({', '.join(f"'src{k}'" for k in range(10))})) AS visible, count(*) AS total FROM f GROUP BY 1""",
        "format_hits": _formatted(f"SELECT query_id, rank, item_id AS id, title, {_META_KV} AS metadata, {_snippet('plain', 'terms')} AS snippet, collection_name AS collection, score FROM g"),
        "build_prompts": _formatted(
            f"""SELECT query_id, '{DEFAULT.system_prompt}' AS system, concat('Items:', chr(10), chr(10), coalesce(string_agg(concat('[', rank, '] ', title, chr(10), 'Collection: ', collection_name, chr(10),
            CASE WHEN len(words) > 0 THEN concat('Description: ', array_to_string(words[1:20], ' '), CASE WHEN len(words) > 20 THEN '…' ELSE '' END, chr(10)) ELSE '' END,
            'Metadata: ', {_meta("', '")}, chr(10), 'Link: ', url), chr(10) || chr(10) ORDER BY rank) FILTER (WHERE item_id IS NOT NULL), ''), chr(10), chr(10), 'Question: ', any_value(a.query)) AS user_prompt FROM asked a LEFT JOIN g USING (query_id) GROUP BY query_id"""),
        "search_log": _formatted(
            f"""SELECT query_id, any_value(a.query) AS query, coalesce(any_value(CASE WHEN rank = 1 THEN {_snippet('plain', 'terms')} END), '') AS response, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS items,
            string_agg(CASE WHEN is_first THEN collection_name END, ',' ORDER BY rank) AS collections, count(item_id) AS total_results
            FROM asked a LEFT JOIN (SELECT *, rank = min(rank) OVER (PARTITION BY query_id, collection_name) AS is_first FROM g) USING (query_id) GROUP BY query_id"""),
        "index_items": sql(
            f""", d AS (SELECT item_id, {BLOCK} AS c FROM items), e AS (SELECT *, substr(c, 1, 2048) AS cut FROM d), f AS (SELECT *, length(cut) - strpos(reverse(cut), '.') AS dot FROM e),
            n AS (SELECT item_id, CASE WHEN length(c) <= 2048 THEN length(c) WHEN strpos(cut, '.') > 0 AND dot > 0.8 * 2048 THEN dot + 1 ELSE 2048 END AS chars FROM f)
            SELECT item_id, item_id % 10 AS collection_id, CASE WHEN v.vec_id IS NULL THEN 'indexed' ELSE 'skipped' END AS outcome, CASE WHEN v.vec_id IS NULL THEN CAST(chars AS BIGINT) END AS chars, 1.0::DOUBLE AS norm
            FROM n LEFT JOIN embeddings v ON v.vec_id = item_id""", "items"),
        "item_exists": "SELECT doc_id AS item_id, doc_id % 10 AS collection_id, doc_id IN (SELECT vec_id FROM embeddings) AS indexed FROM documents",
        "embedding_batches": "WITH RECURSIVE items AS (" + SQL["items"] + f"""), d AS (SELECT item_id, length({BLOCK}) / 4.0::DOUBLE AS tokens, row_number() OVER (ORDER BY item_id) AS k FROM items),
            r AS (SELECT k, item_id, tokens, CAST(0 AS BIGINT) AS batch, 1 AS texts, tokens AS total FROM d WHERE k = 1
            UNION ALL SELECT d.k, d.item_id, d.tokens, CASE WHEN texts >= {DEFAULT.batch_texts} OR total + d.tokens > {DEFAULT.batch_tokens} THEN batch + 1 ELSE batch END,
            CASE WHEN texts >= {DEFAULT.batch_texts} OR total + d.tokens > {DEFAULT.batch_tokens} THEN 1 ELSE texts + 1 END, CASE WHEN texts >= {DEFAULT.batch_texts} OR total + d.tokens > {DEFAULT.batch_tokens} THEN d.tokens ELSE total + d.tokens END
            FROM r JOIN d ON d.k = r.k + 1) SELECT item_id, CAST(0 AS BIGINT) AS bucket, batch, tokens FROM r""",
        "browser_pages": sql(
            """, n AS (SELECT collection_id, item_id, row_number() OVER (PARTITION BY collection_id ORDER BY item_id) AS k, count(*) OVER (PARTITION BY collection_id) AS n FROM items),
            s AS (SELECT *, CASE WHEN n < 50 THEN 5 WHEN n < 200 THEN 10 WHEN n < 1000 THEN 20 ELSE 30 END AS size FROM n)
            SELECT collection_id, item_id, CAST(size AS BIGINT) AS batch_size, CAST(floor((k - 1) / size) + 1 AS BIGINT) AS page FROM s""", "items"),
        "selected_collections": sql("SELECT id, name, id IN (SELECT user_id % 5 FROM events WHERE event_type = 'error') AS selected FROM collections", "collections"),
        "history_of_user": sql("SELECT id, query FROM history WHERE user_id = 5", "history"),
        "history_without_accents": sql("SELECT id, concat(CASE WHEN id % 2 = 0 THEN 'Coleção ' ELSE 'colecao ' END, query) AS query FROM history WHERE contains(lower(query), 'view') AND starts_with(query, 'view')", "history"),
        "history_last_days": sql("SELECT id, created_at FROM history WHERE created_at >= TIMESTAMP '2024-01-13' AND created_at < TIMESTAMP '2024-01-21'", "history"),
        "history_items": sql("SELECT id, CASE WHEN feedback IS NULL THEN 0 ELSE len(collections_used) END AS n_items FROM history", "history"),
        "catalogue": sql("SELECT id, name, '' AS description, '' AS url, CAST(CASE WHEN id % 2 = 0 THEN items_count ELSE 0 END AS BIGINT) AS items_count FROM collections", "collections"),
        "one_collection": sql("SELECT id, name, items_count FROM collections WHERE id = 3", "collections"),
        "read_items": sql("SELECT item_id, collection_id, title, length(description) AS chars, m_type FROM items", "items"),
        "metadata_defs": sql("SELECT DISTINCT collection_id, CAST(k AS BIGINT) AS id, CASE k WHEN 1 THEN 'type' ELSE 'year' END AS name, 'text' AS type, '' AS description FROM items, (VALUES (1), (2)) t(k)", "items"),
        "exported_index": sql("SELECT item_id, collection_name, array_to_string(list_transform(vector, lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ' ') AS vector FROM vectors", "vectors"),
        "exported_history": sql("SELECT id, query, feedback, array_to_string(list_sort(collections_used), ',') AS collections FROM history", "history"),
        "appended_history": sql("SELECT id, created_at, CAST(created_at AS DATE) AS created_date FROM history WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21'", "history"),
        "config_row": sql(f"SELECT count(*) AS collections, CAST({DEFAULT.max_items} AS BIGINT) AS max_items, CAST({DEFAULT.chunk_size} AS BIGINT) AS chunk_size FROM collections", "collections"),
        "inverted_lists": sql("SELECT item_id AS query_id, item_id, 1.0::DOUBLE AS similarity, true AS reached FROM vectors WHERE item_id % 20 = 0", "vectors"),
        "snapshot": sql("SELECT item_id, collection_id, collection_name FROM vectors", "vectors"),
        "total_vectors": "SELECT count(*) AS total FROM embeddings",
        "vectors_by_collection": sql("SELECT collection_id, collection_name, count(*) AS total FROM vectors GROUP BY 1, 2", "vectors"),
        "collection_stats": sql("SELECT collection_id, count(*) AS total, min(last_updated) AS first_update, max(last_updated) AS last_update, count(DISTINCT item_id) AS items, max(collection_name) AS collection_name FROM vectors GROUP BY 1", "vectors"),
        "index_health": sql(
            """, r AS (SELECT 'vectors' AS "check", count(*) AS value FROM vectors UNION ALL SELECT 'collections_with_vectors', count(DISTINCT collection_id) FROM vectors
            UNION ALL SELECT 'enabled_collections', count(*) FILTER (enabled) FROM collections UNION ALL SELECT 'collections', count(*) FROM collections)
            SELECT "check", value, CASE WHEN value > 0 THEN 'ok' ELSE 'warning' END AS status FROM r""", "vectors", "collections"),
        "index_coverage": sql(
            """SELECT id, name, items_count, coalesce(n, 0) AS vectors, CASE WHEN items_count > 0 THEN round(100.0 * coalesce(n, 0) / items_count, 0) ELSE 0.0 END::DOUBLE AS percent
            FROM collections LEFT JOIN (SELECT collection_id AS id, count(*) AS n FROM vectors GROUP BY 1) USING (id)""", "collections", "vectors"),
        "enabled_collections": sql("SELECT id, name, items_count FROM collections WHERE enabled", "collections"),
        "resolve_collections": sql(
            """, asked AS (SELECT DISTINCT user_id AS query_id, user_id % 7 AS collection_id FROM events), e AS (SELECT id FROM collections WHERE enabled),
            w AS (SELECT query_id, collection_id FROM asked JOIN e ON e.id = collection_id)
            SELECT * FROM w UNION ALL SELECT query_id, e.id AS collection_id FROM (SELECT DISTINCT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM w)), e""", "collections"),
        "pending_items": "SELECT doc_id AS item_id, doc_id % 10 AS collection_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "upsert_vectors": sql(
            """, new AS (SELECT item_id * 2 AS item_id, collection_id, concat('new ', collection_name) AS collection_name, permalink FROM vectors)
            SELECT item_id, collection_id, collection_name, permalink FROM vectors o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.item_id = o.item_id AND n.collection_id = o.collection_id)
            UNION ALL SELECT * FROM new""", "vectors"),
        "remove_orphans": sql("SELECT item_id, collection_id FROM vectors v WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = v.item_id AND d.doc_id % 10 = v.collection_id)", "vectors"),
        "delete_collections": sql("SELECT item_id, collection_id FROM vectors WHERE collection_id NOT IN (1, 2)", "vectors"),
        "outcome_counts": sql(
            """SELECT collection_id, count(*) FILTER (v.vec_id IS NULL AND description <> '') AS indexed, count(*) FILTER (v.vec_id IS NOT NULL) AS skipped, count(*) FILTER (v.vec_id IS NULL AND description = '') AS failed
            FROM items LEFT JOIN embeddings v ON v.vec_id = item_id GROUP BY 1""", "items"),
        "apply_changes": f"WITH changes AS ({SQL['changes']}), l AS ({_LIVE}) SELECT * FROM l WHERE op <> 'deleted'",
        "stream_index": f"WITH changes AS ({SQL['changes']}), l AS ({_LIVE}) SELECT * FROM l WHERE op <> 'deleted'",
        "item_pages": sql(
            """, n AS (SELECT collection_id, item_id, row_number() OVER (PARTITION BY collection_id ORDER BY item_id) AS k, count(*) OVER (PARTITION BY collection_id) AS n FROM items),
            s AS (SELECT *, CASE WHEN n <= 100 THEN 50 WHEN n <= 500 THEN 30 WHEN n <= 1000 THEN 20 ELSE 10 END AS size FROM n)
            SELECT collection_id, item_id, CAST(size AS BIGINT) AS batch_size, CAST(floor((k - 1) / size) + 1 AS BIGINT) AS page FROM s""", "items"),
        "search_history": sql(
            """SELECT id, created_at, user_id, query FROM history WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21'
            AND len(list_filter(collections_used, lambda c: contains(lower(c), 'c3'))) > 0 AND (contains(lower(query), 'purchase') OR contains(lower(response), 'purchase')) AND feedback = 1""", "history"),
        "history_page": sql(
            """SELECT id, created_at, query, CASE WHEN feedback = 1 THEN 'positive' WHEN feedback = 0 THEN 'negative' ELSE 'none' END AS feedback
            FROM history ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100""", "history"),
        "search_detail": sql("SELECT id, query, unnest(collections_used) AS collection FROM history WHERE id = 5", "history"),
        "search_stats_day": _stats("day"),
        "search_stats_week": _stats("week"),
        "search_stats_month": _stats("month"),
        "recent_periods": _stats("day", 7),
        "top_collections": sql(f", c AS ({_PREFIXED}) {_TOP}", "history"),
        "top_collections_prelimit": sql(f", c AS ({_PREFIXED} ORDER BY n DESC, array_to_string(used, ',') LIMIT 10) {_TOP}", "history"),
        "dashboard_kpis": sql(
            """SELECT count(*) AS searches, CAST(30 AS BIGINT) AS days, round(count(*) / 30.0, 1)::DOUBLE AS per_day, coalesce(round(100.0 * count(*) FILTER (feedback = 1) / nullif(count(feedback), 0), 0), 0)::DOUBLE AS positive_percent
            FROM history WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-31'""", "history"),
        "latest_search_ids": sql("SELECT query, id FROM history QUALIFY row_number() OVER (PARTITION BY query ORDER BY created_at DESC, id DESC) = 1", "history"),
        "apply_feedback": sql(
            """, f AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS id, max(event_id) AS seq FROM events GROUP BY 1)
            SELECT h.id, CASE WHEN f.id IS NULL THEN feedback ELSE CAST(seq % 2 AS INTEGER) END AS feedback, CASE WHEN f.id IS NOT NULL THEN concat('note ', seq) END AS feedback_notes FROM history h LEFT JOIN f ON f.id = h.id""", "history"),
        "client_address": """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.', user_id) WHEN event_id % 2 = 0 THEN concat('10.0.1.', user_id) ELSE concat('10.0.2.', user_id) END AS address FROM events""",
        "training_kpis": sql(
            f"SELECT count(*) AS examples, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, round(sum({_TOKENS})::DOUBLE / count(*), 0) AS mean_tokens, round(sum({_TOKENS})::DOUBLE / 1000 * {DEFAULT.cost_per_1000_tokens}, 2) AS cost FROM training_pairs", "training_pairs"),
        "fine_tuning_examples": sql(examples, "training_pairs"),
        "trim_words": sql(
            """, w AS (SELECT item_id, list_filter(regexp_split_to_array(description, '\\s+'), lambda x: x <> '') AS w FROM items)
            SELECT item_id, concat(array_to_string(w[1:12], ' '), CASE WHEN len(w) > 12 THEN '…' ELSE '' END) AS text FROM w""", "items"),
        "id_lists": "SELECT doc_id, doc_id + n_chars AS total FROM documents",
        "content_previews": "SELECT doc_id AS item_id, concat(substr(text, 1, 100), '...') AS preview FROM documents",
        "run_totals": sql(
            """SELECT collection_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(success) AS BIGINT) AS success, CAST(sum(failed) AS BIGINT) AS failed, count(*) AS runs FROM runs GROUP BY ROLLUP (collection_id)""", "runs"),
        "latest_runs": sql(
            """SELECT collection_id, run_day, CAST(total AS BIGINT) AS total, CAST(success AS BIGINT) AS success, CAST(failed AS BIGINT) AS failed, least(round(100.0 * success / total, 0), 100)::DOUBLE AS progress
            FROM runs QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY run_day DESC) = 1""", "runs"),
        "prune_runs": sql(
            """SELECT collection_id, run_day, CASE WHEN failed > 0 THEN 'processing' ELSE 'completed' END AS status FROM runs WHERE failed > 0 OR run_day >= DATE '2024-01-20'""", "runs"),
        "last_errors": """SELECT user_id % 10 AS collection_id, event_id AS seq, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id DESC) AS place FROM events WHERE event_type = 'error' QUALIFY place <= 10""",
        "log_levels": sql(
            """SELECT CASE WHEN contains(value, '[ERROR]') THEN 'error' WHEN contains(value, '[DEBUG]') THEN 'debug' ELSE 'none' END AS level, count(*) AS n FROM log_lines WHERE contains(value, '[app]') GROUP BY 1""", "log_lines"),
        "log_tail": sql(
            """SELECT line_no, value, CASE WHEN contains(value, '[ERROR]') THEN 'error' WHEN contains(value, '[DEBUG]') THEN 'debug' ELSE 'none' END AS level FROM log_lines
            WHERE contains(value, '[app]') ORDER BY line_no DESC LIMIT 50""", "log_lines"),
        "item_metadata": sql("SELECT item_id, collection_id, title, m_type, m_year, CAST(2 AS BIGINT) AS entries FROM items", "items"),
        "stream_search_counts": sql("SELECT CAST(created_at AS DATE) AS day, count(*) AS total FROM history GROUP BY 1", "history"),
    }
    return core | upkeep.oracle_sql(core["embedding_batches"])
