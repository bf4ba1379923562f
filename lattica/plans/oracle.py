"""DuckDB SQL for the note-analytics queries, written from their definitions and independent of the Spark plans."""

from __future__ import annotations

from lattica.functions import fixed


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


NOTES = """notes AS (
  SELECT doc_id AS note_id, source AS user_id, substr(text, 1, 40) AS title, text AS content_text, [lang, source] AS tags,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 100003) AS updated_at FROM documents)"""

#: Notes after some came, changed and went, as ``q_links_changed`` has them.
CHANGED = """notes AS (
  SELECT doc_id AS note_id, source AS user_id, substr(text, 1, 40) AS title, CASE WHEN doc_id % 10 = 4 THEN substr(text, 200, 400) ELSE text END AS content_text,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 100003) + CASE WHEN doc_id % 10 = 4 THEN INTERVAL 100 DAY ELSE INTERVAL 0 DAY END AS updated_at
  FROM documents WHERE doc_id % 10 <> 5)"""

#: Notes that a notebook links after ``q_notebook``'s changes: new ones have no keywords yet, and only owners' patches count.
NOTEBOOK = """notes AS (
  SELECT doc_id AS note_id, source AS user_id, substr(text, 1, 40) AS title, CASE WHEN doc_id % 20 = 4 THEN substr(text, 200, 400) ELSE text END AS content_text,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 100003) + CASE WHEN doc_id % 20 = 4 THEN INTERVAL 100 DAY ELSE INTERVAL 0 DAY END AS updated_at
  FROM documents WHERE doc_id % 10 NOT IN (3, 5))"""

_SPLIT = "string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' ')"
_RANK = "row_number() OVER (PARTITION BY {} ORDER BY {} DESC, CASE WHEN iv IS NULL THEN 1 ELSE 0 END, coalesce(iv, 0), {})"
_INT = "CASE WHEN regexp_full_match(word, '0|[1-9][0-9]{0,8}') THEN word::BIGINT END AS iv"

KW = f"""{NOTES},
split AS (SELECT user_id, note_id, {_SPLIT.format("title || ' ' || title || ' ' || content_text")} AS w FROM notes),
toks AS (SELECT user_id, note_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split),
tf AS (SELECT user_id, note_id, word, count(*) AS tf, min(pos) AS first_pos FROM toks
  WHERE length(word) > 2 AND word NOT IN {_list(fixed.KEYWORD_STOPWORDS)} GROUP BY ALL),
scored AS (SELECT *, {_INT}, round(tf * (ln(2.0::DOUBLE) + 1) * (1 + ln(length(word)::DOUBLE)), 6) AS score FROM tf),
kw AS (SELECT user_id, note_id, word AS keyword, score, {_RANK.format("note_id", "score", "first_pos")} AS rank FROM scored QUALIFY rank <= 10)"""

LINKS = f"""{KW},
size AS (SELECT note_id, count(*) AS size FROM kw GROUP BY note_id),
pairs AS (SELECT a.user_id, a.note_id AS source, b.note_id AS target, count(*) AS n, string_agg(b.keyword, '|' ORDER BY b.rank) AS shared
  FROM kw a JOIN kw b ON a.user_id = b.user_id AND a.keyword = b.keyword AND a.note_id <> b.note_id GROUP BY ALL),
strong AS (SELECT p.user_id, source, target, round(n / greatest(size, 1), 4) AS strength, shared FROM pairs p JOIN size s ON s.note_id = p.source),
own AS (SELECT * FROM strong WHERE strength > 0.15 QUALIFY row_number() OVER (PARTITION BY source ORDER BY strength DESC, target) <= 8),
back AS (SELECT own.user_id, target AS note_id, source AS other, strength, shared FROM own JOIN notes a ON a.note_id = source JOIN notes b ON b.note_id = target
  WHERE a.updated_at > b.updated_at OR a.updated_at = b.updated_at AND source > target),
final AS (SELECT coalesce(o.user_id, b.user_id) AS user_id, coalesce(o.source, b.note_id) AS note_id, coalesce(o.target, b.other) AS other,
    coalesce(b.strength, o.strength) AS strength, coalesce(b.shared, o.shared) AS shared
  FROM own o FULL JOIN back b ON o.user_id = b.user_id AND o.source = b.note_id AND o.target = b.other)"""

_TEXT3 = "title || ' ' || title || ' ' || content_text"


def _subs(asked: str) -> str:
    return f"""asked AS ({asked}),
sent AS (SELECT note_id, keyword, unnest(s) AS sentence, unnest(range(len(s))) AS nth FROM
  (SELECT n.note_id, keyword, regexp_split_to_array(content_text, '[.!?\\n]+') AS s FROM notes n JOIN asked USING (note_id))),
sw AS (SELECT note_id, keyword, nth, unnest(w) AS word, unnest(range(len(w))) AS pos FROM
  (SELECT note_id, keyword, nth, {_SPLIT.format("sentence")} AS w FROM sent WHERE contains(lower(sentence), lower(keyword)))),
sc AS (SELECT note_id, keyword, word, count(*) AS n, min(nth * 1000000 + pos) AS first FROM sw
  WHERE length(word) > 3 AND word NOT IN {_list(fixed.GRAPH_STOPWORDS)} AND word <> lower(keyword)
    AND NOT EXISTS (SELECT 1 FROM kw k WHERE k.note_id = sw.note_id AND k.keyword = sw.word) GROUP BY ALL),
subs AS (SELECT note_id, keyword, word AS sub, n, {_RANK.format("note_id, keyword", "n", "first")} AS rank
  FROM (SELECT *, {_INT} FROM sc) QUALIFY rank <= 5)"""


def _graph(expanded: list[str]) -> str:
    return f"""{KW}, {_subs(f"SELECT note_id, keyword FROM kw WHERE keyword IN {_list(expanded)}")},
gt AS (SELECT note_id, unnest(regexp_split_to_array(lower({_TEXT3}), '[^a-z0-9_]+')) AS keyword FROM notes),
gc AS (SELECT note_id, keyword, count(*) AS count FROM gt GROUP BY ALL),
gs AS (SELECT kw.*, round(coalesce(count, 0) / greatest(max(coalesce(count, 0)) OVER (PARTITION BY kw.note_id), 1), 3) AS kw_score
  FROM kw LEFT JOIN gc USING (note_id, keyword)),
gtags AS (SELECT note_id, unnest(tags) AS tag FROM notes WHERE note_id IN (SELECT note_id FROM kw)),
nodes AS (
  SELECT note_id, 'root' AS id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS label, 'note' AS type, 0 AS level, NULL::INT AS size, NULL::DOUBLE AS score, NULL AS parent FROM notes
  UNION ALL SELECT note_id, 'kw_' || keyword, keyword, 'keyword', 1, (44 + floor(kw_score * 24 + 0.5))::INT, kw_score, NULL FROM gs
  UNION ALL SELECT note_id, 'tag_' || tag, '#' || tag, 'tag', 1, 28, NULL, NULL FROM gtags
  UNION ALL SELECT note_id, 'sub_' || keyword || '_' || sub, sub, 'subkeyword', 2, 22, NULL, keyword FROM subs),
edges AS (
  SELECT note_id, 'e_root_' || keyword AS id, 'root' AS source, 'kw_' || keyword AS target, 'keyword-edge' AS type FROM gs
  UNION ALL SELECT note_id, 'e_root_tag_' || tag, 'root', 'tag_' || tag, 'tag-edge' FROM gtags
  UNION ALL SELECT note_id, 'e_' || keyword || '_' || sub, 'kw_' || keyword, 'sub_' || keyword || '_' || sub, 'sub-edge' FROM subs)"""


GLOBAL = f"""{KW},
col AS (SELECT *, {fixed.GRAPH_COLOURS!r}[((row_number() OVER (PARTITION BY user_id ORDER BY note_id) - 1) % 12 + 1)::INT] AS colour FROM notes),
conn AS (SELECT a.note_id, count(DISTINCT b.note_id) AS c FROM kw a JOIN kw b ON a.user_id = b.user_id AND a.keyword = b.keyword AND a.note_id <> b.note_id GROUP BY ALL),
usage AS (SELECT user_id, keyword, count(*) AS u FROM kw GROUP BY ALL),
gnodes AS (
  SELECT user_id, note_id::VARCHAR AS id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS label, 'note' AS type, 1 AS level,
    (64 + least(6 * coalesce(c, 0), 24))::INT AS size, NULL AS parent, colour, false AS shared, 'global-note-node' AS classes FROM col LEFT JOIN conn USING (note_id)
  UNION ALL SELECT kw.user_id, 'kw_' || kw.note_id || '_' || kw.keyword, kw.keyword, 'keyword', 2, (38 + least(4 * u, 14))::INT, kw.note_id::VARCHAR, colour, u > 1,
    CASE WHEN u > 1 THEN 'global-kw-node shared-kw' ELSE 'global-kw-node' END FROM kw JOIN usage ON usage.user_id = kw.user_id AND usage.keyword = kw.keyword JOIN col ON col.note_id = kw.note_id),
gedges AS (
  SELECT user_id, 'e_' || note_id || '_' || keyword AS id, note_id::VARCHAR AS source, 'kw_' || note_id || '_' || keyword AS target, 'note-keyword' AS type, NULL AS shared_keyword FROM kw
  UNION ALL SELECT a.user_id, 'cross_kw_' || a.note_id || '_' || a.keyword || '_kw_' || b.note_id || '_' || b.keyword, 'kw_' || a.note_id || '_' || a.keyword,
    'kw_' || b.note_id || '_' || b.keyword, 'cross-link', a.keyword FROM kw a JOIN kw b ON a.user_id = b.user_id AND a.keyword = b.keyword AND a.note_id < b.note_id)"""

SEARCHABLE = f"""{KW}, s AS (SELECT n.*, coalesce(ks, []::VARCHAR[]) AS keywords FROM notes n
  LEFT JOIN (SELECT note_id, list(keyword ORDER BY rank) AS ks FROM kw GROUP BY note_id) USING (note_id))"""


def _snippet(query: str) -> str:
    q = query.lower()
    at = f"(strpos(lower(content_text), '{q}') - 1)"
    start, end = f"greatest({at} - 60, 0)", f"least({at} + 120, length(content_text))"
    hit = f"(CASE WHEN {start} > 0 THEN '…' ELSE '' END || substr(content_text, {start} + 1, {end} - {start}) || CASE WHEN {end} < length(content_text) THEN '…' ELSE '' END)"
    return f"CASE WHEN {at} < 0 THEN substr(content_text, 1, 180) ELSE {hit} END" if q else "substr(content_text, 1, 180)"


def _results(query: str) -> str:
    return f"note_id, title, array_to_string(tags, '|') AS tags, array_to_string(keywords, '|') AS keywords, {_snippet(query)} AS snippet, updated_at"


VERSIONS = """saves AS (SELECT user_id AS note_id, ts AS saved_at, props AS content_text, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM events),
versions AS (SELECT note_id, least(nth, 21)::INT AS version_number, saved_at, content_text, row_number() OVER (PARTITION BY note_id ORDER BY saved_at DESC, nth DESC) AS age FROM saves QUALIFY age <= 20)"""

CARDS = """cards AS (SELECT conv_id, turn, q, a FROM (SELECT conv_id, turn, role, text AS q, lead(text) OVER w AS a, lead(role) OVER w AS answerer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND answerer = 'assistant')"""

_FILE = "coalesce(nullif(substr(regexp_replace(regexp_replace(trim(title, ' \t\n\r'), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'note')"


_TRIM = "trim({}, ' \t\n\r')"
_KIDS = f"{_TRIM.format('substr(content_text, 1, 50)')} || ' ' || {_TRIM.format('substr(content_text, 60, 50)')}"
_FLAT = _TRIM.format(_TRIM.format("array_to_string(list_filter([title, " + _TRIM.format(_KIDS) + "], lambda x: x <> ''), ' ')") + " || ' end'")


def _escaped(text: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{sign}', '{name}')"
    return text


def _page(title: str, body: str) -> str:
    return f"""'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body>' || chr(10) || '<h1>{title}</h1>' || {body} || '</body></html>'"""


def statements() -> dict[str, str]:
    from lattica.plans.registry import EXPANDED, LONG_QUERY, QUERY

    terms = ["thion", "ouer"]  # the others are stop words
    semantic = " + ".join(
        [f"CASE WHEN contains(lower(title), '{QUERY}') THEN 5 ELSE 0 END"]
        + [f"CASE WHEN list_contains(keywords, '{k}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(title), '{k}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(content_text), '{k}') THEN 1 ELSE 0 END" for k in terms]
    )
    fields = ("title", "content_text", "array_to_string(tags, ' ')")
    lists = [f"list_filter({_SPLIT.format(f)}, lambda w: w <> '')" for f in fields]
    relevant = lambda asked: " + ".join(f"len(list_filter(f{i}, lambda w: w = '{t}')) / greatest(len(f{i}), 1)::DOUBLE" for i in range(3) for t in asked)
    searched = lambda asked: f"""WITH {SEARCHABLE}, f AS (SELECT note_id, {", ".join(f"{x} AS f{i}" for i, x in enumerate(lists))} FROM s)
            SELECT note_id, round({relevant(asked)}, 6) AS score FROM f WHERE score > 0 ORDER BY score DESC, note_id LIMIT 20"""  # noqa: E731
    words = lambda stop, n: f"WITH {NOTES} SELECT note_id, array_to_string(list_filter({_SPLIT.format('content_text')}, lambda w: length(w) > {n} AND w NOT IN {_list(stop)}), ' ') AS words FROM notes"
    regex = lambda p: f"(regexp_matches(title, '(?i){p}') OR regexp_matches(content_text, '(?i){p}') OR len(list_filter(tags, lambda x: regexp_matches(x, '(?i){p}'))) > 0 OR len(list_filter(keywords, lambda x: regexp_matches(x, '(?i){p}'))) > 0)"
    graph = _graph(EXPANDED)
    expand = f"{KW}, {_subs('SELECT note_id, unnest(' + repr(EXPANDED) + ') AS keyword FROM notes')}"
    title = "CASE WHEN title = '' THEN 'Untitled' ELSE title END"
    return {
        "q_tokenise_kw": words(fixed.KEYWORD_STOPWORDS, 2),
        "q_tokenise_graph": words(fixed.GRAPH_STOPWORDS, 3),
        "q_keywords": f"WITH {KW} SELECT user_id, note_id, keyword, score, rank::INT AS rank FROM kw",
        "q_keywords_corpus": f"""WITH {KW}, df AS (SELECT user_id, word, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT user_id, count(*) AS n FROM notes GROUP BY ALL),
            sc AS (SELECT tf.*, {_INT}, round(tf * (ln((greatest(n, 1) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1) * (1 + ln(length(word)::DOUBLE)), 6) AS score
              FROM tf JOIN df USING (user_id, word) JOIN n USING (user_id))
            SELECT user_id, note_id, word AS keyword, score, ({_RANK.format("note_id", "score", "first_pos")})::INT AS rank FROM sc QUALIFY rank <= 10""",
        "q_color_map": f"""WITH {KW}, t AS (SELECT n.user_id, n.note_id, coalesce(keyword, '__uncategorised__') AS top_keyword FROM notes n LEFT JOIN (SELECT * FROM kw WHERE rank = 1) k USING (note_id)),
            f AS (SELECT user_id, top_keyword, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS nth FROM (SELECT user_id, top_keyword, min(note_id) AS first FROM t GROUP BY ALL))
            SELECT t.user_id, note_id, t.top_keyword, {fixed.TOPIC_COLOURS!r}[(nth % 8 + 1)::INT] AS colour FROM t JOIN f ON t.user_id = f.user_id AND t.top_keyword = f.top_keyword""",
        "q_links_top8": f"WITH {LINKS} SELECT user_id, source, target, strength, shared FROM own",
        "q_links_final": f"WITH {LINKS} SELECT * FROM final",
        "q_links_populated": f"""WITH {LINKS} SELECT f.note_id, other, title AS other_title, strength, CASE WHEN strength > 0.6 THEN 'Strong' WHEN strength >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS badge,
            (row_number() OVER (PARTITION BY f.note_id ORDER BY strength DESC, other))::INT AS place FROM final f LEFT JOIN notes n ON n.note_id = f.other""",
        "q_related_overlap": f"WITH {KW} SELECT DISTINCT a.note_id, b.note_id AS related_id FROM kw a JOIN kw b ON a.user_id = b.user_id AND a.keyword = b.keyword AND a.note_id <> b.note_id",
        "q_unlink": f"WITH {LINKS} SELECT note_id, other, strength FROM final f WHERE (note_id + other) % 5 <> 0",
        "q_delete_note": f"WITH {LINKS} SELECT note_id, other, strength FROM final WHERE note_id % 7 <> 0 AND other % 7 <> 0",
        "q_note_graph_nodes": f"WITH {graph} SELECT * FROM nodes",
        "q_note_graph_edges": f"WITH {graph} SELECT * FROM edges",
        "q_note_graph_collapsed": f"WITH {graph} SELECT * FROM nodes WHERE NOT (level = 2 AND coalesce(parent, '') = '{EXPANDED[0]}')",
        "q_expand": f"WITH {expand} SELECT note_id, keyword, sub, n, rank::INT AS rank FROM subs",
        "q_sub_places": f"WITH {expand} SELECT note_id, keyword, sub, (rank - 1 - (count(*) OVER (PARTITION BY note_id, keyword) - 1) / 2) * 72.0::DOUBLE AS x, 95.0::DOUBLE AS y FROM subs",
        "q_spacing": f"WITH {KW} SELECT user_id, CASE WHEN count(*) > 30 THEN 1.3 WHEN count(*) > 15 THEN 1.6 ELSE 2.0 END::DOUBLE AS whole, CASE WHEN count(*) / 100 > 15 THEN 1.5 ELSE 2.0 END::DOUBLE AS single FROM kw GROUP BY user_id",
        "q_global_nodes": f"WITH {GLOBAL} SELECT * FROM gnodes",
        "q_global_edges": f"WITH {GLOBAL} SELECT * FROM gedges",
        "q_graph_stats": f"""WITH {GLOBAL} SELECT n.user_id, notes, keywords, coalesce(cross_links, 0) AS cross_links FROM
            (SELECT user_id, count(*) FILTER (type = 'note') AS notes, count(*) FILTER (type = 'keyword') AS keywords FROM gnodes GROUP BY 1) n LEFT JOIN
            (SELECT user_id, count(*) FILTER (type = 'cross-link') AS cross_links FROM gedges GROUP BY 1) e USING (user_id)""",
        "q_graph_highlight": f"WITH {GLOBAL}, hit AS (SELECT user_id, id FROM gnodes WHERE contains(lower(label), 'thi')) SELECT e.* FROM gedges e WHERE EXISTS (SELECT 1 FROM hit WHERE hit.user_id = e.user_id AND hit.id IN (e.source, e.target))",
        "q_search_tags": f"WITH {SEARCHABLE} SELECT {_results('')} FROM s WHERE len(list_filter(list_concat(tags, keywords, [title]), lambda x: regexp_matches(x, '(?i)fr'))) > 0 ORDER BY note_id LIMIT 20",
        "q_search_recent": f"WITH {SEARCHABLE} SELECT {_results('')} FROM s ORDER BY updated_at DESC, note_id LIMIT 10",
        "q_search_semantic": f"WITH {SEARCHABLE} SELECT note_id, ({semantic})::INT AS score FROM s WHERE score > 0 ORDER BY score DESC, note_id LIMIT 20",
        "q_search_keyword": searched(terms),
        "q_search_long": searched(LONG_QUERY.split()),
        "q_search_regex": f"WITH {SEARCHABLE}, x AS (SELECT * FROM s WHERE {regex('th.on')} ORDER BY note_id LIMIT 20) SELECT {_results('thion')} FROM x",
        "q_search_tagfilter": f"WITH {SEARCHABLE}, x AS (SELECT * FROM s WHERE {regex('er')} ORDER BY note_id LIMIT 20) SELECT note_id, title FROM x WHERE list_has_any(tags, ['de', 'src3'])",
        "q_search_patterns": f"WITH {SEARCHABLE} " + " UNION ALL ".join(f"SELECT {i} AS pattern, note_id, title FROM (SELECT * FROM s WHERE {regex(p)} ORDER BY note_id LIMIT 20)" for i, p in enumerate(["th.on", "[*][*][*] ", "[aeiou]nd (the|der)+ in", "nding", "(ouer|erst)x?"])),
        "q_search_indexed": f"SELECT query_id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id)::INT AS place FROM (SELECT 0::BIGINT AS query_id, * FROM ({searched(terms)}) UNION ALL SELECT 1::BIGINT, * FROM ({searched(LONG_QUERY.split())}))",
        "q_search_batch": f"""WITH {NOTES}, f AS (SELECT note_id, unnest([0, 1, 2]) AS field, unnest([{", ".join(lists)}]) AS ws FROM notes),
            q AS (SELECT item_id AS query_id, unnest({_SPLIT.format("substr(text, 1, 80)")}) AS term FROM benchmark),
            asked AS (SELECT query_id, term, count(*) AS n FROM q WHERE length(term) > 2 AND term NOT IN {_list(fixed.KEYWORD_STOPWORDS)} GROUP BY ALL),
            tf AS (SELECT note_id, field, len(ws) AS words, unnest(ws) AS term FROM f),
            hits AS (SELECT query_id, note_id, field, n * count(*) / any_value(words)::DOUBLE AS part FROM tf JOIN asked USING (term) GROUP BY query_id, note_id, field, term, n),
            scored AS (SELECT query_id, note_id, round(sum(part), 6) AS score FROM hits GROUP BY query_id, note_id)
            SELECT query_id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id)::INT AS place FROM scored WHERE score > 0 QUALIFY place <= 20""",
        "q_notebook": f"""WITH {NOTEBOOK} SELECT note_id, title, md5(content_text) AS text_md5, updated_at FROM notes
            UNION ALL SELECT doc_id, CASE WHEN doc_id % 20 = 3 OR text = '' THEN 'Untitled Note' ELSE substr(text, 1, 40) END, md5(text), TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 100003) FROM documents WHERE doc_id % 10 = 3""",
        "q_notebook_links": f"WITH {LINKS.replace(NOTES, NOTEBOOK)} SELECT * FROM final",
        "q_links_changed": f"WITH {LINKS.replace(NOTES, CHANGED)} SELECT * FROM final",
        "q_versions_stream": f"WITH {VERSIONS} SELECT note_id, version_number, saved_at, content_text FROM versions",
        "q_snippet": f"WITH {NOTES} SELECT note_id, {_snippet('Tion')} AS snippet FROM notes",
        "q_versions": f"WITH {VERSIONS} SELECT note_id, version_number, saved_at, content_text FROM versions",
        "q_version_list": f"WITH {VERSIONS} SELECT note_id, version_number, saved_at, substr(content_text, 1, 100) AS preview, age = 1 AS current FROM versions",
        "q_version_number": f"WITH {VERSIONS} SELECT note_id, version_number, min(saved_at) AS saved_at FROM versions WHERE version_number = 21 GROUP BY ALL",
        "q_orphan_versions": f"WITH {VERSIONS} SELECT note_id, version_number, saved_at FROM versions WHERE note_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)",
        "q_create": f"WITH {NOTES} SELECT note_id, user_id, CASE WHEN note_id % 2 = 0 AND title <> '' THEN title ELSE 'Untitled Note' END AS title, content_text FROM notes",
        "q_update": f"WITH {NOTES} SELECT note_id, CASE WHEN note_id % 6 = 0 THEN 'new ' || title ELSE title END AS title, length(content_text)::BIGINT AS n_chars FROM notes",
        "q_upsert": f"WITH {NOTES}, c AS (SELECT note_id * 2 AS note_id, 'changed' AS title FROM notes WHERE note_id % 3 = 0) SELECT note_id, title FROM notes WHERE note_id NOT IN (SELECT note_id FROM c) UNION ALL SELECT * FROM c",
        "q_starred": f"WITH {NOTES} SELECT note_id, title FROM notes WHERE note_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "q_export_dispatch": f"""WITH {NOTES} SELECT note_id, 'markdown' AS kind, md5('# ' || {title} || chr(10) || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || content_text) AS body_md5 FROM notes
            UNION ALL SELECT note_id, 'text', md5(content_text) FROM notes""",
        "q_export_html": f"""WITH {NOTES} SELECT note_id, {_page("Summary", "'<div class=" + '"box">' + "' || " + _escaped("substr(content_text, 1, 300)") + " || '</div>'")} AS summary,
            {_page("Flashcards", "'<div class=" + '"card"><div class="q">' + "' || " + _escaped("title") + " || '</div><div class=" + '"a">' + "' || " + _escaped("substr(content_text, 1, 200)") + " || '</div></div>'")} AS cards FROM notes""",
        "q_public_users": "SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS username, lower(c_name) || '@x.io' AS email FROM customer",
        "q_tag_append": f"WITH {NOTES} SELECT note_id, array_to_string(CASE WHEN list_contains(tags, 'fr') THEN tags ELSE list_append(tags, 'fr') END, '|') AS tags FROM notes",
        "q_content_kinds": f"""WITH {NOTES} SELECT note_id, CASE note_id % 5 WHEN 0 THEN to_json(struct_pack(text := title))::VARCHAR WHEN 1 THEN '{{"ops":[]}}' WHEN 2 THEN '[]' ELSE '{{}}' END AS content FROM notes""",
        "q_flattened": f"WITH {NOTES} SELECT note_id, {_FLAT} AS text FROM notes",
        "q_patched_text": f"WITH {NOTES} SELECT note_id, CASE note_id % 3 WHEN 0 THEN 'given' WHEN 1 THEN {_FLAT} ELSE 'old' END AS text FROM notes",
        "q_requests": f"WITH {NOTES} SELECT title, md5(content_text) AS text_md5, tags[1] AS category, array_to_string(tags, '|') AS tags FROM notes",
        "q_files_read": f"WITH {NOTES} SELECT 'note_' || note_id || '.txt' AS filename, md5(trim(content_text, ' \t\n\r')) AS text_md5 FROM notes",
        "q_search_literal": f"""WITH {SEARCHABLE} SELECT {_results("*** ")} FROM s WHERE contains(lower(title), '*** ') OR contains(lower(content_text), '*** ') ORDER BY note_id LIMIT 20""",
        "q_export_files": f"""WITH {NOTES}, f AS (SELECT note_id, {_FILE} AS name, '# ' || {title} || chr(10) || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || content_text AS body FROM notes)
            SELECT name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN '.' || note_id ELSE '' END || '.md' AS file_name, md5(body) AS body_md5 FROM f""",
        "q_llm_calls": f"""WITH {NOTES}, p AS (SELECT note_id, length('{fixed.PROMPTS["concepts"]}' || chr(10) || chr(10) || 'Notes:' || chr(10) || content_text) AS n FROM notes WHERE trim(content_text) <> ''),
            s AS (SELECT note_id, n, CASE WHEN n % 7 = 0 THEN 'failed' WHEN n % 11 = 0 THEN 'unavailable' ELSE 'answered' END AS status FROM p)
            SELECT note_id, status, CASE WHEN status = 'failed' THEN 1 WHEN status = 'unavailable' THEN 4 WHEN n % 3 = 0 THEN 3 ELSE 1 END::INT AS attempts,
              CASE WHEN status = 'answered' THEN '[' || n || ']' END AS answer,
              CASE status WHEN 'failed' THEN 'AI processing failed: 400 the prompt is no good' WHEN 'unavailable' THEN 'Service temporarily unavailable — try again in a moment' END AS error FROM s""",
        "q_export_markdown": f"WITH {NOTES} SELECT note_id, {_FILE} AS file_name, '# ' || {title} || chr(10) || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || content_text AS body FROM notes",
        "q_export_text": f"WITH {NOTES} SELECT note_id, {_FILE} AS file_name, content_text AS body FROM notes",
        "q_export_pdf_rows": f"WITH {NOTES} SELECT note_id, {title} AS title, 'Tags: ' || array_to_string(tags, ', ') AS tag_line, CASE WHEN content_text = '' THEN 'No content' ELSE content_text END AS body FROM notes",
        "q_bulk_markdown": f"WITH {NOTES} SELECT user_id, string_agg('# ' || {title} || chr(10) || chr(10) || content_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY note_id) AS body FROM notes GROUP BY user_id",
        "q_flashcards_json": f"WITH {NOTES} SELECT note_id, to_json({{'question': title, 'answer': content_text}})::VARCHAR AS card FROM notes",
        "q_flashcards": f"WITH {CARDS} SELECT * FROM cards",
        "q_upload": f"SELECT doc_id AS note_id, source AS user_id, source || '/' || doc_id AS title, substr(trim(text, ' \t\n\r'), 1, 10000) AS content, '' AS content_text FROM documents WHERE strlen(text) <= {fixed.UPLOAD_BYTES}",
        "q_file_names": "SELECT doc_id AS note_id, source || '/' || doc_id AS stem, 'txt' AS kind FROM documents",
        "q_preview": f"""WITH {NOTES}, f AS (SELECT note_id, trim(regexp_replace(content_text, '\\s+', ' ', 'g')) AS t FROM notes)
            SELECT note_id, CASE WHEN t = '' THEN 'No content' WHEN length(t) > 110 THEN trim(substr(t, 1, 110)) || '...' ELSE t END AS preview FROM f""",
        "q_tag_normalise": "SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', '-', 'g') AS tag FROM part",
        "q_validate_users": """SELECT c_custkey AS user_id, 'name too short' AS rule FROM customer WHERE c_custkey % 5 = 0
            UNION ALL SELECT c_custkey, 'email malformed' FROM customer WHERE c_custkey % 4 = 0 OR NOT regexp_matches(lower(c_name) || '@x.io', '^\\S+@\\S+\\.\\S+$')""",
        "q_taken": "SELECT c_custkey AS request_id, CASE WHEN c_custkey % 2 = 0 THEN 'Email' ELSE 'Username' END AS field FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
        "q_display_names": "SELECT c_custkey AS user_id, coalesce(nullif(c_mktsegment, ''), c_name) AS display_name, upper(substr(coalesce(nullif(c_mktsegment, ''), c_name), 1, 1)) AS avatar FROM customer",
        "q_tag_pills": f"WITH {NOTES} SELECT note_id, '#' || array_to_string(list_filter(tags, lambda t: t <> ''), '|#') AS pills FROM notes",
        "q_keyword_lines": f"WITH {SEARCHABLE} SELECT note_id, array_to_string(keywords[1:4], ' · ') AS line FROM s WHERE len(keywords) > 0",
        "q_initial_text": f"WITH {NOTES} SELECT note_id, CASE note_id % 4 WHEN 0 THEN content_text WHEN 3 THEN '' ELSE title END AS text FROM notes",
        "q_expansion_added": f"""WITH {graph} SELECT note_id, id, type FROM nodes WHERE type = 'subkeyword' AND parent IN {_list(EXPANDED[2:])}
            UNION ALL SELECT note_id, id, type FROM edges WHERE type = 'sub-edge' AND substr(source, 4) IN {_list(EXPANDED[2:])}""",
        "q_star_edges": f"""WITH {KW}, h AS (SELECT user_id, keyword, min(note_id) AS hub FROM kw GROUP BY ALL)
            SELECT kw.user_id, kw.keyword, hub, note_id FROM kw JOIN h ON h.user_id = kw.user_id AND h.keyword = kw.keyword WHERE hub <> note_id""",
        "q_version_preview": f"WITH {VERSIONS} SELECT note_id, version_number, saved_at, CASE WHEN content_text <> '' THEN substr(content_text, 1, 80) || '…' END AS preview FROM versions",
        "q_validate_links": f"""WITH {LINKS} SELECT source, target, 'user required' AS rule FROM own WHERE source % 11 = 0 UNION ALL
            SELECT source, target, 'strength above 1' FROM own WHERE source % 5 = 0 UNION ALL SELECT source, target, 'shared count below 0' FROM own WHERE source % 7 = 0""",
        "q_validate_notes": f"""WITH {NOTES} SELECT note_id, 'user required' AS rule FROM notes WHERE note_id % 11 = 0 UNION ALL
            SELECT note_id, 'title required' FROM notes WHERE note_id % 5 = 0 OR (note_id % 7 <> 0 AND trim(title) = '') UNION ALL
            SELECT note_id, 'title too long' FROM notes WHERE note_id % 5 <> 0 AND note_id % 7 = 0 AND length(title) * 10 > 200""",
        "q_bulk_markdown_all": f"""WITH {NOTES} SELECT user_id, string_agg('# ' || {title} || chr(10) || chr(10) || content_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY note_id) AS body
            FROM notes GROUP BY user_id UNION ALL SELECT 'nobody', '# Notes' || chr(10)""",
        "q_llm_offline": f"""WITH {NOTES}, n AS (SELECT * FROM notes WHERE trim(content_text, ' \t\n\r') <> ''),
            split AS (SELECT note_id, {_SPLIT.format("content_text")} AS w FROM n),
            tf AS (SELECT note_id, word, count(*) AS tf, min(pos) AS first_pos FROM (SELECT note_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split)
              WHERE length(word) > 2 AND word NOT IN {_list(fixed.KEYWORD_STOPWORDS)} GROUP BY ALL),
            sc AS (SELECT *, {_INT}, round(tf * (ln(2.0::DOUBLE) + 1) * (1 + ln(length(word)::DOUBLE)), 6) AS score FROM tf),
            k AS (SELECT note_id, word, {_RANK.format("note_id", "score", "first_pos")} AS rank FROM sc QUALIFY rank <= 6),
            a AS (SELECT note_id, rank, word, trim(coalesce(list_filter(regexp_split_to_array(content_text, '[.!?\n]+'), lambda s: contains(lower(s), word))[1], ''), ' \t\n\r') AS a FROM k JOIN n USING (note_id)),
            j AS (SELECT note_id, string_agg('{{"q": "' || word || '", "a": ' || to_json(a)::VARCHAR || '}}', ', ' ORDER BY rank) AS cards FROM a GROUP BY note_id)
            SELECT note_id, '[' || coalesce(cards, '') || ']' AS answer FROM n LEFT JOIN j USING (note_id)""",
        "q_card_deck": f"""WITH {CARDS} SELECT conv_id, turn, coalesce(lag(turn) OVER w, max(turn) OVER (PARTITION BY conv_id)) AS previous,
            coalesce(lead(turn) OVER w, min(turn) OVER (PARTITION BY conv_id)) AS next FROM cards WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
        "q_commands": """SELECT asked, id, title FROM (SELECT DISTINCT '/' || upper(substr(p_name, 1, 2)) AS asked FROM part)
            JOIN (VALUES ('todo', 'Todo List', 'checkbox task'), ('table', 'Table', 'grid'), ('graph', 'Graph Link', 'knowledge')) v(id, title, more)
            ON contains(lower(id || ' ' || title), lower(trim(substr(asked, 2)))) OR contains(more, lower(trim(substr(asked, 2))))""",
        "q_coloured_edges": f"WITH {GLOBAL} SELECT e.user_id, e.id, colour FROM gedges e LEFT JOIN (SELECT user_id, id, colour FROM gnodes WHERE type = 'note') n ON n.user_id = e.user_id AND n.id = e.source",
        "q_importance": f"WITH {graph} SELECT note_id, keyword, floor(kw_score * 100 + 0.5)::INT AS percent FROM gs",
        "q_note_counts": "SELECT source AS user_id, count(*) AS notes FROM documents GROUP BY 1",
        "q_notes_newest": f"WITH {NOTES} SELECT user_id, note_id, title, updated_at, (row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, note_id))::INT AS place FROM notes",
        "q_note_by_owner": f"WITH {NOTES} SELECT note_id, title FROM notes WHERE note_id = 7 AND user_id = 'src7'",
        "q_llm_prompt": f"WITH {NOTES} SELECT note_id, 'eli5' AS feature, '{fixed.PROMPTS['eli5']}' || chr(10) || chr(10) || 'Notes:' || chr(10) || content_text AS prompt FROM notes WHERE trim(content_text) <> ''",
        "q_llm_parse": f"WITH {CARDS} SELECT * FROM cards",
    }
