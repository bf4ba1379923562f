"""All note-analytics queries over a data directory. The SQL that each is checked against is in ``plans.oracle``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import assist, export, graph, keywords, links, postings, provider, search, store, trigrams, versions, views
from lattica.plans import oracle
from lattica.session import table
from lattica.streaming import history, linking, notebook
from lattica.tables import fresh_path, stored
from lattica.sources import note_files
from lattica.sources import notes as src

#: What the search queries ask for.
QUERY = "the and thion ouer"
LONG_QUERY = "thion ouer erha ndth thing heou onthe sting ingth tion erst thion ention"
EXPANDED = ["thion", "der", "des", "que", "tion"]
#: Buckets of the stored tables that queries make: as many as their small changes need; a large store takes more.
SOME_BUCKETS = 16
#: Patterns, and whether they are meant literally.
PATTERNS = [("th.on", False), ("*** ", True), ("[aeiou]nd (the|der)+ in", False), ("nding", True), ("(ouer|erst)x?", False)]
GONE = "note_id % 7 = 0"


def _kw(spark, d):
    return keywords.keywords(src.notes(spark, d))


def _stored_kw(spark, d):
    """Keywords that several parts of a plan use, worked out once; updated_at goes with them."""
    return stored(keywords.keywords(src.notes(spark, d), keep=("updated_at",)), "keywords")


def _own(spark, d):
    return links.own_links(_stored_kw(spark, d))


def _final(spark, d):
    return links.final_links(_own(spark, d))


def _recent(spark, d):
    top = search.recent(src.notes(spark, d))
    return search.results(search.recent(search.with_keywords(top, keywords.keywords(top))))


def _added(spark, d):
    n = src.notes(spark, d)
    kw = _stored_kw(spark, d)
    shown, asked = graph.note_graphs(n, kw, EXPANDED[:2]), kw.filter(F.col("keyword").isin(EXPANDED))
    new = graph.expansion(graph.sub_keywords(n, kw, asked.select("note_id", "keyword")))
    ids = lambda pair: pair[0].select("note_id", "id", "type").unionByName(pair[1].select("note_id", "id", "type"))
    return graph.to_add(ids(new), ids(shown))


def _initial(spark, d):
    n = src.notes(spark, d)
    turn = F.col("note_id") % 4
    contents = F.when(turn == 1, F.to_json(F.array("title"))).when(turn == 2, F.to_json(F.struct(F.col("title").alias("text")))).otherwise(F.lit('{"ops":[]}'))
    contents = F.when(turn == 1, F.regexp_replace(contents, r"^\[|\]$", "")).otherwise(contents)
    return n.select("note_id", src.initial_text(F.when(turn == 0, F.col("content_text")).otherwise(F.lit(" ")), contents).alias("text"))


def _bad_links(spark, d):
    l = _own(spark, d).select("user_id", "source", "target", "strength", F.lit(1).alias("shared_count"))
    changed = {"strength": F.when(F.col("source") % 5 == 0, F.col("strength") + 1).otherwise(F.col("strength")), "shared_count": F.when(F.col("source") % 7 == 0, -1).otherwise(1)}
    return store.link_violations(l.withColumns(changed | {"user_id": F.when(F.col("source") % 11 != 0, F.col("user_id"))}))


def _bad_notes(spark, d):
    n = src.notes(spark, d)
    title = F.when(F.col("note_id") % 5 == 0, " ").when(F.col("note_id") % 7 == 0, F.repeat("title", 10)).otherwise(F.col("title"))
    return store.note_violations(n.withColumns({"title": title, "user_id": F.when(F.col("note_id") % 11 != 0, F.col("user_id"))}))


def _all_bulk(spark, d):
    n = src.notes(spark, d)
    users = n.select("user_id").unionByName(spark.range(1).select(F.lit("nobody").alias("user_id")))
    return export.bulk_markdown(n, users)


def _relinked(spark, d):
    """Links of notes that are built without some, then told of new, changed and deleted ones."""
    n, path, turn = src.notes(spark, d), fresh_path(spark, "links"), F.col("note_id") % 10
    linking.build(n.filter(turn != 3), path, SOME_BUCKETS)
    linking.apply(_changed(n).filter(turn.isin(3, 4)), n.filter(turn == 5).select("note_id"), path, SOME_BUCKETS)
    return linking.final_links(spark, path)


def _changed(n):
    """A tenth of the notes with another text and a later date."""
    now = F.col("note_id") % 10 == 4
    return n.withColumns({
        "content_text": F.when(now, F.substring("content_text", 200, 400)).otherwise(F.col("content_text")),
        "updated_at": F.when(now, F.col("updated_at") + F.expr("INTERVAL 100 DAYS")).otherwise(F.col("updated_at")),
    })


def _written(spark, d):
    """A stored notebook after notes were created, patched by owners and others, and deleted."""
    n, path, turn = src.notes(spark, d).select("note_id", "user_id", "title", "content_text", "updated_at"), fresh_path(spark, "notebook"), F.col("note_id") % 10
    later = (F.col("updated_at") + F.expr("INTERVAL 100 DAYS")).alias("updated_at")
    notebook.build(n.filter(turn != 3), path, SOME_BUCKETS)
    notebook.create(n.filter(turn == 3).withColumn("title", F.when(F.col("note_id") % 20 == 3, "").otherwise(F.col("title"))), path, SOME_BUCKETS)
    owner = F.when(F.col("note_id") % 20 == 14, "somebody else").otherwise(F.col("user_id")).alias("user_id")
    notebook.patch(n.filter(turn == 4).select("note_id", owner, later, F.substring("content_text", 200, 400).alias("content_text")), path, SOME_BUCKETS)
    notebook.delete(n.filter(turn == 5).select("note_id", "user_id"), path, SOME_BUCKETS)
    return path


def _written_notes(spark, d):
    return notebook.notes(spark, _written(spark, d)).select("note_id", "title", F.md5(F.col("content_text").cast("binary")).alias("text_md5"), "updated_at")


def _written_links(spark, d):
    return notebook.final_links(spark, _written(spark, d))


def _indexed(spark, d, queries):
    path = fresh_path(spark, "postings")
    postings.write(src.notes(spark, d), path)
    return postings.search(spark, path, queries)


def _both_searches(spark, d):
    asked = spark.range(2).select(F.col("id").alias("query_id"), F.when(F.col("id") == 0, QUERY).otherwise(LONG_QUERY).alias("query"))
    return _indexed(spark, d, asked)


def _searched_items(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 80).alias("query"))
    return _indexed(spark, d, items)


def _called(spark, d):
    path = fresh_path(spark, "answers")
    prompted = assist.prompts(src.notes(spark, d), "concepts")
    return provider.ask_all(prompted, provider.Rehearsal(), path, at_once=100_000, wait=0.0).select("note_id", "status", "attempts", "answer", "error")


def _filed(spark, d):
    path = fresh_path(spark, "note-files")
    note_files.write_files(export.markdown(src.notes(spark, d)), path)
    return note_files.read_back(spark, path).select("file_name", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _dispatched(spark, d):
    n = src.notes(spark, d)
    kinds = ("MarkDown", "TEXT")
    rows = [export.exported(n, k).select("note_id", F.lit(k.lower()).alias("kind"), F.md5(F.col("body").cast("binary")).alias("body_md5")) for k in kinds]
    return rows[0].unionByName(rows[1])


def _pages(spark, d):
    n = src.notes(spark, d)
    cards = F.to_json(F.array(F.struct(F.col("title").alias("q"), F.substring("content_text", 1, 200).alias("a"))))
    return n.select("note_id", export.html(F.substring("content_text", 1, 300), "summarize").alias("summary"), export.html(cards, "flashcards").alias("cards"))


def _contents():
    """JSON of every kind, by note."""
    turn = F.col("note_id") % 5
    text = F.regexp_replace(F.to_json(F.array("title")), r"^\[|\]$", "")
    return F.when(turn == 0, text).when(turn == 1, '{"ops":[]}').when(turn == 2, "[]").when(turn == 3, "null").otherwise("7")


def _blocks():
    """A list of blocks, one within the other."""
    part = lambda at: F.substring("content_text", at, 50).alias("text")
    first = F.struct(F.col("title").alias("text"), F.array(F.struct(part(1)), F.struct(part(60))).alias("children"))
    return F.concat(F.lit("["), F.to_json(first), F.lit(',{"content":"end"}]'))


def _patched(spark, d):
    turn = F.col("note_id") % 3
    given, content = F.when(turn == 0, "given"), F.when(turn == 2, '{"ops":[]}').otherwise(_blocks())
    return src.notes(spark, d).select("note_id", src.patched_text(given, content, F.lit("old")).alias("text"))


def _requested(spark, d):
    """Notes sent as JSON request bodies and read again."""
    path = fresh_path(spark, "requests")
    src.notes(spark, d).select("title", F.col("content_text").alias("contentText"), "category", "tags").write.json(path)
    return src.read_requests(spark, path).select("title", F.md5(F.col("contentText").cast("binary")).alias("text_md5"), "category", F.array_join("tags", "|").alias("tags"))


def _files_read(spark, d):
    """Texts stored as files and read as uploads are."""
    path = fresh_path(spark, "text-files")
    named = src.notes(spark, d).select("note_id", F.concat(F.lit("note_"), "note_id").alias("file_name"), F.concat(F.lit(" \n"), "content_text", F.lit("\t")).alias("body"))
    note_files.write_files(named, path, "txt")
    return src.read_files(spark, path).select("filename", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _patterns(spark, d):
    """Several patterns over one index; the last requires no trigram."""
    n, path = stored(_searchable(spark, d), "searchable"), fresh_path(spark, "trigrams")
    trigrams.write(n, path)
    found = [trigrams.matching(spark, path, n, p, literal).select(F.lit(i).alias("pattern"), "note_id", "title") for i, (p, literal) in enumerate(PATTERNS)]
    return reduce(DataFrame.unionByName, found)


def _searchable(spark, d):
    n = src.notes(spark, d)
    return search.with_keywords(n, keywords.keywords(n))


def _note_graph(spark, d, k):
    n = src.notes(spark, d)
    kw = _stored_kw(spark, d)
    return graph.note_graphs(n, kw, EXPANDED)[k]


def _expand(spark, d):
    n = src.notes(spark, d)
    return graph.sub_keywords(n, _kw(spark, d), EXPANDED)


def _global(spark, d):
    n = src.notes(spark, d)
    kw = _stored_kw(spark, d)
    return graph.global_nodes(n, kw), graph.global_edges(kw)


def _patch(spark, d):
    n = src.notes(spark, d).filter("note_id % 3 = 0")
    return n.select("note_id", "user_id", F.when(F.col("note_id") % 2 == 0, F.concat(F.lit("new "), "title")).alias("title"))


def _updated(spark, d):
    n = src.notes(spark, d)
    return store.updated(n, _patch(spark, d)).select("note_id", "title", F.length("content_text").cast("long").alias("n_chars"))


def _upserted(spark, d):
    n = src.notes(spark, d).select("note_id", "title")
    changed = n.filter("note_id % 3 = 0").select((F.col("note_id") * 2).alias("note_id"), F.lit("changed").alias("title"))
    return store.upserted(n, changed)


def _tokens(stopwords, n):
    def query(spark, d):
        notes = src.notes(spark, d)
        return notes.select("note_id", F.array_join(T.kept_words(F.col("content_text"), n, stopwords), " ").alias("words"))

    return query


def _taken(spark, d):
    u = src.users(spark, d)
    asked = u.select(F.col("user_id").alias("request_id"), F.when(F.col("user_id") % 2 == 0, F.upper("email")).otherwise("nobody@x.io").alias("email"), F.when(F.col("user_id") % 3 == 0, F.col("username")).otherwise("nobody").alias("username"))
    return store.taken(u, asked)


def _unlinked(spark, d):
    own = _final(spark, d).select("note_id", "other", "strength")
    return links.unlinked(own, own.filter("(note_id + other) % 5 = 0").select(F.col("note_id").alias("a"), F.col("other").alias("b")))


def _deleted(spark, d):
    gone = src.notes(spark, d).filter(GONE).select("note_id")
    return links.without_notes(_final(spark, d).select("note_id", "other", "strength"), gone)


def _orphans(spark, d):
    kept = src.notes(spark, d).filter(f"NOT ({GONE})")
    return store.orphan_versions(versions.versions(src.saves(spark, d)), kept).select("note_id", "version_number", "saved_at")


def _llm_parse(spark, d):
    cards = src.flashcards(spark, d)
    raw = F.concat(F.lit("```json\n["), F.to_json(F.struct("q", "a")), F.lit("]\n```"))
    return cards.select("conv_id", "turn", F.explode(export.parsed_cards(raw)).alias("c")).select("conv_id", "turn", "c.q", "c.a")


def _layout(spark, d):
    return graph.sub_places(_expand(spark, d))


def _spacing(spark, d):
    n = _kw(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", graph.spacing(F.col("n")).cast("double").alias("whole"), graph.spacing(F.col("n") / 100, False).cast("double").alias("single"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "q_tokenise_kw": _tokens(oracle.fixed.KEYWORD_STOPWORDS, 2),
        "q_tokenise_graph": _tokens(oracle.fixed.GRAPH_STOPWORDS, 3),
        "q_keywords": _kw,
        "q_keywords_corpus": lambda s, d: keywords.corpus_keywords(src.notes(s, d)),
        "q_color_map": lambda s, d: keywords.topic_colours(src.notes(s, d), _stored_kw(s, d)),
        "q_links_top8": lambda s, d: _own(s, d).drop("place", "at_source", "at_target"),
        "q_links_final": _final,
        "q_links_populated": lambda s, d: links.populated(_final(s, d), src.notes(s, d)),
        "q_related_overlap": lambda s, d: links.related(_stored_kw(s, d)),
        "q_unlink": _unlinked,
        "q_delete_note": _deleted,
        "q_note_graph_nodes": lambda s, d: _note_graph(s, d, 0),
        "q_note_graph_edges": lambda s, d: _note_graph(s, d, 1),
        "q_note_graph_collapsed": lambda s, d: graph.collapsed(_note_graph(s, d, 0), EXPANDED[0]),
        "q_expand": _expand,
        "q_sub_places": _layout,
        "q_spacing": _spacing,
        "q_global_nodes": lambda s, d: _global(s, d)[0],
        "q_global_edges": lambda s, d: _global(s, d)[1],
        "q_graph_stats": lambda s, d: graph.stats(*_global(s, d)),
        "q_graph_highlight": lambda s, d: graph.highlighted(*_global(s, d), "thi")[1],
        "q_search_tags": lambda s, d: search.results(search.by_tag(_searchable(s, d), "#FR")),
        "q_search_recent": _recent,
        "q_search_semantic": lambda s, d: search.semantic(_searchable(s, d), QUERY).select("note_id", "score"),
        "q_search_keyword": lambda s, d: search.relevant(src.notes(s, d), QUERY).select("note_id", "score"),
        "q_search_long": lambda s, d: search.relevant(src.notes(s, d), LONG_QUERY).select("note_id", "score"),
        "q_search_regex": lambda s, d: search.results(search.matching(_searchable(s, d), "th.on", literal=False), "thion"),
        "q_search_tagfilter": lambda s, d: search.only_tagged(search.matching(_searchable(s, d), "er"), "de,src3").select("note_id", "title"),
        "q_search_indexed": _both_searches,
        "q_search_batch": _searched_items,
        "q_notebook": _written_notes,
        "q_notebook_links": _written_links,
        "q_links_changed": _relinked,
        "q_versions_stream": lambda s, d: history.replayed(src.saves(s, d)).drop("age"),
        "q_search_patterns": _patterns,
        "q_snippet": lambda s, d: src.notes(s, d).select("note_id", T.snippet(F.col("content_text"), "Tion").alias("snippet")),
        "q_versions": lambda s, d: versions.versions(src.saves(s, d)).drop("age"),
        "q_version_list": lambda s, d: versions.listing(versions.versions(src.saves(s, d))),
        "q_version_number": lambda s, d: versions.version(versions.versions(src.saves(s, d)), "21").select("note_id", "version_number", "saved_at"),
        "q_orphan_versions": _orphans,
        "q_create": lambda s, d: store.created(src.notes(s, d).withColumn("title", F.when(F.col("note_id") % 2 == 0, F.col("title")).otherwise(""))).drop("keywords"),
        "q_update": _updated,
        "q_upsert": _upserted,
        "q_starred": lambda s, d: store.starred(src.notes(s, d), src.stars(s, d)).select("note_id", "title"),
        "q_export_markdown": lambda s, d: export.markdown(src.notes(s, d)),
        "q_export_dispatch": _dispatched,
        "q_export_html": _pages,
        "q_public_users": lambda s, d: store.public(src.users(s, d).withColumn("password", F.sha2("name", 256))),
        "q_tag_append": lambda s, d: store.with_tag(src.notes(s, d), " #FR").select("note_id", F.array_join("tags", "|").alias("tags")),
        "q_content_kinds": lambda s, d: src.notes(s, d).select("note_id", src.normalised_content(_contents()).alias("content")),
        "q_flattened": lambda s, d: src.notes(s, d).select("note_id", src.flattened(_blocks()).alias("text")),
        "q_patched_text": _patched,
        "q_requests": _requested,
        "q_files_read": _files_read,
        "q_search_literal": lambda s, d: search.results(search.matching(_searchable(s, d), "*** "), "*** "),
        "q_export_files": _filed,
        "q_llm_calls": _called,
        "q_export_text": lambda s, d: export.plain(src.notes(s, d)),
        "q_export_pdf_rows": lambda s, d: export.pdf_rows(src.notes(s, d)),
        "q_bulk_markdown": lambda s, d: export.bulk_markdown(src.notes(s, d)),
        "q_flashcards_json": lambda s, d: export.flashcards_json(src.notes(s, d)),
        "q_flashcards": src.flashcards,
        "q_upload": lambda s, d: src.uploaded(src.uploads(s, d)),
        "q_file_names": lambda s, d: src.uploads(s, d).select("note_id", T.import_stem(F.col("filename")).alias("stem"), T.extension(F.col("filename")).alias("kind")),
        "q_preview": lambda s, d: src.notes(s, d).select("note_id", T.preview(F.col("content_text")).alias("preview")),
        "q_tag_normalise": lambda s, d: table(s, d, "part").select("p_partkey", T.tag(F.concat(F.lit(" ##"), "p_name", F.lit(" "))).alias("tag")),
        "q_validate_users": lambda s, d: store.user_violations(src.users(s, d).withColumn("name", F.when(F.col("user_id") % 5 == 0, "x").otherwise(F.col("name"))).withColumn("email", F.when(F.col("user_id") % 4 == 0, "bad").otherwise(F.col("email")))),
        "q_taken": _taken,
        "q_display_names": lambda s, d: views.display_names(src.users(s, d)),
        "q_tag_pills": lambda s, d: views.pills(src.notes(s, d)),
        "q_keyword_lines": lambda s, d: views.keyword_lines(_searchable(s, d)),
        "q_initial_text": _initial,
        "q_expansion_added": _added,
        "q_star_edges": lambda s, d: graph.star_edges(_kw(s, d)),
        "q_version_preview": lambda s, d: versions.client_listing(versions.versions(src.saves(s, d))),
        "q_validate_links": _bad_links,
        "q_validate_notes": _bad_notes,
        "q_bulk_markdown_all": _all_bulk,
        "q_card_deck": lambda s, d: views.deck(views.tidy_cards(src.flashcards(s, d))),
        "q_commands": lambda s, d: views.commands_asked(table(s, d, "part").select(F.concat(F.lit("/"), F.upper(F.substring("p_name", 1, 2))).alias("asked"))),
        "q_coloured_edges": lambda s, d: views.coloured_edges(*_global(s, d)).select("user_id", "id", "colour"),
        "q_importance": lambda s, d: views.importance(graph.keyword_scores(src.notes(s, d), _stored_kw(s, d))),
        "q_note_counts": lambda s, d: views.counts(src.notes(s, d)),
        "q_notes_newest": lambda s, d: views.newest_first(src.notes(s, d)),
        "q_note_by_owner": lambda s, d: store.owned(src.notes(s, d), 7, "src7").select("note_id", "title"),
        "q_llm_prompt": lambda s, d: assist.prompts(src.notes(s, d), "eli5"),
        "q_llm_parse": _llm_parse,
        "q_llm_offline": lambda s, d: assist.answers(assist.prompts(src.notes(s, d), "flashcards")).select("note_id", "answer"),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
