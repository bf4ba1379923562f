"""Worked examples: four notes of one user, and small cases of every operator."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import assist, export, graph, keywords, links, search, store, versions
from lattica.sources import notes as src

NOTES = [
    (1, "u", "Graph databases", "Graph databases store nodes and edges. A graph query walks edges between nodes."),
    (2, "u", "Graph traversal", "Breadth first traversal visits nodes level by level. Edges connect nodes in the graph."),
    (3, "u", "Café 2024 budget", "Budget 2024: café rent 1200, café coffee 300. The hell of spreadsheets!"),
    (4, "u", "", ""),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "note_id long, user_id string, title string, content_text string").withColumn("tags", F.array().cast("array<string>"))


@pytest.fixture(scope="module")
def kw(notes):
    return keywords.keywords(notes).cache()


def ranked(df, note):
    return [(r.keyword, r.score) for r in df.filter(f"note_id = {note}").orderBy("rank").collect()]


def test_keywords(kw):
    assert ranked(kw, 1) == [("graph", 17.67265), ("databases", 16.240115), ("nodes", 8.836325), ("edges", 8.836325), ("store", 4.418162), ("query", 4.418162), ("walks", 4.418162)]
    assert [k for k, _ in ranked(kw, 3)] == ["caf", "budget", "2024", "spreadsheets", "coffee", "1200", "rent", "300"]
    assert ranked(kw, 4) == []


def test_keywords_with_corpus(notes):
    assert ranked(keywords.corpus_keywords(notes), 1)[:3] == [("databases", 18.380435), ("graph", 15.769623), ("nodes", 7.884811)]


def test_links(kw):
    own = links.own_links(kw).cache()
    assert {(r.source, r.target): (r.strength, r.shared) for r in own.collect()} == {(1, 2): (0.4286, "graph|nodes|edges"), (2, 1): (0.375, "graph|nodes|edges")}
    assert {(r.note_id, r.other): r.strength for r in links.final_links(own).collect()} == {(1, 2): 0.375, (2, 1): 0.375}


def test_final_links_follow_the_sequence(spark):
    """Linking one note after another, each link written back to its target, ends as the closed form says."""
    rng = random.Random(5)
    for _ in range(3):
        words = {n: rng.sample("abcdefghij", rng.randint(1, 6)) for n in range(14)}
        rows = [("u", n, k, 1.0, i + 1) for n, ks in words.items() for i, k in enumerate(ks)]
        own = links.own_links(spark.createDataFrame(rows, "user_id string, note_id long, keyword string, score double, rank int"))
        got = {(r.note_id, r.other): r.strength for r in links.final_links(own).collect()}
        held = {n: {} for n in words}
        for s in sorted(words):
            strong = sorted(((t, round(sum(k in words[s] for k in words[t]) / len(words[s]), 4)) for t in words if t != s), key=lambda x: (-x[1], x[0]))
            held[s] = dict([x for x in strong if x[1] > 0.15][:8])
            for t, strength in held[s].items():
                held[t][s] = strength
        assert got == {(n, t): s for n, ts in held.items() for t, s in ts.items()}


def test_link_changes(spark, kw):
    final = links.final_links(links.own_links(kw)).select("note_id", "other", "strength")
    assert links.unlinked(final, spark.createDataFrame([(2, 1)], "a long, b long")).count() == 0
    assert links.without_notes(final, spark.createDataFrame([(1,)], "note_id long")).count() == 0


def test_note_graph(notes, kw):
    nodes, edges = graph.note_graphs(notes, kw, ["graph"])
    one = {r.id: r for r in nodes.filter("note_id = 1").collect()}
    assert (one["kw_graph"].score, one["kw_graph"].size) == (1.0, 68)
    assert (one["kw_databases"].score, one["kw_databases"].size) == (0.75, 62)
    assert (one["kw_store"].score, one["kw_store"].size) == (0.25, 50)
    assert nodes.filter("note_id = 4").select("label").collect()[0][0] == "Untitled"
    assert {r.id for r in nodes.filter("note_id = 3 AND id = 'kw_caf'").collect()} == {"kw_caf"}
    assert edges.filter("note_id = 1 AND source = 'root'").count() == 7
    assert graph.collapsed(nodes).filter("level = 2").count() == 0


def test_sub_keywords(spark, notes, kw):
    asked = spark.createDataFrame([(1, "graph"), (3, "budget")], "note_id long, keyword string")
    none = kw.filter("keyword = 'graph'")
    subs = graph.sub_keywords(notes, none, asked.filter("note_id = 1")).orderBy("rank").collect()
    assert [(r["sub"], r["n"]) for r in subs] == [("nodes", 2), ("edges", 2), ("databases", 1), ("store", 1), ("query", 1)]
    assert graph.sub_keywords(notes, kw, asked.filter("note_id = 3")).count() == 0


def test_global_graph(notes, kw):
    nodes, edges = graph.global_nodes(notes, kw).cache(), graph.global_edges(kw).cache()
    assert graph.stats(nodes, edges).select("notes", "keywords", "cross_links").collect()[0] == (4, 23, 3)
    assert [r.size for r in nodes.filter("type = 'note'").orderBy("id").collect()] == [70, 70, 64, 64]
    assert {r.size for r in nodes.filter("shared").collect()} == {46}
    hit, lit = graph.highlighted(nodes, edges, "GRAPH")
    assert hit.count() == 4 and lit.filter("type = 'cross-link'").count() == 1


def test_search(notes, kw):
    n = search.with_keywords(notes.withColumn("updated_at", F.timestamp_seconds("note_id")), kw)
    assert [(r.note_id, r.score) for r in search.semantic(n, "graph nodes").collect()] == [(1, 10), (2, 10)]
    assert [(r.note_id, r.score) for r in search.semantic(n, "budget").collect()] == [(3, 11)]
    assert [r.note_id for r in search.search(n).collect()] == [4, 3, 2, 1]
    assert [r.note_id for r in search.search(n, "#graph", "tags").collect()] == [1, 2]
    assert search.search(n, "", "tags").count() == 0
    assert [r.note_id for r in search.search(n, "traversal").collect()] == [2]


def test_versions(spark):
    saves = spark.createDataFrame([(n, i, f"t{i}") for n, m in ((1, 45), (2, 21), (3, 3)) for i in range(1, m + 1)], "note_id long, saved_at long, content_text string")
    found = versions.versions(saves).cache()
    numbers = lambda n: [(r.saved_at, r.version_number) for r in found.filter(f"note_id = {n}").orderBy("saved_at").collect()]
    assert numbers(1) == [(i, 21) for i in range(26, 46)]
    assert numbers(2) == [(i, i) for i in range(2, 22)]
    assert numbers(3) == [(1, 1), (2, 2), (3, 3)]
    assert [r.saved_at for r in versions.version(found, "21").orderBy("note_id").collect()] == [26, 21]
    assert versions.version(found, "x").count() == 0


def test_texts(spark):
    row = spark.range(1).select(
        T.file_name(F.lit(" my-note_9: a/b! ")).alias("file"), T.tag(F.lit("##Deep  Learning ")).alias("tag"), T.trimmed(F.lit(" ﻿ x　\n")).alias("trimmed"),
        *(T.badge(F.lit(x)).alias(str(i)) for i, x in enumerate((0.61, 0.6, 0.3, 0.29))), T.preview(F.lit("a\n b")).alias("preview"), T.import_stem(F.lit("a.b.MD")).alias("stem"),
        T.escaped(F.lit("<a&b>")).alias("escaped"),
    ).collect()[0]
    assert row.asDict() == {"file": "my-note_9_a_b", "tag": "deep-learning", "trimmed": "x", "0": "Strong", "1": "Moderate", "2": "Moderate", "3": "Weak", "preview": "a b", "stem": "a.b", "escaped": "&lt;a&amp;b&gt;"}


def test_export(notes):
    assert export.markdown(notes).filter("note_id = 4").select("body").collect()[0][0] == "# Untitled\n\nTags: \n\n"
    with pytest.raises(ValueError):
        export.exported(notes, "docx")
    page = notes.limit(1).select(export.html(F.lit('```json\n[{"q":"<b>","answer":"x"}]\n```'), "flashcards")).collect()[0][0]
    assert "&lt;b&gt;" in page and ">x<" in page
    assert notes.limit(1).select(F.size(export.parsed_cards(F.lit("nonsense")))).collect()[0][0] <= 1


def test_assist(notes):
    found = {r.note_id: r.answer for r in assist.answers(assist.prompts(notes, "flashcards")).collect()}
    assert set(found) == {1, 2, 3} and json.loads(found[1])[0]["q"] == "graph"
    with pytest.raises(ValueError):
        assist.prompts(notes, "poem")


def test_store(spark, notes):
    patch = spark.createDataFrame([(1, "u", "new"), (2, "other", "stolen"), (3, "u", None)], "note_id long, user_id string, title string")
    assert {r.note_id: r.title for r in store.updated(notes, patch).collect()} == {1: "new", 2: "Graph traversal", 3: "Café 2024 budget", 4: ""}
    assert store.owned(notes, 1, "x").count() == 0
    assert store.with_tag(notes, " #A b").select("tags").first()[0] == ["a-b"]
    users = spark.createDataFrame([(1, "a", "bob", "A@x.io", "pw")], "user_id long, name string, username string, email string, password string")
    assert {r.rule for r in store.user_violations(users).collect()} == {"name too short"}
    asked = spark.createDataFrame([(1, "a@x.io", "bob"), (2, "n@x.io", "bob"), (3, "n", "n")], "request_id long, email string, username string")
    assert {r.request_id: r.field for r in store.taken(users, asked).collect()} == {1: "Email", 2: "Username"}
    assert "password" not in store.public(users).columns


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" plain é \n")
    (tmp_path / "b.exe").write_text("no")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>one &amp; two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p>")
    (tmp_path / "e.docx").write_bytes(b"broken")
    assert {r.filename: r.text for r in src.read_files(spark, str(tmp_path)).collect()} == {"a.txt": "plain é", "d.docx": "one & two\nthree"}
    assert src.read_files(spark, str(tmp_path), pdf=lambda raw: "parsed").filter("filename = 'c.pdf'").first()["text"] == "parsed"


def test_content(spark):
    cases = ['{"ops":[{"insert":"x"}]}', '{"text":"x"}', '[{"text":"x","content":["y"],"children":[{"text":"z"}]}]', '"x"', "{}", "[]", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = rows.orderBy("i").select(src.normalised_content(F.col("c")).alias("n"), src.flattened("c").alias("f")).collect()
    assert [r.n for r in got] == [cases[0], cases[1], cases[2], '{"text":"x"}', "{}", "[]", "{}"]
    assert [r.f for r in got] == ["", "x", "x y z", "x", "", "", ""]


def test_requests_and_their_content(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"title":"a","contentText":"b","tags":["x"]}\n{"title":"c","content":"[{\\"text\\":\\"d\\"}]"}\n')
    from lattica.sources import notes as src

    rows = src.read_requests(spark, str(tmp_path / "r.json"))
    got = rows.select("title", src.patched_text(F.col("contentText"), F.col("content"), F.lit("old")).alias("t")).orderBy("title").collect()
    assert [(r.title, r.t) for r in got] == [("a", "b"), ("c", "d")]
    cases = [("t", None, "t"), (" ", '"s"', "s"), (None, '{"text":"u"}', "u"), ("", '{"text":1}', ""), (None, "[1]", ""), (None, None, ""), (None, "no json", "")]
    table = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r.got == r.want for r in table.select("want", src.initial_text(F.col("a"), F.col("b")).alias("got")).collect())


def test_violations_of_notes_and_links(spark):
    from lattica.operators import store

    notes = spark.createDataFrame([(1, None, "t"), (2, "u", " "), (3, "u", "x" * 201), (4, "u", "t")], "note_id long, user_id string, title string")
    assert sorted(tuple(r) for r in store.note_violations(notes).collect()) == [(1, "user required"), (2, "title required"), (3, "title too long")]
    links = spark.createDataFrame([("u", 1, 2, 0.5, 1), ("u", 1, None, -0.1, 0), (None, 3, 4, None, -1)], "user_id string, source long, target long, strength double, shared_count long")
    found = {(r.source, r.rule) for r in store.link_violations(links).collect()}
    assert found == {(1, "target required"), (1, "strength below 0"), (3, "user required"), (3, "strength required"), (3, "shared count below 0")}


def test_links_back_follow_the_last_change(spark):
    from lattica.operators import links

    own = spark.createDataFrame([("u", 1, 2, 0.5, "a"), ("u", 2, 1, 0.4, "a")], "user_id string, source long, target long, strength double, shared string")
    notes = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-01")], "note_id long, updated_at string")
    assert {(r.note_id, r.strength) for r in links.final_links(own).collect()} == {(1, 0.4), (2, 0.4)}
    assert {(r.note_id, r.strength) for r in links.final_links(own, notes).collect()} == {(1, 0.5), (2, 0.5)}


def test_a_source_counts_a_keyword_once(spark):
    from lattica.operators import links

    kw = spark.createDataFrame([("u", 1, "Graph", 1), ("u", 1, "graph", 2), ("u", 2, "graph", 1)], "user_id string, note_id long, keyword string, rank int")
    got = {(r.source, r.target): (r.strength, r.shared) for r in links.own_links(kw).collect()}
    assert got == {(1, 2): (0.5, "graph"), (2, 1): (2.0, "graph|graph")}
