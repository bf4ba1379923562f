"""Pairs of notes that share a keyword are made last: none of them is shuffled."""

import re

import pytest

from lattica.operators import graph, links, views
from lattica.plans import registry
from lattica.tables import stored


@pytest.mark.parametrize("name", ["q_related_overlap", "q_coloured_edges", "q_graph_highlight", "q_global_edges"])
def test_pairs_do_not_travel(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    left = [(len(re.match(r"[\s:+\-]*", x)[0]), x) for x in plan.splitlines()]
    at = min((d for d, x in left if re.search(r"\bJoin\b|Join ", x) and ("part" in x)), default=None)
    assert at is not None
    above, seen = [], next(i for i, (d, x) in enumerate(left) if "Join" in x and "part" in x and d == at)
    depth = at
    for d, x in reversed(left[:seen]):
        if d < depth:
            above, depth = [*above, x], d
    assert not any("Aggregate" in x or "Join" in x for x in above)


def test_common_keywords_in_parts(spark, monkeypatch):
    kw = stored(spark.createDataFrame([("u", i, k, 1) for i in range(30) for k in ("a", "b" if i % 2 else "c")], "user_id string, note_id long, keyword string, rank int"), "kw")
    want = [sorted(x.collect()) for x in (links.related(kw), graph.global_edges(kw).select("id"))]
    monkeypatch.setattr(links, "PAIRED_TOGETHER", 4)
    assert [sorted(x.collect()) for x in (links.related(kw), graph.global_edges(kw).select("id"))] == want
    assert len(want[0]) == 30 * 29 and len(want[1]) == 60 + 30 * 29 // 2 + 2 * (15 * 14 // 2)


def test_colour_is_the_notes(spark):
    nodes = spark.createDataFrame([("u", "1", "note", "red")], "user_id string, id string, type string, colour string")
    edges = spark.createDataFrame([("u", "e", "1", "note-keyword"), ("u", "c", "kw_1_a", "cross-link")], "user_id string, id string, source string, type string")
    assert {r.id: r.colour for r in views.coloured_edges(nodes, edges).collect()} == {"e": "red", "c": None}


def _metric(df, kind, name):
    """The sum of a metric over the nodes of a kind, after ``df`` was written to nowhere."""
    df.write.format("noop").mode("overwrite").save()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    df._jdf.queryExecution().toRdd().count()
    left = [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while left:
        node = left.pop()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if kind in node.nodeName() and node.metrics().contains(name):
            total += node.metrics().apply(name).value()
        left += [node.children().apply(i) for i in range(node.children().size())]
    return total


def _common(spark, n, words):
    rows = spark.range(n).selectExpr("'u' AS user_id", "id AS note_id", f"explode(sequence(1, {words})) AS rank")
    return stored(rows.selectExpr("user_id", "note_id", "concat('k', rank) AS keyword", "rank"), "kw")


def test_related_notes_meet_once(spark, monkeypatch):
    """Six hundred notes with ten equal keywords: parts meet, not a pair for each keyword that it shares."""
    monkeypatch.setattr(links, "RELATED_TOGETHER", 100)
    assert _metric(links.related(_common(spark, 600, 10)), "Join", "numOutputRows") < 5_000


def test_parts_of_a_keyword_travel_as_lists(spark, monkeypatch):
    """Nine hundred notes of a keyword in ninety parts: what travels are lists for two parts each, not every note ninety times."""
    monkeypatch.setattr(links, "PAIRED_TOGETHER", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert 0 < _metric(graph.global_edges(_common(spark, 900, 1)), "Exchange", "shuffleRecordsWritten") < 30_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("together", [3, 8_192])
def test_related_equal_all_pairs(spark, monkeypatch, together):
    monkeypatch.setattr(links, "RELATED_TOGETHER", together)
    monkeypatch.setattr(links, "RELATED_AT_ONCE", 2)
    words = {(u, 100 * u + i): {f"w{(i * 7 + u) % 5}", f"w{i % 11}", f"only{u}{i}"} for u in range(3) for i in range(1 + 13 * u)}
    kw = spark.createDataFrame([(f"u{u}", n, w, 1) for (u, n), own in words.items() for w in own], "user_id string, note_id long, keyword string, rank int")
    want = sorted((a, b) for (u, a), x in words.items() for (v, b), y in words.items() if u == v and a != b and x & y)
    assert [tuple(r) for r in sorted(links.related(kw).collect())] == want
