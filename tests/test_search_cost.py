"""Relevance cuts each field into words once."""

from lattica.operators import search


def test_fields_are_cut_once(spark):
    notes = spark.createDataFrame([(1, "graph", "a graph of nodes", ["x"])], "note_id long, title string, content_text string, tags array<string>")
    found = search.relevant(notes, "graph nodes edges walks")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 6
    assert [(r.note_id, r.score) for r in found.collect()] == [(1, 1.5)]
