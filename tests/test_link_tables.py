"""What the link tables read: texts once, and cards instead of the index where a batch opens all of it."""

import pytest

from lattica.sources import notes as src
from lattica.streaming import linking


def test_texts_are_cut_once_for_cards(spark, sf):
    plan = linking._cards(src.notes(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize("buckets", [1, 64])
def test_batches_by_cards_and_by_index(spark, sf, tmp_path, monkeypatch, buckets):
    notes = src.notes(spark, sf).filter("note_id < 30").drop("tags", "category")
    path, opened, read = str(tmp_path / "links"), [], linking._read
    linking.build(notes.filter("note_id < 28"), path, buckets)
    monkeypatch.setattr(linking, "_read", lambda s, p, table, which=None: (opened.append(table), read(s, p, table, which))[1])
    linking.apply(notes.filter("note_id >= 28"), notes.filter("note_id = 5").select("note_id"), path, buckets)
    assert opened.count("index") == (1 if buckets == 1 else 2)
    want = str(tmp_path / "whole")
    linking.build(notes.filter("note_id <> 5"), want, 1)
    columns = ["source", "target", "strength", "shared", "place"]
    assert sorted(linking.own_links(spark, path).select(*columns).collect()) == sorted(linking.own_links(spark, want).select(*columns).collect())
