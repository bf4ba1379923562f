"""A stored notebook: changes, retries after a failure, owners, and buckets that stay closed."""

import os

import pytest
from pyspark.sql import functions as F

from lattica.operators import keywords, links
from lattica.streaming import linking, notebook

KIND = "note_id long, user_id string, title string, content_text string, at long"


def given(spark, rows):
    return spark.createDataFrame(rows, KIND).select("note_id", "user_id", "title", "content_text", F.timestamp_seconds("at").alias("updated_at"))


def held(spark, path):
    return {r.note_id: (r.user_id, r.title, r.content_text) for r in notebook.notes(spark, path).collect()}


def test_changes_and_retries(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "book")
    rows = [(n, f"u{n % 2}", f"title {n}", f"alpha{n % 5} beta{n % 3} gamma delta{n % 7}", n) for n in range(30)]
    notebook.build(given(spark, rows), path, 8)
    new = given(spark, [(50, "u0", None, "alpha1 gamma", 90), (51, "u0", "", None, 90), (3, "u1", "not this", "x", 90)])
    for _ in range(2):  # once more changes nothing
        notebook.create(new, path, 8)
        assert len(held(spark, path)) == 32
    assert held(spark, path)[50] == ("u0", "Untitled Note", "alpha1 gamma") and held(spark, path)[51][2] == "" and held(spark, path)[3][1] == "title 3"
    assert not [r for r in notebook.final_links(spark, path).collect() if 50 in (r.note_id, r.other)]
    patches = given(spark, [(50, "u0", None, "alpha1 gamma beta0", 95), (4, "u1", "stolen", "stolen", 95), (6, "u0", "new title", None, 95)])
    real = linking.apply
    monkeypatch.setattr(linking, "apply", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        notebook.patch(patches, path, 8)
    monkeypatch.setattr(linking, "apply", real)
    notebook.patch(patches, path, 8)
    assert held(spark, path)[50][1:] == ("Untitled Note", "alpha1 gamma beta0") and held(spark, path)[4][1] == "title 4"
    assert held(spark, path)[6][1:] == ("new title", rows[6][3])
    gone = spark.createDataFrame([(8, "u0"), (9, "u0"), (10, "u0")], "note_id long, user_id string")
    monkeypatch.setattr(linking, "apply", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        notebook.delete(gone, path, 8)
    monkeypatch.setattr(linking, "apply", real)
    notebook.delete(gone, path, 8)
    assert {8, 10} & set(held(spark, path)) == set() and 9 in held(spark, path)  # 9 is another's
    linked = notebook.notes(spark, path).filter("note_id <> 51")
    want = links.final_links(links.own_links(keywords.keywords(linked, keep=("updated_at",))))
    assert sorted(map(str, notebook.final_links(spark, path).collect())) == sorted(map(str, want.collect()))


def test_a_change_opens_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "book")
    notebook.build(given(spark, [(n, "u", f"title{n}", f"word{n}", n) for n in range(60)]), path, 16)
    times = lambda: {d: max(os.path.getmtime(f"{path}/notes/{d}/{f}") for f in os.listdir(f"{path}/notes/{d}")) for d in os.listdir(f"{path}/notes") if d.startswith("bucket")}
    before = times()
    notebook.patch(given(spark, [(7, "u", "other", None, 99)]), path, 16)
    assert sum(before[d] != t for d, t in times().items()) == 1
