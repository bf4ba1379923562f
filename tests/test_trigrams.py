"""Pattern search by trigrams against the scan."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import keywords, search, trigrams
from lattica.sources import notes as src
from lattica.tables import stored


def test_what_patterns_require():
    cases = {
        "th.on": [], "Thion": ["hio", "ion", "thi"], "abc(def)?ghi": ["abc", "ghi"], "(abc)+x": ["abc"], "a|bcd": [], "ab(cd)e": ["abc", "bcd", "cde"], "abc{0,2}": [], "abcd{2}": ["abc"], "^ab$c": [], "[": [], r"\Qabc\E": [],
        "(?x)a b c": [], "über": ["ber"], "(?:xyz)": ["xyz"], "(?!abc)": [], "(?=abc)": [], "(?i)ABC": ["abc"], "a++bcd": ["bcd"],
    }
    assert {p: trigrams.required(p) for p in cases} == cases
    assert trigrams.required("a.(B", literal=True) == [".(b", "a.("]
    assert trigrams.required("ab", literal=True) == []


@pytest.fixture(scope="module")
def notes(spark, sf):
    given = src.notes(spark, sf)
    odd = spark.createDataFrame([(900_001, "u", None, None, [None, "ÜberTag"]), (900_002, "u", "K K", "ab\ncd İstanbul", []), (900_003, "u", "", "", None)], "note_id long, user_id string, title string, content_text string, tags array<string>")
    every = given.select("note_id", "user_id", "title", "content_text", "tags").unionByName(odd)
    return stored(search.with_keywords(every, keywords.keywords(every)), "searchable")


def test_equal_to_the_scan(spark, notes, tmp_path):
    path = str(tmp_path / "grams")
    trigrams.write(notes, path, 16)
    asked = [("thion", True), ("THION", True), ("th.on", False), ("*** ", True), ("nd (the|der) in", False), ("er", True), ("b\ncd", True), ("bertag", True), ("stanbul", True), ("k k", True), ("(ouer|erst)+", False), ("nothing like it", True), ("eren [a-z]+ t?he", False)]
    for p, literal in asked:
        got = [r.note_id for r in trigrams.matching(spark, path, notes, p, literal, 1000, 16).collect()]
        assert got == [r.note_id for r in search.matching(notes, p, literal, 1000).collect()], p
    few = trigrams.candidates(spark, path, trigrams.required("*** ", True), 16).count()
    assert 0 < few < notes.count() / 2


def test_only_asked_buckets_are_opened(spark, notes, tmp_path):
    path = str(tmp_path / "grams")
    trigrams.write(notes, path, 16)
    plan = trigrams.candidates(spark, path, ["thi", "hio"], 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "gram" in plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert trigrams.grams(notes).groupBy("gram", "note_id").count().filter(F.col("count") > 1).isEmpty()


def test_a_gram_of_a_note_is_no_row(spark, notes):
    """Lists of a batch's notes are dealt out, not each gram of each note: the rows are fewer by far."""
    assert trigrams.listed(notes.coalesce(1)).count() * 5 < trigrams.grams(notes).count()
    odd = spark.createDataFrame([(1, "AbCd", "xä\nyz", ["t", "u1"], None), (2, None, None, None, None), (3, "", "bcd", [], ["k"])], "note_id long, title string, content_text string, tags array<string>, keywords array<string>")
    assert {tuple(r) for r in trigrams.grams(odd).collect()} == {("abc", 1), ("bcd", 1), ("\nyz", 1), ("bcd", 3)}
