"""Files of notes, calls of a provider, docx as XML, nested blocks."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import provider
from lattica.sources import note_files
from lattica.sources import notes as src

FILE = "note_id long, file_name string, body string"


def test_files_of_notes(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, "a", "one"), (2, "a", "two ü"), (3, "b", None), (4, "a_3", "")]
    note_files.write_files(spark.createDataFrame(rows, FILE).repartition(3), path)
    assert {n: open(f"{path}/{n}").read() for n in os.listdir(path) if n.endswith(".md")} == {"a.1.md": "one", "a.2.md": "two ü", "b.md": "", "a_3.md": ""}
    assert "_parts" not in os.listdir(path) and "_SUCCESS" in os.listdir(path)
    got = note_files.read_back(spark, path)
    assert {(r.file_name, r.body) for r in got.collect()} >= {("a.2.md", "two ü")}
    note_files.write_files(spark.createDataFrame([(9, "c", "new")], FILE), path, mode="overwrite")
    assert sorted(n for n in os.listdir(path) if n.endswith(".md")) == ["c.md"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "good", "x"), (2, "no/name", "x")], FILE).repartition(2)
    with pytest.raises(Exception, match="no file name"):
        note_files.write_files(rows, path)
    assert not os.path.exists(path) or not [n for n in os.listdir(path) if n != "_parts"]
    with pytest.raises(Exception, match="needs the columns"):
        spark.dataSource.register(note_files.NoteFiles)
        rows.select("body").write.format("notefiles").option("path", path).mode("append").save()


def counting(folder, error=None):
    """A provider that notes each call in a folder, and fails as told."""
    calls = str(folder / "calls")

    def ask(prompt):
        with open(calls, "a") as f:
            f.write(prompt + "\n")
        if error and prompt != "fine":
            raise ConnectionError(error)
        return f"answer to {prompt}"

    return ask


def prompts(spark, names):
    return spark.createDataFrame([(i, "summarize", x) for i, x in enumerate(names)], "note_id long, feature string, prompt string")


def test_no_prompt_is_asked_twice_after_success(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "answers")
    first = provider.ask_all(prompts(spark, ["fine", "b", "c", "b"]), counting(tmp_path, "503"), path, at_once=2, attempts=2, wait=0.0)
    assert {(r.note_id, r.status, r.attempts) for r in first.collect()} == {(0, "answered", 1), (1, "unavailable", 2), (2, "unavailable", 2), (3, "unavailable", 2)}
    assert sorted(calls.read_text().split()) == ["b", "b", "c", "c", "fine"]
    calls.unlink()
    again = provider.ask_all(prompts(spark, ["fine", "b", "c", "b"]), counting(tmp_path), path, wait=0.0)
    assert {(r.note_id, r.status, r.answer) for r in again.collect()} == {(i, "answered", f"answer to {x}") for i, x in enumerate(["fine", "b", "c", "b"])}
    assert sorted(calls.read_text().split()) == ["b", "c"]
    calls.unlink()
    assert provider.ask_all(prompts(spark, ["fine", "c"]), counting(tmp_path, "401"), path, wait=0.0).filter("status = 'answered'").count() == 2
    assert not calls.exists()


def test_a_refused_key_ends_the_asking(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "answers")
    got = provider.ask_all(prompts(spark, "abcdefgh").coalesce(1), counting(tmp_path, "401 invalid_api_key"), path, at_once=4, wait=0.0)
    assert {r.status for r in got.collect()} == {"refused", "not_asked"} and got.count() == 8
    assert 1 <= len(calls.read_text().split()) < 8
    assert provider.ask_all(prompts(spark, []), counting(tmp_path), str(tmp_path / "none")).count() == 0


def test_outcomes():
    kinds = {"429 too many": "limited", "rate_limit": "limited", "503": "unavailable", "service unavailable": "unavailable", "401": "refused", "invalid_api_key": "refused", "other": "failed"}
    assert {k: provider.outcome(ValueError(k)) for k in kinds} == kinds
    assert provider.without_fences('```JSON\n[{"q": 1}]\n```') == '[{"q": 1}]'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_is_xml(spark, tmp_path):
    body = '<w:p><w:r><w:t xml:space="preserve">a &quot;b&quot; &apos;c&apos; &#233;&#x41; &amp;lt; </w:t></w:r><w:r><w:tab/><w:t>d</w:t></w:r></w:p><w:p><w:r><w:t>e</w:t><w:br/><w:t>f</w:t></w:r></w:p>'
    assert src.docx_text(docx(body)) == "a \"b\" 'c' éA &lt; \td\ne\nf\n"
    (tmp_path / "good.docx").write_bytes(docx(body))
    (tmp_path / "bad.docx").write_bytes(b"PK no zip")
    (tmp_path / "odd.docx").write_bytes(docx("<w:p>"))

    def parser(raw):
        raise MemoryError("whatever a parser raises")

    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    assert [r.filename for r in src.read_files(spark, str(tmp_path), parser).collect()] == ["good.docx"]


def test_nested_blocks():
    deep = "[" * 50_000
    cases = [('["a", "", "b"]', "a  b"), ('{"text": {"text": "no"}, "content": ["x", 1, null], "children": [{"text": "y"}]}', "x y"), ('" as it is "', " as it is "), ("7", ""), (None, ""), (deep, ""), (deep + "]" * 50_000, "")]
    assert [src.flat_blocks(c) for c, _ in cases] == [w for _, w in cases]


def test_expressions_stay_in_the_engine(spark):
    """Names of notes are made without Python workers."""
    rows = spark.createDataFrame([(1, "a", "x")], FILE)
    assert "Python" not in note_files.with_own_names(rows, "md").select(F.col("file_name"))._jdf.queryExecution().executedPlan().toString()


def test_files_are_opened_once_and_many_a_task(spark, tmp_path):
    path = str(tmp_path / "many")
    note_files.write_files(spark.range(600).select(F.col("id").alias("note_id"), F.concat(F.lit("n"), "id").alias("file_name"), F.lit(" x ").alias("body")), path, "txt")
    found = src.read_files(spark, path)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.filter("text = 'x'").count() == 600
