"""Notes to Markdown, text, HTML, JSON, and rows for a PDF renderer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T

FORMATS = ("markdown", "text", "pdf")


def markdown(notes: DataFrame) -> DataFrame:
    body = F.concat(F.lit("# "), T.default(F.col("title"), "Untitled"), F.lit("\n\nTags: "), F.array_join("tags", ", "), F.lit("\n\n"), F.coalesce("content_text", F.lit("")))
    return notes.select("note_id", T.file_name(T.default(F.col("title"), "Untitled")).alias("file_name"), body.alias("body"))


def plain(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", T.file_name(T.default(F.col("title"), "Untitled")).alias("file_name"), F.coalesce("content_text", F.lit("")).alias("body"))


def pdf_rows(notes: DataFrame) -> DataFrame:
    """What a PDF shows: title, tag line, text or a stand-in."""
    return notes.select("note_id", T.default(F.col("title"), "Untitled").alias("title"), F.concat(F.lit("Tags: "), F.array_join("tags", ", ")).alias("tag_line"), T.default(F.col("content_text"), "No content").alias("body"))


def write_pdf(notes: DataFrame, render: Callable[[str, str, str], bytes], save: Callable[[int, bytes], None]) -> None:
    """Render on the executors. ``render`` makes a file of title, tags and text; ``save`` stores it."""

    def each(rows):
        for r in rows:
            save(r["note_id"], render(r["title"], r["tag_line"], r["body"]))

    pdf_rows(notes).foreachPartition(each)


def exported(notes: DataFrame, kind: str = "markdown") -> DataFrame:
    kind = kind.lower()
    if kind not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}, not {kind!r}")
    return {"markdown": markdown, "text": plain, "pdf": pdf_rows}[kind](notes)


def bulk_markdown(notes: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(user_id, body): all notes of a user in one text; a bare heading for those of ``users`` that have none."""
    one = F.concat(F.lit("# "), T.default(F.col("title"), "Untitled"), F.lit("\n\n"), F.coalesce("content_text", F.lit("")))
    rows = notes.select("user_id", F.struct("note_id", one.alias("body")).alias("n"))
    out = rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("n"))["body"], "\n\n---\n\n").alias("body"))
    if users is None:
        return out
    return users.select("user_id").distinct().join(out, "user_id", "left").select("user_id", T.default(F.col("body"), "# Notes\n").alias("body"))


def flashcards_json(notes: DataFrame) -> DataFrame:
    card = F.to_json(F.struct(F.col("title").alias("question"), F.coalesce("content_text", F.lit("")).alias("answer")))
    return notes.select("note_id", card.alias("card"))


def parsed_cards(raw: Column) -> Column:
    """Model output as cards (q, a); anything that isn't a list of objects is an empty list."""
    kind = "array<struct<q:string,question:string,a:string,answer:string,term:string,definition:string>>"
    cards = F.coalesce(F.from_json(T.without_fences(raw), kind), F.array().cast(kind))
    return F.transform(cards, lambda c: F.struct(F.coalesce(c["q"], c["question"], c["term"], F.lit("")).alias("q"), F.coalesce(c["a"], c["answer"], c["definition"], F.lit("")).alias("a")))


def html(raw: Column, feature: str) -> Column:
    """Study material as a page; texts are escaped."""
    titles = {"summarize": "Summary", "eli5": "ELI5 Explanation", "flashcards": "Flashcards", "concepts": "Key Concepts", "examQs": "Exam Questions"}
    if feature in ("summarize", "eli5"):
        body = F.concat(F.lit('<div class="box">'), T.escaped(raw), F.lit("</div>"))
    else:
        card = lambda c: F.concat(F.lit('<div class="card"><div class="q">'), T.escaped(c["q"]), F.lit('</div><div class="a">'), T.escaped(c["a"]), F.lit("</div></div>"))
        body = F.array_join(F.transform(parsed_cards(raw), card), "\n")
    title = titles[feature]
    return F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body>\n<h1>{title}</h1>'), body, F.lit("</body></html>"))
