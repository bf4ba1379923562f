"""Text expressions on columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a browser calls white space, beyond Java's ASCII class.
SPACE = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def trimmed_list(values: Column) -> Column:
    """Trimmed, without empties and nulls; case, order and repeats stay."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), trimmed), lambda x: x != "")


def lower_list(values: Column) -> Column:
    return F.transform(trimmed_list(values), F.lower)


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; anything else, accented letters too, separates. Ends may be empty strings."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")


def kept_words(text: Column, longer_than: int, stopwords: list[str]) -> Column:
    return F.filter(words(text), lambda w: (F.length(w) > longer_than) & ~w.isin(stopwords))


def whole_number(word: Column) -> Column:
    """The word as a number if it is written like one below a billion, else null."""
    digits = (word < ":") & word.rlike("^(0|[1-9][0-9]{0,8})$")  # what begins with a letter needs no pattern
    return F.when(digits, F.expr("try_cast(word AS BIGINT)"))


def default(text: Column, other: str) -> Column:
    """``other`` for null and empty texts."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(other))


def snippet(text: Column, query: str) -> Column:
    """From 60 characters before the first hit to 120 after its start, with dots where cut; without a hit the first 180."""
    at = F.locate(query.lower(), F.lower(text)) - 1 if query else F.lit(-1)
    start, end = F.greatest(at - 60, F.lit(0)), F.least(at + 120, F.length(text))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, 180)).otherwise(cut)


def file_name(title: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(trimmed(title), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return default(F.substring(safe, 1, 80), "note")


def stem(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"\.[^/.]+$", ""), 1, 200)


def import_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(txt|md|pdf|docx)$", "")


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def tag(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(trimmed(text), "^#+", "")), SPACE + "+", "-")


def preview(text: Column, n: int = 110) -> Column:
    flat = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))
    return F.when(flat == "", "No content").when(F.length(flat) > n, F.concat(trimmed(F.substring(flat, 1, n)), F.lit("..."))).otherwise(flat)


def badge(strength: Column) -> Column:
    return F.when(strength > 0.6, "Strong").when(strength >= 0.3, "Moderate").otherwise("Weak")


def without_fences(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(text, "(?i)```json", ""), "```", ""))


def csv_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text
