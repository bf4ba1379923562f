"""Study features by a language model: prompts as a column, an injectable provider, and an offline stand-in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import fixed
from lattica.functions import text as T
from lattica.operators.search import query_keywords


def prompts(notes: DataFrame, feature: str) -> DataFrame:
    """(note_id, feature, prompt) of notes with text."""
    if feature not in fixed.PROMPTS:
        raise ValueError(f"feature is one of {', '.join(fixed.PROMPTS)}, not {feature!r}")
    asked = F.concat(F.lit(fixed.PROMPTS[feature] + "\n\nNotes:\n"), F.col("content_text"))
    return notes.filter(T.trimmed(F.coalesce("content_text", F.lit(""))) != "").select("note_id", F.lit(feature).alias("feature"), asked.alias("prompt"))


def offline(prompt: str) -> str:
    """A deterministic answer without a model: first sentences, or cards of keywords."""
    head, _, notes = prompt.partition("\n\nNotes:\n")
    if "JSON array" not in head:
        return " ".join(re.split(r"(?<=[.!?])\s+", notes.strip())[:4])
    key, value = ("term", "definition") if '{"term"' in head else ("question", "answer") if '{"question"' in head else ("q", "a")
    sentences = re.split(r"[.!?\n]+", notes)
    return json.dumps([{key: k, value: next((s.strip() for s in sentences if k in s.lower()), "")} for k in query_keywords(notes, 6)], ensure_ascii=False)


def answers(prompted: DataFrame, provider: Callable[[str], str] = offline) -> DataFrame:
    """``prompted`` with the provider's answer, on the executors.

    A plain function, whose batches are of a hundred rows: those of a pandas function have ten thousand, whole texts and answers.
    """
    return prompted.withColumn("answer", F.udf(lambda prompt: provider(prompt), "string", useArrow=False)("prompt"))
