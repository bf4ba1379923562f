"""Calls to a language model's provider from the executors: outcome per row, retries with backoff, and answers that outlive a failure.

A provider is a function from a prompt to an answer that raises on failure. What it raises is told apart by its message:
a refused key (401) ends the asking, a rate limit (429) and an outage (503) are tried again after a wait, anything else is
the row's own failure. Answers are written round by round; who runs the same prompts again asks only what has no answer.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.tables import stored

ANSWER = "note_id long, feature string, prompt_id string, status string, attempts int, answer string, error string"
#: Statuses: answered, refused (the key is bad), not_asked (after a refusal), limited and unavailable (to the last attempt), failed.
ANSWERED, REFUSED, NOT_ASKED, LIMITED, UNAVAILABLE, FAILED = "answered", "refused", "not_asked", "limited", "unavailable", "failed"
# What a user is told, and the features whose answers are JSON.
MESSAGES = {
    REFUSED: "Invalid API key",
    NOT_ASKED: "Invalid API key",
    LIMITED: "Rate limit hit — wait a few seconds and try again",
    UNAVAILABLE: "Service temporarily unavailable — try again in a moment",
}
JSON_FEATURES = ("flashcards", "concepts", "examQs")


def outcome(error: Exception) -> str:
    """The status that an error of a provider stands for."""
    text = str(error)
    if "401" in text or "invalid_api_key" in text:
        return REFUSED
    if "429" in text or "rate_limit" in text:
        return LIMITED
    if "503" in text or "unavailable" in text:
        return UNAVAILABLE
    return FAILED


def without_fences(answer: str) -> str:
    """A JSON answer without the Markdown fences around it."""
    return re.sub(r"```\s*", "", re.sub(r"```json\s*", "", answer, flags=re.IGNORECASE)).strip()


def asked(prompted: DataFrame, provider: Callable[[str], str], attempts: int = 4, wait: float = 1.0, longest: float = 60.0) -> DataFrame:
    """``prompted`` (note_id, feature, prompt) with status, attempts, answer and error, each row asked up to ``attempts`` times.

    Waits double from ``wait`` seconds up to ``longest``. After a refused key the rest of a partition isn't asked. A null
    prompt is asked as the empty text. The provider travels to the executors, so it must be picklable.
    """

    def one(prompt: str) -> tuple[str, int, str | None, str | None]:
        for n in range(1, attempts + 1):
            try:
                return ANSWERED, n, provider(prompt), None
            except Exception as e:  # noqa: BLE001  whatever a provider raises is an outcome of its row
                status = outcome(e)
                if status not in (LIMITED, UNAVAILABLE) or n == attempts:
                    return status, n, None, MESSAGES.get(status, f"AI processing failed: {e}")
                time.sleep(min(longest, wait * 2 ** (n - 1)))
        raise ValueError("attempts must be 1 or more")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refused = False
        for pdf in batches:
            out = []
            for note, feature, prompt, ident in zip(pdf["note_id"], pdf["feature"], pdf["prompt"], pdf["prompt_id"], strict=True):
                status, n, answer, error = (NOT_ASKED, 0, None, MESSAGES[NOT_ASKED]) if refused else one(prompt or "")
                refused = refused or status == REFUSED
                answer = without_fences(answer) if answer is not None and feature in JSON_FEATURES else answer
                out.append((note, feature, ident, status, n, answer, error))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return prompted.select("note_id", "feature", "prompt", _prompt_id().alias("prompt_id")).mapInPandas(rows, ANSWER)


def _prompt_id():
    return F.sha2(F.concat_ws("\n", "feature", F.coalesce("prompt", F.lit(""))).cast("binary"), 256)


def ask_all(prompted: DataFrame, provider: Callable[[str], str], path: str, at_once: int = 1000, attempts: int = 4, wait: float = 1.0) -> DataFrame:
    """Ask ``prompted`` in rounds of about ``at_once`` prompts and keep each round's outcomes under ``path``; all outcomes come back.

    A prompt that has an answer under ``path`` isn't asked again, in this call or a later one, and prompts that are equal
    share one answer. A refused key ends the rounds. What has failed is asked again by the next call.
    """
    spark = prompted.sparkSession
    named = stored(prompted.select("note_id", "feature", "prompt", _prompt_id().alias("prompt_id")), "prompts")
    done = answers(spark, path)
    open_ = named.dropDuplicates(["prompt_id"]) if done is None else named.dropDuplicates(["prompt_id"]).join(done, "prompt_id", "left_anti")
    open_ = stored(open_, "open")
    rounds = -(-open_.count() // at_once)
    for k in range(rounds):
        part = open_.filter(F.pmod(F.xxhash64("prompt_id"), F.lit(rounds)) == k)
        outcomes = asked(part, provider, attempts, wait)
        outcomes.write.mode("append").parquet(path)
        if not spark.read.schema(ANSWER).parquet(path).filter(F.col("status") == REFUSED).isEmpty():
            break
    latest = spark.read.schema(ANSWER).parquet(path) if rounds or done is not None else spark.createDataFrame([], ANSWER)
    best = latest.groupBy("prompt_id").agg(F.max(F.struct(F.col("status") == ANSWERED, "attempts", "status", "answer", "error")).alias("o"))
    return named.join(best, "prompt_id", "left").select("note_id", "feature", F.coalesce("o.status", F.lit(NOT_ASKED)).alias("status"), F.coalesce("o.attempts", F.lit(0)).alias("attempts"), "o.answer", "o.error")


def answers(spark: SparkSession, path: str) -> DataFrame | None:
    """(prompt_id) of what has an answer under ``path``; None if nothing was ever asked."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return None
    return spark.read.schema(ANSWER).parquet(path).filter(F.col("status") == ANSWERED).select("prompt_id").distinct()


class Rehearsal:
    """A provider without a model, for rehearsals: by the prompt's length it answers, is limited at first, or fails for good."""

    def __init__(self):
        self.tries: dict[str, int] = {}

    def __call__(self, prompt: str) -> str:
        n = self.tries[prompt] = self.tries.get(prompt, 0) + 1
        if len(prompt) % 7 == 0:
            raise ValueError("400 the prompt is no good")
        if len(prompt) % 3 == 0 and n <= 2:
            raise ConnectionError("429 rate_limit")
        if len(prompt) % 11 == 0:
            raise ConnectionError("503 unavailable")
        return f"```json\n[{len(prompt)}]\n```"
