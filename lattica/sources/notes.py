"""Notes and their companions as DataFrames: views of the test tables, and ingest of files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lattica.functions import fixed
from lattica.functions import text as T
from lattica.session import table

#: Partitions of files that are read as one.
READ_TOGETHER = 16


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("note_id"),
        F.col("source").alias("user_id"),
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("content_text"),
        F.array("lang", "source").alias("tags"),
        F.col("lang").alias("category"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7919 % 100003 * 60).alias("updated_at"),
    )


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("ts").alias("saved_at"), F.col("props").alias("content_text"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("username"), F.concat(F.lower("c_name"), F.lit("@x.io")).alias("email"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("note_id")).distinct()


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("note_id"), F.col("source").alias("user_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("filename"), "text")


def uploaded(files: DataFrame) -> DataFrame:
    """Uploaded texts as notes. Only ``content`` is filled, ``content_text`` stays empty as in the notes themselves."""
    content = F.substring(T.trimmed(F.col("text")), 1, fixed.UPLOAD_CHARS)
    small = files.filter(F.octet_length("text") <= fixed.UPLOAD_BYTES)
    return small.select("note_id", "user_id", T.stem(F.col("filename")).alias("title"), content.alias("content"), F.lit("").alias("content_text"))


def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that comes next."""
    following = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("a", F.lead("text").over(following)).withColumn("by", F.lead("role").over(following))
    return c.filter("role = 'user' AND by = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), "a")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON request bodies, one a line, by a fixed schema."""
    schema = "title STRING, content STRING, contentText STRING, category STRING, tags ARRAY<STRING>, embedding ARRAY<DOUBLE>"
    return spark.read.schema(schema).json(path)


def docx_text(raw: bytes) -> str:
    """Runs of text in order, a line a paragraph. The document is parsed as XML, so every character reference is decoded.

    Where names or the one root that XML asks for are missing, it is parsed without prefixes and inside a root.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml")
    try:
        return _runs(io.BytesIO(xml))
    except ElementTree.ParseError:
        bare = re.sub(r"<[^>]*>", lambda m: re.sub(r"(?<=[</\s])\w+:(?=\w)", "", m[0]), re.sub(r"<\?.*?\?>", "", xml.decode()))
        return _runs(io.BytesIO(f"<body>{bare}</body>".encode()))


def _runs(xml: io.BytesIO) -> str:
    found = []
    for _, node in ElementTree.iterparse(xml):
        kind = node.tag.rpartition("}")[2]
        if kind in ("t", "tab", "br", "cr"):
            found.append((node.text or "") if kind == "t" else "\t" if kind == "tab" else "\n")
        elif kind == "p":
            found.append("\n")
            node.clear()
    return "".join(found)


def read_files(spark: SparkSession, path: str, pdf: Callable[[bytes], str] | None = None, glob: str = "*.{txt,md,pdf,docx}") -> DataFrame:
    """Files below ``path`` as filename, text. PDF needs a parser; without one PDF files are left out.

    Files over the upload limit, of other kinds, or that can't be parsed, whatever the parser raises, give no row. Each file
    is opened once; plain texts don't go to Python. Spark counts 4 MB for opening a file, so a task would read a few small ones: several such are one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.filter(F.col("length") <= fixed.UPLOAD_BYTES).select(F.regexp_extract("path", "[^/]+$", 0).alias("filename"), "content")
    parts, cores = files._jdf.queryExecution().toRdd().getNumPartitions(), spark.sparkContext.defaultParallelism
    files = files.coalesce(max(cores, parts // READ_TOGETHER)) if parts > cores else files
    files = files.withColumn("kind", T.extension(F.col("filename")))
    parsers = {"docx": docx_text} | ({"pdf": pdf} if pdf else {})

    @pandas_udf("string")
    def parse(kind: pd.Series, content: pd.Series) -> pd.Series:
        def one(k, raw):
            if raw is None:
                return None
            try:
                return parsers[k](raw)
            except Exception:  # noqa: BLE001  a damaged file is no reason to lose the others
                return None

        return pd.Series([one(k, raw) for k, raw in zip(kind, content, strict=True)], dtype=object)

    other = F.when(F.col("kind").isin(list(parsers)), F.col("content"))
    text = F.when(F.col("kind").isin("txt", "md"), F.decode("content", "UTF-8")).otherwise(parse("kind", other))
    return files.select("filename", text.alias("text")).filter("text IS NOT NULL").withColumn("text", T.trimmed(F.col("text")))


def flat_blocks(content: str | None) -> str:
    """The text of nested blocks: a block's own text, content and children that aren't empty, and the parts of a list, joined by blanks."""

    def walk(x):
        if isinstance(x, str):
            return x
        if isinstance(x, list):
            return " ".join(map(walk, x)).strip()
        if isinstance(x, dict):
            own = x.get("text")
            return " ".join(filter(None, (own if isinstance(own, str) else "", walk(x.get("content")), walk(x.get("children"))))).strip()
        return ""

    try:
        return walk(json.loads(content)) if content else ""
    except (ValueError, RecursionError):
        return ""


def normalised_content(content):
    """A JSON text of any kind as a JSON object or list: strings become {text}, other scalars {}."""
    kind = F.schema_of_variant(F.try_parse_json(content))
    text = F.to_json(F.struct(F.try_variant_get(F.try_parse_json(content), "$", "string").alias("text")))
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), content).when(kind == "STRING", text).otherwise("{}")


def initial_text(content_text, content):
    """What an editor starts with: the text unless it is blank, else a JSON string, else the text of a JSON object, else nothing."""
    parsed = F.try_parse_json(content)
    field = F.try_variant_get(parsed, "$.text", "variant")
    whole = F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string"))
    inner = F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(parsed, "$.text", "string"))
    return F.coalesce(F.when(T.trimmed(content_text) != "", content_text), whole, inner, F.lit(""))


@pandas_udf(StringType())
def flattened(content: pd.Series) -> pd.Series:
    """Recursion over nested JSON, which no built-in function does."""
    return content.map(flat_blocks)


def patched_text(given, content, old):
    """contentText of an update: as given, else flattened from block lists, else the old one."""
    blocks = F.when(F.schema_of_variant(F.try_parse_json(content)).startswith("ARRAY"), F.nullif(flattened(content), F.lit("")))
    return F.coalesce(given, blocks, old)
