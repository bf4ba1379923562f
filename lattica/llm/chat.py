r"""Operator 4, chat formatting, in DataFrame functions only.

A record is a JSON text of any known layout. The nested field paths of the record are hashed; the hash selects a
declarative mapping from that layout to canonical turns (role, text). Turns are then written as

    ### Role: text</turn>\n

A backslash escapes control strings inside roles and texts, so that no mark can occur in them: ``\`` becomes ``\\``, the
slash of ``</turn>`` gets a backslash, and so does each ``#`` after a ``#``; in roles also each colon. Reading back cuts
at the marks and drops the backslashes. The loss mask is a list of (start, length) in characters of the output.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
HEAD = "### "
#: Roles with a name of their own in the template; any other is written after an equals sign.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
#: What other layouts call the roles.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURN = "struct<role:string,text:string>"
#: Bytes from which on a record that gives no variant is read as a list of messages: a variant holds 128 MB at most.
LONG = 64 << 20

# The layouts of records that are known. Lists of messages by field names, and single prompts by role.
MESSAGE_LISTS = [("messages", "role", "content"), ("messages", "role", "text"), ("conversation", "role", "content"), ("conversations", "from", "value"), ("dialog", "speaker", "text")]
PROMPTS = [
    {"system": ("system",), "user": ("instruction", "input"), "assistant": ("output",)},
    {"system": ("system",), "user": ("instruction", "context"), "assistant": ("response",)},
    {"system": ("system",), "user": ("prompt",), "assistant": ("completion",)},
    {"system": ("system",), "user": ("prompt",), "assistant": ("response",)},
    {"system": ("system_prompt",), "user": ("question",), "assistant": ("answer",)},
    {"system": ("system_prompt",), "user": ("question",), "assistant": ("response",)},
]


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant as one text, such as ``<messages:[<content,role>>>``; scalar types are left out."""
    bare = F.schema_of_variant(record)
    for found, put in ((r"OBJECT<", "<"), (r"(?<=[:<,] ?)ARRAY<", "["), (r": ?[A-Z]+(\(\d+,\d+\))?", ""), (r": ", ":"), (r", ", ",")):
        bare = F.regexp_replace(bare, found, put)
    return bare


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths. The order of fields in the JSON text doesn't matter: variants sort them."""
    return F.xxhash64(field_paths(record))


def _layouts() -> list[tuple[tuple, list[str]]]:
    """Each mapping with the field paths that select it, one for each choice of its optional fields."""
    # The same list field serves several mappings; an empty list has no turns under any of them.
    found = [(("list", field, role, text), [f"<{field}:[<{','.join(sorted((role, text)))}>>>", f"<{field}:[VOID>>"]) for field, role, text in MESSAGE_LISTS]
    for mapping in PROMPTS:
        system, (user, *more), (answer,) = mapping["system"], mapping["user"], mapping["assistant"]
        optional = [*system, *more]
        chosen = [c for n in range(len(optional) + 1) for c in combinations(optional, n)]
        found.append((("prompt", mapping), [f"<{','.join(sorted((user, answer, *c)))}>" for c in chosen]))
    return found


def _turns_of(record: Column, layout: tuple) -> Column:
    def get(path: str) -> Column:
        return F.try_variant_get(record, path, "string")

    if layout[0] == "list":
        _, field, role, text = layout
        rows = F.try_variant_get(record, f"$.{field}", f"array<struct<{f'`{role}`:string,`{text}`:string'}>>")
        return F.transform(rows, lambda m: F.struct(m[role].alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    turns = []
    for role, fields in layout[1].items():
        texts = F.filter(F.array(*(get(f"$.{x}") for x in fields)), lambda x: x.isNotNull() & (x != ""))
        keep = F.size(texts) > 0 if role == "system" else F.lit(True)
        turns.append(F.when(keep, F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text"))))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def _long_turns(record: Column) -> Column:
    """The turns of a record too long for a variant (128 MB), if it is a list of messages; other layouts give null."""

    def read(field: str, role: str, text: str) -> Column:
        rows = F.from_json(record, f"`{field}` array<struct<`{role}`:string,`{text}`:string>>", {"maxStringLen": str((1 << 31) - 1)})[field]
        turns = F.transform(rows, lambda m: F.struct(m[role].alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
        return F.when(F.exists(rows, lambda m: m[text].isNotNull()), turns)

    return F.coalesce(*(read(*layout) for layout in MESSAGE_LISTS))


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with chat_turns, the turns (role, text) of a JSON text.

    Null if it isn't JSON or its layout is unknown. Null texts become empty. Records over LONG bytes that no variant can
    hold are read by the known lists of messages; single prompts of that size are null.
    """
    nth = {path: i for i, (_, paths) in reversed(list(enumerate(_layouts()))) for path in paths}
    known = F.create_map(*(x for path, i in nth.items() for x in (F.xxhash64(F.lit(path)), F.lit(i))))
    seen = records.withColumn("chat_variant", F.try_parse_json(F.col(column)))
    seen = seen.withColumn("chat_layout", F.try_element_at(known, fingerprint(F.col("chat_variant"))))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for i, (layout, _) in enumerate(_layouts()):
        turns = F.when(F.col("chat_layout") == i, _turns_of(F.col("chat_variant"), layout)).otherwise(turns)
    too_long = F.col("chat_variant").isNull() & (F.octet_length(column) > LONG)
    turns = F.when(too_long, _long_turns(F.col(column))).otherwise(turns)
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    named = F.transform("chat_turns", lambda t: F.struct(F.coalesce(F.try_element_at(alias, t["role"]), t["role"], F.lit("")).alias("role"), t["text"].alias("text")))
    return seen.withColumn("chat_turns", turns).withColumn("chat_turns", named).drop("chat_variant", "chat_layout")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(text, "(?<=#)#", r"\\#")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _heading(role: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    own = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\:")))
    return F.concat(F.lit(HEAD), F.coalesce(F.try_element_at(named, role), own), F.lit(": "))


def formatted(turns: Column) -> Column:
    """struct<text, loss>: the formatted turns, and (start, length) of each assistant text in it."""
    parts = F.transform(turns, lambda t: F.struct(_heading(t["role"]).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct(
            (start + F.length(p["body"]) + F.lit(len(END))).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.struct(text.alias("text"), F.aggregate(parts, empty, step)["spans"].alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, END), lambda x: x != "")
    back = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in reversed(pair)))

    def turn(piece):
        head = F.regexp_extract(piece, r"(?s)^### ((?:[^\\:]|\\.)*+): ", 1)
        role = F.when(head.startswith("="), unescape(F.substring(head, 2, 1 << 30))).otherwise(F.try_element_at(back, head))
        body = F.substring(piece, F.length(head) + F.lit(len(HEAD) + 3), F.lit(1 << 30))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, joined with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with chat_turns (null: unknown layout), chat_text and chat_loss.

    One row in, one row out, nothing is shuffled. Single prompts of more than 128 MB, null, malformed and unknown records give null in all three columns; a
    known layout without turns gives an empty text. Other columns stay; columns of the added names are replaced.
    """
    out = canonical_turns(records.drop("chat_turns", "chat_text", "chat_loss"), column)
    out = out.withColumn("chat_made", F.when(F.col("chat_turns").isNotNull(), formatted(F.col("chat_turns"))))
    return out.withColumn("chat_text", F.col("chat_made.text")).withColumn("chat_loss", F.col("chat_made.loss")).drop("chat_made")


def records_of(rows: DataFrame) -> DataFrame:
    """conv_id, record: conversation rows gathered to records of messages, by turn, then role and text.

    A conversation is one record by definition and so is held by one task. Null texts and roles are empty texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text"))))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


#: The conversation that the query adds: control strings inside texts.
TRICKY = r"\### Assistant: </turn> ok"


def op4(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    made = format_records(records_of(rows.unionByName(added))).select("conv_id", "chat_text", "chat_loss")
    read = made.withColumn("turns", read_turns(F.col("chat_text"))).withColumn("learnt", read_loss(F.col("chat_text"), F.col("chat_loss")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("chat_text").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT conv_id, turn, role, text,
    length(text) + (length(text) - length(replace(text, '\', '')))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '##+'), lambda x: length(x) - 1)), 0) AS body,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
      ELSE 1 + length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, ':', '')))
        + (length(role) - length(replace(role, '</turn>', ''))) // 7
        + coalesce(list_sum(list_transform(regexp_extract_all(role, '##+'), lambda x: length(x) - 1)), 0) END AS head
  FROM rows_in
), gathered AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
    sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM gathered
"""
