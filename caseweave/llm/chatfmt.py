"""Chat formatting with a grammar round trip.

A conversation is rendered as one text by a template of control strings, parsed back by a deterministic grammar, and
compared with its source turn by turn.  The parser refuses a text with a bare control string inside.  Where it refuses
or the comparison fails, the content conflicts with the grammar; it is then escaped and the round trip is repeated until
the recovered turns are identical.

Grammar (one turn; a space stands on either side of every text, so no text can complete a control string)::

    user       [INST] text [/INST]\\n
    system     <<SYS>> text <</SYS>>\\n
    assistant  <s> text </s>\\n
    other      <role:NAME> text </role>\\n        NAME is URL-encoded, hence free of control strings

Escape: one backslash before each control string and before the backslashes that lead it.  The parser takes one away
from each such run, always, so a text that already holds an escaped control string is a conflict as well.

Null text and null role are empty.  Rows of a conversation are ordered by (turn, role, text), nulls first; repeated rows
are turns of their own.  A null conv_id is a conversation like any other.  Extra columns are ignored.  An empty table
gives no conversations.  A conversation is one text and so one row: it is the only thing gathered by key, and it is
bounded by what one training example may be (2 GB in a row), not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

# fixed values: control strings of the template
OPEN = {"user": "[INST]", "system": "<<SYS>>", "assistant": "<s>"}
CLOSE = {"user": "[/INST]", "system": "<</SYS>>", "assistant": "</s>"}
#: Every control string, as a pattern that both Spark's and DuckDB's regular expressions read.
CONTROL = r"\[/?INST\]|<</?SYS>>|</?s>|<role:[^> ]*>|</role>"
_TURN = rf"(?s)(?:\[INST\]|<<SYS>>|<s>|<role:[^> ]*>) .*? (?:\[/INST\]|<</SYS>>|</s>|</role>)\n"
#: Passes after which a conversation that still differs is an error; the escape makes the second pass identical.
PASSES = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def render(role: Column, text: Column) -> Column:
    """One turn in the template."""
    out = F.concat(F.lit("<role:"), F.url_encode(role), F.lit("> "), text, F.lit(" </role>\n"))
    for r in OPEN:
        out = F.when(role == r, F.concat(F.lit(OPEN[r] + " "), text, F.lit(f" {CLOSE[r]}\n"))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text); null if the grammar does not cover the whole text."""
    def body(x: Column) -> Column:
        head, closing = F.length(F.substring_index(x, " ", 1)), F.length(F.substring_index(x, " ", -1))
        return F.substring(x, head + 2, F.length(x) - head - closing - 2)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, " ", 1)
        role = F.url_decode(F.regexp_extract(head, "^<role:(.*)>$", 1))
        for r in OPEN:
            role = F.when(head == OPEN[r], F.lit(r)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body(x)).alias("text"))
    turns = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    bare = F.exists(turns, lambda x: F.regexp_like(body(x), F.lit(rf"(?<!\\)(?:{CONTROL})")))
    return F.when((F.array_join(turns, "") == formatted) & ~bare, F.transform(turns, turn))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, source, formatted, passes) for rows (conv_id, turn, role, text): ``source`` the turns, ``formatted`` the text
    that parses back to them, ``passes`` how often the content had to be escaped."""
    turns = rows.select("conv_id", F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    whole = lambda escapes: F.array_join(F.transform("source", lambda t: render(t["role"], _times(t["text"], escapes))), "")
    out = convs.withColumn("formatted", whole(0)).withColumn("passes", F.lit(0))
    for n in range(1, PASSES + 1):
        same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
        again = whole(n) if n < PASSES else F.raise_error(F.concat(F.lit("no round trip: conversation "), F.col("conv_id").cast("string"))).cast("string")
        out = out.withColumn("_same", same).select(
            "conv_id", "source", F.when(F.col("_same"), F.col("formatted")).otherwise(again).alias("formatted"),
            F.when(F.col("_same"), F.col("passes")).otherwise(F.lit(n)).alias("passes"))
    return out


def _times(text: Column, n: int) -> Column:
    for _ in range(n):
        text = escape(text)
    return text


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    # a conversation of the table that is numbered -1 is another than the probe
    own = F.struct(F.col("conv_id").cast("long").alias("id"), F.lit(False).alias("probe")).alias("conv_id")
    rows = table(spark, sf_dir, "conversations").select(own, "turn", "role", "text")
    probe = spark.range(2).select(
        F.struct(F.lit(-1).cast("long").alias("id"), F.lit(True).alias("probe")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    parsed = format_chats(rows.unionByName(probe)).withColumn("turns", parse(F.col("formatted")))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return parsed.select(
        F.col("conv_id.id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', true UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', true),
shaped AS (
  SELECT *, regexp_replace(text, '(\\*)({CONTROL})', '\\\1\2', 'g') AS escaped,
    CASE role WHEN 'user' THEN 16 WHEN 'system' THEN 18 WHEN 'assistant' THEN 10 ELSE length(url_encode(role)) + 18 END AS frame
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(escaped) + frame)::BIGINT AS formatted_chars
FROM shaped GROUP BY conv_id, probe
"""
