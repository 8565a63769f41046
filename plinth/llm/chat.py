"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

The log of a conversation is a sequence of events: `message` opens a message, `delta` appends streamed text to it,
`edit` replaces its text, `regenerate` drops what has been said so far and starts again (with the event's text).
Events are partitioned by conversation, sorted by sequence number and folded into final messages, which stand in the
order in which they were opened. A template then renders them: each turn is

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings of this and of the bracket family of templates (<s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>, <|)
that occur inside a role or text get one backslash after their first character, on top of any that stand there
already, so they are inert and parse_chat() gives back exactly what went in.

Cases: null text and null role are empty; a null conversation id is a conversation of its own; repeated rows and equal
turn numbers are turns of their own, ordered by (turn, role, text), null turns first; a delta, edit or regenerate whose message was never
opened opens it. Other columns are ignored. An empty log gives no rows. A conversation is one row of the
result, so its text must fit a row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
_NEWLINE = "<|nl|>"
_CONTROL = r"/?(?:s>|INST\])|<SYS>>|</SYS>>|\|"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def conversation_events(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of finished turns as a log: every row is the event that opens a message of its own."""
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", seq.alias("seq"), seq.alias("message"), F.lit("message").alias("event"), "role", "text")


def fold_messages(events: DataFrame) -> DataFrame:
    """events: conv_id, seq, message, event, role, text. One row per conversation with messages: array of (opened, role, text)."""
    by_message = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "role", "text"))).alias("log"))
    reset = F.array_max(F.transform("log", lambda x, i: F.when(x.event.isin(*RESETS), i).otherwise(0)))
    text = F.array_join(F.transform(F.filter("log", lambda x, i: i >= F.col("reset")), lambda x: F.coalesce(x.text, F.lit(""))), "")
    role = F.coalesce(F.element_at(F.filter(F.transform("log", lambda x: x.role), lambda x: x.isNotNull()), 1), F.lit(""))
    folded = by_message.withColumn("reset", reset).select("conv_id", F.struct(F.col("log")[0].seq.alias("opened"), role.alias("role"), text.alias("text")).alias("message"))
    return folded.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))


def render_chat(folded: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask: for each assistant turn (turn, start, length) in characters of that turn's string."""
    turns = folded.select("conv_id", F.transform("messages", lambda m: F.struct(m.role.alias("raw"), F.concat(F.lit(START), F.replace(escape(m.role), F.lit("\n"), F.lit(_NEWLINE)), F.lit("\n")).alias("head"), escape(m.text).alias("body"))).alias("turns"))
    mask = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("turn"), (F.length(t.head) + 1).alias("start"), F.when(t.raw == "assistant", F.length(t.body)).otherwise(-1).alias("length"))), lambda m: m.length >= 0)
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "").alias("formatted"), mask.alias("loss_mask"))


def parse_chat(rendered: DataFrame) -> DataFrame:
    """Reads turns (role, text) and the text under the loss mask back from the formatted string."""
    parts = rendered.select("*", F.expr("slice(split(formatted, '<[|]im_start[|]>'), 2, 2147483647)").alias("parts"))
    role = lambda p: unescape(F.replace(F.substring_index(p, "\n", 1), F.lit(_NEWLINE), F.lit("\n")))
    text = lambda p: unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END)))
    turns = F.transform("parts", lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.concat(F.lit(START), F.get("parts", m.turn)), m.start, m.length))), "")
    return parts.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def format_conversations(conversations: DataFrame, **columns) -> DataFrame:
    return render_chat(fold_messages(conversation_events(conversations, **columns)))


#: The conversation that the contract adds: control strings as plain text.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = parse_chat(format_conversations(rows.union(spark.createDataFrame(PROBE, rows.schema))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END)} + length(regexp_replace(role, '([<\[])(\\*)({_CONTROL})', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)({_CONTROL})', '\1\2\\\3', 'g')))::BIGINT AS formatted_chars
FROM raw GROUP BY conv_id
"""
