"""Chat formatting from event logs, with DataFrame functions only.

A log has one row for each event of a conversation: ``message`` begins a message,
``delta`` adds to its text, ``edit`` replaces its text, and ``regenerate`` replaces
its text and takes back every message that was begun between the two, since those
answered the old one. Events are put in the order of their sequence numbers, folded
into final messages, and rendered by a template. Messages are told by ``message``
identifiers; an event without one is a message of its own.

Null texts and roles count as empty. Events of the same sequence number follow in
the order of kind, role and text. A delta to a message that was never begun begins
it. Rows that repeat are events that repeat. An empty log gives no conversations.
A conversation is one row, so that its own messages meet in one place; its events
are summed up message by message before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"

# The template. A turn is "### role:\ntext</turn>\n"; inside texts and
# roles, "###" and "</turn>" are written as escapes, and so are backslashes.
TURN, TURN_END, HEAD_END = "### ", "</turn>\n", ":\n"
ESCAPES = [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"), (HEAD_END, "\\n")]


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """The inverse: pairs of backslashes are set apart before the other escapes are read."""
    def read(part: Column) -> Column:
        for plain, written in ESCAPES[1:]:
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), read), "\\")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the messages that are left when a log has been folded.

    ``events`` has conv_id, seq, kind, message, role and text.
    """
    log = events.select("conv_id", "seq", F.coalesce("kind", F.lit(MESSAGE)).alias("kind"), F.col("message").cast("string").alias("message"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    log = log.withColumn("at", F.row_number().over(in_order))
    log = log.withColumn("message", F.coalesce(F.concat(F.lit("m"), "message"), F.concat(F.lit("e"), F.col("at").cast("string"))))

    begins = F.col("kind") != DELTA
    whole = log.groupBy("conv_id", "message").agg(
        F.min("at").alias("begun"), F.max(F.when(begins, F.col("at"))).alias("last"),
        F.max(F.when(F.col("kind") == REGENERATE, F.col("at"))).alias("again"), F.min_by("role", "at").alias("role"),
        F.array_sort(F.collect_list(F.struct("at", "text"))).alias("pieces"))
    left = F.filter("pieces", lambda piece: piece["at"] >= F.coalesce("last", F.lit(0)))
    whole = whole.withColumn("text", F.array_join(F.transform(left, lambda piece: piece["text"]), ""))
    earlier = Window.partitionBy("conv_id").orderBy("begun").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("taken_back", F.max("again").over(earlier))
    return whole.where(F.coalesce(F.col("taken_back") < F.col("begun"), F.lit(True))).select(
        "conv_id", F.col("begun").alias("at"), "role", "text")


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): each conversation in the template, and the spans of its
    characters, (start, length) from 1, that a model learns from: the texts of ``learned_role``."""
    parts = messages.select(
        "conv_id", "at", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(HEAD_END)).alias("head"),
        escape(F.col("text")).alias("body"), (F.col("role") == learned_role).alias("learned"))
    parts = parts.withColumn("turn", F.concat("head", "body", F.lit(TURN_END)))
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum(F.length("turn")).over(earlier), F.lit(0)))
    span = F.struct((F.col("before") + F.length("head") + 1).cast("int").alias("start"), F.length("body").alias("length"))
    turns = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "at", "turn", F.when(F.col("learned"), span).alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda turn: turn["span"]), lambda span: span.isNotNull())
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda turn: turn["turn"]), "").alias("formatted"),
                        spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as (role, text)."""
    pieces = F.split(formatted, "</turn>\n", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.instr(piece, HEAD_END)
        role = F.substring(piece, F.lit(len(TURN) + 1), head - len(TURN) - 1)
        text = F.substring(piece, head + len(HEAD_END), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(loss, lambda span: unescape(F.substring(formatted, span["start"], span["length"]))), "")
