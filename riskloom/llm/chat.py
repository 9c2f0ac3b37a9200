"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A chat log is a table of events. `fold_events` replays it: the events of a conversation stand together, sorted by
sequence, and streamed deltas, edits and regenerations fold into final messages. `render` turns the messages of a
conversation into one training text with a loss mask, `read_back` parses that text again.

Template: every message is `### role: text</turn>\\n`. Inside a role or text a backslash, `#` and the closing mark are
escaped (`\\\\`, `\\#`, `<\\/turn>`; in roles also `\\:`), so neither mark can be forged and `unescape` restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: Kinds of event that set a message's text; a `delta` adds to it, a `delete` removes the message.
OPEN, RESETS = "message", ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/:])", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, seq, kind, role, text -> conv_id, turn, part, role, text: one row for each final message.

    Within a conversation and turn, events apply in order of seq (ties: kind order message, edit, regenerate, delete,
    delta, then role and text, nulls first). `message` opens a message, and a second one in the same turn opens another
    (`part` counts them); `edit` and `regenerate` drop what the message held and start again with their own text;
    `delta` appends; `delete` removes the message. Events before the first `message` of a turn open one. A null text
    is empty, a null role is the empty role, unknown kinds count as `message`, a null conv_id is a conversation of its own.
    """
    kind = F.when(F.col("kind").isin("edit", "regenerate", "delete", "delta"), F.col("kind")).otherwise(OPEN)
    rank = F.coalesce(F.create_map(*[x for i, k in enumerate((*RESETS, "delta")) for x in (F.lit(k), F.lit(i))])[kind], F.lit(0))
    e = events.select("conv_id", "turn", "seq", kind.alias("kind"), rank.alias("_rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("seq", "_rank", "role", "text")
    turn = Window.partitionBy("conv_id", "turn").orderBy(*order)
    e = e.withColumn("_n", F.row_number().over(turn))
    e = e.withColumn("part", F.greatest(F.lit(1), F.sum((F.col("kind") == OPEN).cast("long")).over(Window.partitionBy("conv_id", "turn").orderBy("_n"))))
    message = Window.partitionBy("conv_id", "turn", "part")
    last = F.max(F.when(F.col("kind").isin(*RESETS), F.col("_n"))).over(message)
    # What a later edit or regeneration has replaced goes before anything is gathered.
    e = e.withColumn("_last", F.coalesce(last, F.lit(0))).withColumn("_role", F.first("role").over(message.orderBy("_n"))).where("_n >= _last")
    pieces = F.array_sort(F.collect_list(F.struct("_n", "text")))
    folded = e.groupBy("conv_id", "turn", "part").agg(F.first("_role").alias("role"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"), F.bool_or(F.col("kind") == "delete").alias("_gone"))
    return folded.where("not _gone").drop("_gone")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, part, role, text -> conv_id, formatted, loss_spans.

    loss_spans holds start and end (code points, end exclusive) of the escaped text of each loss_role message. One row
    holds one whole conversation, as that is what a training sample is; the spans come from a running sum by row.
    """
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    m = messages.withColumn("_head", head).withColumn("_body", escape(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("turn", "part")
    size = F.length("_head") + F.length("_body") + len(END)
    m = m.withColumn("_pos", F.row_number().over(w)).withColumn("_start", F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("_head"))
    span = F.struct(F.col("_start").alias("start"), (F.col("_start") + F.length("_body")).alias("end"))
    row = F.struct("_pos", F.concat("_head", "_body", F.lit(END)).alias("t"), F.when(F.col("role") == loss_role, span).alias("span"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return g.select("conv_id", F.array_join(F.transform("_rows", lambda x: x["t"]), "").alias("formatted"), F.array_compact(F.transform("_rows", lambda x: x["span"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans -> conv_id, turns (array of role and text), loss_text: parsed from the output alone."""
    pieces = F.split("formatted", "</turn>\\n")
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Plain rows of conv_id, turn, role, text as a log: each row opens a message; other columns are left behind."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit(OPEN).alias("kind"), "role", "text")


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans for a table of conv_id, turn, role, text; see fold_events for nulls and ties."""
    return render(fold_events(conversation_events(conversations)), loss_role)
