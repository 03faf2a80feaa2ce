"""Chat formatting from event logs: folding events into messages, rendering them, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings that a text must not contain once rendered: fixed by the common templates.
#: <|im_start|> <|im_end|> <|endoftext|> <s> </s> [INST] [/INST] [SYS] [/SYS]
_CONTROL = r"(\|(?:im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS\])"
_ESCAPE = rf"([<\[])(\\*){_CONTROL}"
_UNESCAPE = rf"([<\[])\\(\\*){_CONTROL}"
#: Events that replace what a message held: a whole message, an edit, or a regeneration, which starts from nothing.
RESETS = ("message", "edit", "regenerate")
#: Sequence numbers of a conversation that are put together first, apart from the rest of it.
SPAN = 256
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    r"""Put a backslash after the first character of each control string. One that has backslashes there already gets
    one more, so :func:`unescape` takes back exactly what was put in, whatever the text. Other text is untouched."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def escape_role(role: Column) -> Column:
    r"""A role on one line: \ as \\ and a line break as \n, then as :func:`escape`."""
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(doubled, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    r"""(conv_id, message_id, seq, role, text) of each message, from events (conv_id, message_id, seq, kind, role, text).

    Events of a message are taken in order of seq. A message, an edit or a regeneration replaces what the message held
    by its text (a regeneration usually has none); a delta is added at the end. So the text is that of the last such
    replacement and of the deltas after it. A message stands where its first event does, and has the role that was
    named first.

    Null seq comes first and null text adds nothing; an event of unknown kind adds its text. Of events with one seq
    replacements come before deltas, then they go by text. Events without message_id are one message of their
    conversation; null conv_id is a conversation. Events that repeat are taken each time. No events, no messages.
    """
    resets = F.col("kind").isin(*RESETS)
    at = F.struct(
        "seq", F.when(resets, F.lit(0)).otherwise(F.lit(1)).alias("rank"), F.coalesce("text", F.lit("")).alias("text")
    )
    messages = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("seq"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("first"),
        F.max(F.when(resets, at)).alias("from"),
        F.sort_array(F.collect_list(at)).alias("events"),
    )
    current = F.filter("events", lambda e: F.col("from").isNull() | (e >= F.col("from")))
    # of equal last replacements only one counts
    only = F.filter(current, lambda e, i: (i == 0) | (e["rank"] == 1))
    text = F.array_join(F.transform(only, lambda e: e["text"]), "")
    return messages.select("conv_id", "message_id", "seq", F.col("first.role").alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    r"""One row per conversation: conv_id, formatted, turns.

    A turn is rendered as ``<|im_start|>role\ntext<|im_end|>\n``; turns go by (seq, role, text). ``turns`` has for
    each of them its length in code points (chars), and the part of it that the loss is taken on (loss_start,
    loss_chars): an assistant's text, nothing of other turns. Lengths add up to those of ``formatted``, so the mask is
    a run-length code that is read from left to right.

    Conversations are put together in two steps, first within spans of ``SPAN`` sequence numbers, so that of a very
    long one a few long strings meet, not all its turns. Null role and text count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = messages.select("conv_id", "seq", role.alias("role"), text.alias("text")).withColumns(
        {"head": F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), "body": escape(F.col("text"))}
    )
    loss = F.col("role") == ASSISTANT
    turn = F.struct(
        F.col("seq"),
        F.col("role"),
        F.col("text"),
        F.concat("head", "body", F.lit(f"{END}\n")).alias("rendered"),
        F.length("head").alias("loss_start"),
        F.when(loss, F.length("body")).otherwise(F.lit(0)).alias("loss_chars"),
    )
    span = F.floor(F.col("seq") / F.lit(SPAN)).alias("span")
    spans = parts.groupBy("conv_id", span).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = spans.select(
        "conv_id",
        F.struct(
            "span",
            F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
            F.transform(
                "turns",
                lambda t: F.struct(F.length(t["rendered"]).alias("chars"), t["loss_start"], t["loss_chars"]),
            ).alias("turns"),
        ).alias("part"),
    )
    whole = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss array<string>) from what :func:`render` gives.

    Turns are found by the markers alone, which no rendered text contains. ``loss`` has the text under the mask, part
    by part, unescaped; it is cut out of the formatted string by the mask's offsets.
    """
    pieces = F.split("formatted", rf"\Q{END}\E\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(START) + 1))
        line = F.instr(inner, "\n")
        return F.struct(
            unescape_role(F.substr(inner, F.lit(1), line - 1)).alias("role"),
            unescape(F.substr(inner, line + 1)).alias("text"),
        )

    masked = F.zip_with(
        F.col("pieces"), F.col("turns"), lambda p, t: F.substr(p, t["loss_start"] + 1, t["loss_chars"])
    )
    return formatted.withColumn("pieces", pieces).select(
        "conv_id",
        "formatted",
        F.transform("pieces", turn).alias("turns"),
        F.transform(F.filter(masked, lambda x: x != ""), unescape).alias("loss"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """Event logs to training strings: :func:`fold_events`, then :func:`render`."""
    return render(fold_events(events))
