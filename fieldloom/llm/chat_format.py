r"""Chat formatting by prefix-target expansion.

A conversation becomes a list of segments whose texts, put together, are the formatted
conversation.  Every assistant turn becomes an example of its own: all preceding segments
are its masked context and only its reply is trainable.  An example holds its segments
itself; examples are made one after another from their conversation, so a task holds one of
them at a time.  Written out they repeat their prefixes, as the method does.

Template: ``<|im_start|>role\ntext<|im_end|>\n``.  Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\|``, so no text can hold a control string; in roles a line
feed becomes ``\n`` as well.  ``unescape`` gives the text back exactly.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the template
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # doubled backslashes and then "<\\|" are hidden in marks of their own; an escaped role holds no "<|"
    hidden = F.replace(F.replace(role, F.lit("\\\\"), F.lit("<|/")), F.lit("<\\|"), F.lit("<|="))
    lines = F.replace(hidden, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(lines, F.lit("<|/"), F.lit("\\")), F.lit("<|="), F.lit("<|"))


def format_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """One row for each conversation: id and segments, array<struct<text, loss>>.

    A turn gives three segments: head, body and tail; the body of a ``target_role`` turn has
    loss.  Rows go by turn, then role, then text; a null turn comes first, repeated rows stay
    turns of their own, null roles and texts are empty, a null id is a conversation of its
    own.  Other columns are not read.  A conversation is one row, as its reader needs it
    whole; its turns are gathered and sorted there.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = turns.select(F.col(id_col).alias("id"), row.alias("row")).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    segments = F.flatten(F.transform("rows", lambda r: F.array(
        F.struct(F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(r["text"]).alias("text"), (r["role"] == target_role).alias("loss")),
        F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))))
    return whole.select(F.col("id").alias(id_col), segments.alias("segments"))


def expand_examples(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each trainable reply: id, example (from 0), context_segments, reply, segments and last.

    ``segments`` is the example itself: the first ``context_segments`` segments of the
    conversation, all masked, earlier replies too, and then the reply, which alone has loss.
    ``last`` marks the conversation's last example.
    """
    targets = F.filter(
        F.transform("segments", lambda s, i: F.struct(s["loss"].alias("loss"), i.alias("context_segments"), s["text"].alias("reply"))),
        lambda s: s["loss"])
    n = F.col("target.context_segments")
    example = F.transform(F.slice("segments", F.lit(1), n + 1), lambda s, i: F.struct(s["text"].alias("text"), (i == n).alias("loss")))
    return (
        formatted.select(F.col(id_col), "segments", F.size(targets).alias("_n"), F.posexplode(targets).alias("example", "target"))
        .select(id_col, "example", "target.context_segments", "target.reply", example.alias("segments"),
                (F.col("example") == F.col("_n") - 1).alias("last"))
    )


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, as it stands in the segments."""
    return formatted_text(F.filter(segments, lambda s: s["loss"]))


def context_text(examples: DataFrame, formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The examples with their context as one text, for the conversations of ``formatted``.  The
    output repeats each prefix, so it is as large as the sum of all prefixes."""
    known = formatted.select(F.col(id_col).alias("_of"))
    prefix = formatted_text(F.filter("segments", lambda s: ~s["loss"]))
    return examples.join(known, F.col(id_col).eqNullSafe(F.col("_of")), "left_semi").select("*", prefix.alias("context"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, found by its control strings."""
    parts = F.split(text, r"<\|im_end\|>\n")

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(START) + 1), F.length(p))
        head = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(head).alias("role"), unescape(F.substring(body, F.length(head) + 2, F.length(body))).alias("text"))

    return F.transform(F.filter(parts, lambda p: p != ""), turn)
