"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is trainable. Turns that no reply follows are
written as one last example without a trainable part, so that the output holds
every turn. The template is ``### role: text</turn>`` and a newline; in texts and
roles the characters that control strings are made of are escaped reversibly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Fixed escapes, the escape character's own first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example, n_turns, formatted, loss_start, loss_end.

    loss_start and loss_end are code points in ``formatted``, end exclusive; both
    are null in the last example of a conversation that doesn't end with a
    reply. Null text or role is empty; turns are ordered by turn, then role, then
    text, a null turn first, and repeated rows are repeated turns. A null
    conversation id is a conversation of its own. Other columns are ignored. A
    conversation is one training document and is held whole; the contexts of its
    examples are built one at a time.
    """
    turns = df.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    opened = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    whole = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(opened(t), escape(t["text"]), F.lit(CLOSE))).alias("shown"),
        F.transform("turns", lambda t: F.struct((t["role"] == trained_role).alias("trained"), F.length(opened(t)).alias("start"), F.length(escape(t["text"])).alias("size"))).alias("parts"),
    )
    each = whole.select("conv_id", "shown", F.size("shown").alias("n"), F.posexplode("parts").alias("at", "part"))
    each = each.filter(F.col("part.trained") | (F.col("at") == F.col("n") - 1))
    start = F.length(F.array_join(F.slice("shown", 1, F.col("at")), "")) + F.col("part.start")
    return each.select(
        "conv_id",
        (F.col("at") + 1).cast("long").alias("example"),
        (F.col("at") + 1).cast("long").alias("n_turns"),
        F.array_join(F.slice("shown", 1, F.col("at") + 1), "").alias("formatted"),
        F.when(F.col("part.trained"), start).cast("long").alias("loss_start"),
        F.when(F.col("part.trained"), start + F.col("part.size")).cast("long").alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of one example as array<struct<role, text>>."""
    lines = F.slice(F.split(formatted, CLOSE), 1, F.size(F.split(formatted, CLOSE)) - 1)

    def parts(line: Column) -> Column:
        body = F.substr(line, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, MIDDLE, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + len(MIDDLE) + 1)).alias("text"))

    return F.transform(lines, parts)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what the formatted examples say when read back."""
    loss = unescape(F.substr("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    held = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = read_turns(F.col("whole"))
    learned = F.array_join(F.transform("losses", lambda x: x["text"]), "")
    return held.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )
