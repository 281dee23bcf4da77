"""Chat formatting by relational means only: Spark expressions, no Python on the executors.

A conversation becomes one string of blocks

    <|im_start|>role \\n text [<|im_sep|> text ...] <|im_end|> \\n

where adjacent turns of one role share a block. Control strings inside roles and texts (the
template's own and those of other common templates) are broken by a backslash after their first
character, and backslashes are doubled, so the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that steer chat models; "<|" opens all of this template's own.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for c in reversed(CONTROLS):
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    """A role's line feeds are written \\n; its own backslashes are doubled, so an odd one opens a line feed."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_chats(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """(conv, formatted, segments): segments are the pieces of formatted with loss, whether a piece is under the loss mask.

    Rows are sorted by turn, then role, then text (nulls first), so ties have one order; repeated
    rows stay. A null text or role is an empty one. A null conversation id is a conversation of its
    own. An empty table gives an empty result; other columns are not looked at. Turns are collected
    with partial aggregation; a conversation's text is one string, so it must fit in a row.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    turns = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    same = lambda i: F.element_at("turns", i).getField("role") == F.element_at("turns", i + 1).getField("role")  # noqa: E731  i from 1
    # Each turn gives three pieces: what opens it (a header, or a separator inside a merged block), its text, what closes it.
    parts = F.transform(
        "turns",
        lambda t, i: F.array(
            F.struct(F.when((i > 0) & same(F.greatest(i, F.lit(1))), F.lit(SEP)).otherwise(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).alias("piece"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("piece"), (t["role"] == loss_role).alias("loss")),
            F.struct(F.when((i + 1 < F.size("turns")) & same(F.least(i + 1, F.size("turns") - 1)), F.lit("")).otherwise(F.lit(END + "\n")).alias("piece"), F.lit(False).alias("loss")),
        ),
    )
    out = turns.select("conv", F.flatten(parts).alias("segments"))
    joined = F.array_join(F.transform("segments", lambda s: s["piece"]), "")
    return out.select(F.col("conv").alias(conv_col), joined.alias("formatted"), F.filter("segments", lambda s: s["piece"] != "").alias("segments"))


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 1 - len(END + "\n"))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
