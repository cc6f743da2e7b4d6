"""Chat formatting with Spark expressions only: sorted turn structs, merged same-role turns, one marked string and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a formatted conversation.

    Every mark begins with ``<``. In roles and texts ``\\`` is written ``\\b`` and ``<`` is written
    ``\\l``, so that a ``<`` in the output is always a mark, whatever the texts hold.
    """

    turn: str = "<turn>"
    role_end: str = "<text>"
    joint: str = "<and>"
    end: str = "</turn>"

    def escape(self, text: Column) -> Column:
        return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))

    def unescape(self, text: Column) -> Column:
        # In an escaped text each \ is followed by b or l, so the pairs can't overlap and their order doesn't matter.
        return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _sorted_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, chunk: int) -> DataFrame:
    """conv, turns: array of (role, text) in order. Runs of chunk turns are collected first, so a long
    conversation's rows are gathered by many tasks and its last step gets one row for each run."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    run = F.floor(F.coalesce(F.col(turn_col), F.lit(-1)) / chunk).cast("long")
    rows = turns.select(F.col(conv_col).alias("__conv"), run.alias("__run"), turn.alias("__turn"))
    runs = rows.groupBy("__conv", "__run").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    whole = runs.groupBy("__conv").agg(F.array_sort(F.collect_list(F.struct("__run", "__turns"))).alias("__runs"))
    return whole.select("__conv", F.flatten(F.transform("__runs", lambda r: r["__turns"])).alias("__turns"))


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as (role, texts): cut where the role changes, then slice."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda s: F.struct(F.get(turns, s["a"])["role"].alias("role"), F.transform(F.slice(turns, s["a"] + 1, s["b"] - s["a"]), lambda t: t["text"]).alias("texts")),
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template(), chunk: int = 256) -> DataFrame:
    """One row per conversation: its id and formatted string.

    Rows are ordered by turn, then role, then text (which settles repeated turn numbers; a null turn
    comes first). Adjacent turns of one role are one block of the output, their texts kept apart by
    the joint mark, so that parse_conversations gives back every row. Null roles and texts count as
    empty; repeated rows are turns of their own; rows without conversation id form one. Other
    columns aren't read. An empty table gives no rows.
    """
    t = template
    grouped = _sorted_turns(turns, conv_col, turn_col, role_col, text_col, chunk)
    blocks = grouped.select("__conv", _merged(F.col("__turns")).alias("__blocks"))
    text = F.transform(
        "__blocks",
        lambda b: F.concat(F.lit(t.turn), t.escape(b["role"]), F.lit(t.role_end), F.array_join(F.transform(b["texts"], t.escape), t.joint), F.lit(t.end)),
    )
    return blocks.select(F.col("__conv").alias(conv_col), F.array_join(text, "").alias("formatted"))


def parse_conversations(formatted: DataFrame, conv_col: str = "conv_id", text_col: str = "formatted", template: Template = Template()) -> DataFrame:
    """conv, turns: array of (role, text, loss), read back from formatted strings; loss marks assistant turns."""
    t = template
    blocks = F.filter(F.split(F.col(text_col), f"\\Q{t.end}\\E", -1), lambda b: b != "")
    body = F.transform(blocks, lambda b: F.substring(b, len(t.turn) + 1, 2147483647))
    parts = F.transform(body, lambda b: F.split(b, f"\\Q{t.role_end}\\E", 2))
    turns = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(F.get(p, F.lit(1)), f"\\Q{t.joint}\\E", -1),
                lambda x: F.struct(t.unescape(F.get(p, F.lit(0))).alias("role"), t.unescape(x).alias("text"), (t.unescape(F.get(p, F.lit(0))) == "assistant").alias("loss")),
            ),
        )
    )
    return formatted.select(F.col(conv_col), F.length(text_col).alias("formatted_chars"), turns.alias("turns"))
