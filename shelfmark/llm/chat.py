"""Conversations as training texts, with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block; blocks
are marked by control strings, which are escaped inside of texts so that everything can be read back.

    <|im_start|>role
    text<|im_part|>text of the same role<|im_end|>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    """No control string is left: every one begins with <|. Every & begins an escape, so none is ambiguous."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&a")), F.lit("<|"), F.lit("&b"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&b"), F.lit("<|")), F.lit("&a"), F.lit("&"))


def escaped_role(c: Column) -> Column:
    """A role is one line."""
    return F.replace(escaped(c), F.lit("\n"), F.lit("&n"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("&n"), F.lit("\n")))


def turns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order of turn, then role and text; a null role or text is empty."""
    turn = F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(F.col(f"`{conv_col}`").alias("conv_id")).agg(F.collect_list(turn).alias("turns"))
    return grouped.withColumn("turns", F.array_sort("turns"))


def blocks_of(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role merged, in linear time."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    spans = F.arrays_zip(starts.alias("first"), F.slice(F.concat(starts, F.array(n + 1)), 2, F.size(starts)).alias("next"))
    return F.transform(
        spans,
        lambda s: F.struct(
            F.get(turns, s["first"] - 1)["role"].alias("role"),
            F.transform(F.slice(turns, s["first"], s["next"] - s["first"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_blocks, segments, formatted) of rows (conv_id, turns).

    The segments (said, loss) make up the formatted text and are its loss mask: loss is true for what an assistant said
    and nothing else. There are no offsets: the mask is the list of segments itself, so everything stays linear in the text.
    Conversations that repeat stay repeated; an empty table gives an empty one.
    """
    rows = conversations.select("conv_id", blocks_of(F.col("turns")).alias("blocks"))
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b, at: F.concat(
                F.array(
                    F.struct(
                        F.concat(F.lit(START), escaped_role(b["role"]), F.lit("\n")).alias("said"), F.lit(False).alias("loss")
                    )
                ),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            F.struct(F.when(i == 0, "").otherwise(PART).alias("said"), F.lit(False).alias("loss")),
                            F.struct(escaped(t).alias("said"), (b["role"] == "assistant").alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END + "\n").alias("said"), F.lit(False).alias("loss"))),
            ),
        )
    )
    rows = rows.select("conv_id", F.size("blocks").alias("n_blocks"), pieces.alias("segments"))
    return rows.withColumn("formatted", F.array_join(F.transform("segments", lambda p: p["said"]), ""))


def read_back(texts: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) of rows (conv_id, formatted, segments): roles and texts as they were, and
    what stands under the loss mask. Rows that repeat stay repeated; an empty table gives an empty one."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.locate("\n", b) + 1, F.length(b)), r"<\|im_part\|>"),
                lambda t: F.struct(
                    unescaped_role(F.substring(b, F.lit(len(START) + 1), F.locate("\n", b) - len(START) - 1)).alias("role"),
                    unescaped(t).alias("text"),
                ),
            ),
        )
    )
    loss = F.transform(F.filter("segments", lambda p: p["loss"]), lambda p: unescaped(p["said"]))
    return texts.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def digests(texts: DataFrame) -> DataFrame:
    """What the numbered query returns, all of it read back from the formatted texts. An empty table gives an empty one."""
    back = read_back(texts)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
