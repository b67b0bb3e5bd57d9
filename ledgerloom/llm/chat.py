"""Relational chat formatting: turns to one training string per conversation and back.

A formatted conversation is a sequence of blocks, one per run of adjacent turns with one role::

    ### user: first text</part>second text</turn>
    ### assistant: answer</turn>

Inside texts the control strings are escaped: a backslash is doubled, and one backslash is put inside
``### ``, ``</turn>`` and ``</part>``, so none of them can occur in an escaped text. As every backslash of the
original is doubled, the way back is unambiguous. In roles the colon becomes ``<\\c>`` as well.

Defined results: turns are ordered by ``turn`` (null first), ties by role and text; repeated rows are separate
turns; a null role or text is an empty one; a null ``conv_id`` is a conversation of its own; an empty table gives
an empty result. Only the four named columns are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, PART, END = "### ", "</part>", "</turn>"
_ESCAPED = ((HEAD, "##\\# "), (END, "<\\/turn>"), (PART, "<\\/part>"))
_COLON = "<\\c>"
#: Turns of a conversation are gathered in blocks of this many turn numbers first, so that a very long
#: conversation is sorted in pieces on many tasks before its pieces meet.
TURN_BLOCK = 512


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, hidden in _ESCAPED:
        out = F.replace(out, F.lit(plain), F.lit(hidden))
    return out


def unescape(text: Column) -> Column:
    for plain, hidden in reversed(_ESCAPED):
        text = F.replace(text, F.lit(hidden), F.lit(plain))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit(_COLON))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_COLON), F.lit(":")))


def sorted_turns(rows: DataFrame, turn_block: int = TURN_BLOCK) -> DataFrame:
    """conv_id, turns: array of (role, text) in order, gathered in two levels."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    pieces = (
        rows.select("conv_id", F.floor(F.col("turn") / turn_block).alias("block"), turn.alias("turn"))
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list("turn")).alias("piece"))
    )
    return pieces.groupBy("conv_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"])).alias("turns")
    )


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), turn_block: int = TURN_BLOCK) -> DataFrame:
    """conv_id, formatted, mask.

    ``mask`` describes ``formatted`` from its start as runs in code points: per turn ``skip`` characters of
    control text, then ``take`` characters of escaped turn text, which bear loss where ``loss`` is true; the
    closing marker follows the last run.
    """
    turns = sorted_turns(rows, turn_block)

    def piece(x: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        head = F.concat(F.lit(HEAD), _escape_role(x["role"]), F.lit(": "))
        return F.struct(
            F.when(i == 0, head).when(before == x["role"], F.lit(PART)).otherwise(F.concat(F.lit(END + "\n"), head)).alias("head"),
            escape(x["text"]).alias("body"),
            x["role"].isin(*loss_roles).alias("loss"),
        )

    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END + "\n")).alias("formatted"),
        F.transform(
            "pieces",
            lambda p: F.struct(F.length(p["head"]).alias("skip"), F.length(p["body"]).alias("take"), p["loss"].alias("loss")),
        ).alias("mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text), loss_texts: array of unescaped texts under the mask."""

    def turns_of(block: Column) -> Column:
        colon = F.locate(": ", block)
        role = _unescape_role(block.substr(F.lit(len(HEAD) + 1), colon - len(HEAD) - 1))
        body = block.substr(colon + 2, F.length(block))
        return F.transform(F.split(body, PART, -1), lambda t: F.struct(role.alias("role"), t.alias("raw")))

    blocks = F.filter(F.split(F.col("formatted"), END + "\n", -1), lambda b: b != "")
    parsed = formatted.select("conv_id", "formatted", "mask", F.flatten(F.transform(blocks, turns_of)).alias("raw"))
    return parsed.select(
        "conv_id",
        "formatted",
        F.transform("raw", lambda t: F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text"))).alias("turns"),
        F.transform(
            F.filter(F.arrays_zip("raw", "mask"), lambda z: z["mask"]["loss"]),
            lambda z: unescape(z["raw"]["raw"].substr(F.lit(1), z["mask"]["take"])),
        ).alias("loss_texts"),
    )
