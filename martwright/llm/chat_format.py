"""Conversations as one training text each, with a loss mask, in Spark expressions only.

The turns of a conversation are collected as structs, sorted, and runs of one role are
merged into a block by slicing the sorted array at the places where the role changes. A
block is

    <|im_start|>ROLE<|im_sep|>TEXT<|im_sep|>TEXT<|im_end|> and a line feed,

with one TEXT for each of the merged turns, so merging loses no turn. Roles and texts are
escaped: whatever looks like the beginning of a mark, `<` and `|` with backslashes or
nothing between them, gets one backslash more. No `<|` is left in them, and taking one
backslash away again gives the original.

All steps are linear in a conversation's length: nothing grows inside a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_SEP_RE, _END_RE = r"<\|im_sep\|>", r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def blocks(conversations: DataFrame) -> DataFrame:
    """conv_id and `blocks`, an array of (role, texts): neighbouring turns of one role."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    last = F.size("turns")

    def changes(i: Column) -> Column:
        return (i == 0) | (F.element_at("turns", i + 1)["role"] != F.element_at("turns", F.greatest(i, F.lit(1)))["role"])

    starts = F.filter(F.sequence(F.lit(0), last - 1), changes)
    runs = sorted_turns.select("conv_id", "turns", starts.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(last))
    return runs.select(
        "conv_id",
        F.zip_with(
            "starts",
            ends,
            lambda s, e: F.struct(
                F.element_at("turns", s + 1)["role"].alias("role"),
                F.transform(F.slice("turns", s + 1, e - s), lambda t: t["text"]).alias("texts"),
            ),
        ).alias("blocks"),
    )


def format_conversations(conversations: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted and loss_mask.

    `loss_mask` has an entry (skip, chars, loss) for each turn: behind `skip` code points of
    marks and roles follow `chars` code points of its text as formatted, to be learned if
    `loss` is true, which it is for the role `learned`. Behind the last one only the end
    mark follows. Turns are in the order of `turn`, null first, of role and text where
    turns are equal; repeated rows are turns of their own. Null roles and texts are empty.
    Rows without a conv_id are one conversation with a null id. An empty table gives no
    rows; other columns are not read. A conversation is one value, as its training text
    is, so it has to fit into a row.
    """
    text_of = lambda b: F.array_join(F.transform(b["texts"], escape), SEP)
    head = lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), text_of(b), F.lit(END))), "")

    def masked(b: Column, at: Column) -> Column:
        first = F.char_length(head(b)) + F.when(at > 0, len(END)).otherwise(0)
        return F.transform(
            b["texts"],
            lambda t, k: F.struct(
                F.when(k == 0, first).otherwise(len(SEP)).alias("skip"),
                F.char_length(escape(t)).alias("chars"),
                (b["role"] == learned).alias("loss"),
            ),
        )

    return blocks(conversations).select(
        "conv_id", formatted.alias("formatted"), F.flatten(F.transform("blocks", masked)).alias("loss_mask")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """The turns that `format_conversations` wrote, read from its text and mask alone: its
    columns and `turns`, an array of (role, text, loss). An error if mask and text differ."""
    inner = F.split("formatted", _END_RE, -1)
    blocks = F.transform(
        F.slice(inner, 1, F.size(inner) - 1),
        lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), _SEP_RE, -1),
    )
    pieces = F.flatten(
        F.transform(
            "parts",
            lambda p: F.transform(
                F.slice(p, 2, F.size(p)), lambda t: F.struct(unescape(p[0]).alias("role"), t.alias("text"))
            ),
        )
    )
    read = formatted.select("*", blocks.alias("parts")).select("*", pieces.alias("pieces"))
    turn = lambda p, m: F.when(
        F.char_length(p["text"]) == m["chars"],
        F.struct(p["role"].alias("role"), unescape(p["text"]).alias("text"), m["loss"].alias("loss")),
    ).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")))
    return read.select(*formatted.columns, F.zip_with("pieces", "loss_mask", turn).alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and SHA-256 of what `parse` reads: conv_id, n_turns, turns_sha256 (role, line
    feed, text, line feed of each turn), loss_chars and loss_sha256 (code points and digest
    of the texts under the mask, joined without anything between), formatted_chars."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return (
        parse(formatted)
        .select("conv_id", "formatted", "turns", learned.alias("learned"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(lines, 256).alias("turns_sha256"),
            F.char_length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
