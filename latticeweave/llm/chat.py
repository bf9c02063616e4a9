"""Chat formatting in Spark expressions only.

A conversation becomes one string. Adjacent turns of one role form a block:
``<|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>``. Control strings inside texts and roles are escaped with a
backslash, reversibly: a backslash is doubled, and one is put behind the first character of ``<|``, ``<s>``, ``</s>``,
``[INST]`` and ``[/INST]``.

Defined cases: null texts and roles are empty; rows sort by turn, nulls first, then role and text, so ties and
repeated rows have one order; a null conversation id is a conversation of its own; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
_CONTROL = r"\\|<(?=\||s>|/s>)|\[(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    """Every backslash is doubled, and ``<`` or ``[`` that opens a control string gets a backslash behind it."""
    return F.regexp_replace(text, rf"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)([\\<\[])\\", "$1")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans). loss_spans: code-point [start, end) of each text of loss_role in formatted."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    first = lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])
    grouped = grouped.withColumn("starts", F.filter(F.sequence(F.lit(1), n), first))
    size = lambda at, i: F.coalesce(F.get("starts", i + 1), n + 1) - at
    block = lambda at, i: F.struct(escape(F.element_at("turns", at)["role"]).alias("role"), (F.element_at("turns", at)["role"] == loss_role).alias("loss"), F.transform(F.slice("turns", at, size(at, i)), lambda t: escape(t["text"])).alias("texts"))
    merged = grouped.select("conv_id", F.transform("starts", block).alias("blocks"))
    # Pieces in order, each with its loss flag: markers never carry loss.
    opening = lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(piece(opening(b), F.lit(False))),
        F.slice(F.flatten(F.transform(b["texts"], lambda t: F.array(piece(F.lit(NEXT), F.lit(False)), piece(t, b["loss"])))), F.lit(2), 2 * F.size(b["texts"]) - 1),
        F.array(piece(F.lit(END), F.lit(False))),
    )))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["text"])).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.char_length(p["text"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    out = merged.select("conv_id", pieces.alias("pieces"))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)
    body = lambda b: F.substring_index(F.substring_index(b, SEP, -1), END, 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|im_next\|>", -1), lambda t: F.struct(unescape(F.substring_index(b, SEP, 1)).alias("role"), unescape(t).alias("text")))))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
