"""Preference formatting: one prompt for the turns that chosen and rejected conversations share, and masked completions.

DataFrame functions only. A conversation is an array of (turn, role, text) ordered by these fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import running

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
#: What stands around a turn: <|im_start|>role, a line end, the text, <|im_end|> and a line end.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table of turns (conv_id, turn, role, text).

    Rows without conv_id are left out; null role and text are empty; turns are ordered by turn, role, text, nulls first;
    repeated rows stay."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Code-point spans of the rendered turns that are trained on: the assistant's text and its end mark, as start:end, comma-joined."""
    ends = running(F.transform(turns, lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN) + 1 + len(CLOSE)), lambda a, b: a + b)
    spans = F.zip_with(turns, ends, lambda t, end: F.when(t["role"] == "assistant", F.concat_ws(":", (end - len(CLOSE) - F.length(t["text"])).cast("string"), (end - 1).cast("string"))))
    return F.array_join(F.array_compact(spans), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs with n_shared, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask instead of chosen and rejected.

    chosen and rejected are arrays of (turn, role, text). Turns are shared while role and text are equal; prompt renders
    the shared ones once, each completion the rest of its side. A null or empty side has an empty completion; equal
    sides are all prompt. Other columns are kept; those of the new names are replaced."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.isNotNull() & b.isNotNull() & F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    shared = F.coalesce(F.when(first > 0, first - 1).otherwise(F.size("chosen")), F.lit(0))
    rest = lambda side: F.coalesce(F.slice(side, F.col("n_shared") + 1, F.greatest(F.size(side), F.lit(0))), F.array().cast(TURNS))
    out = pairs.withColumn("n_shared", F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), 0).otherwise(shared).cast("int"))
    out = out.withColumn("prompt", F.coalesce(_render(F.slice("chosen", F.lit(1), F.col("n_shared"))), F.lit("")))
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_text", _render(rest(side))).withColumn(f"{side}_mask", _mask(rest(side)))
    return out.drop("chosen", "rejected")


def branched(conversations: DataFrame) -> DataFrame:
    """Preference pairs (conv_id, chosen, rejected) from plain conversations, each of which is taken to be preferred.

    Conversations 2n and 2n + 1 are partners. chosen is a whole conversation of m turns; rejected begins like it and goes on
    like the partner after conv_id modulo m + 1 turns, so that some pairs share nothing and some the whole of chosen. One
    without a partner is rejected where it would go on. Rows without conv_id are left out; null role and text are empty;
    turns are ordered by turn, role, text, nulls first. Partners meet in one group: no join, one shuffle."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    row = F.struct(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    pair = conversations.where("conv_id is not null").groupBy(F.floor(F.col("conv_id") / 2).alias("pair")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    own = lambda odd: F.transform(F.filter("rows", lambda r: r["conv_id"] == F.col("pair") * 2 + odd), lambda r: r["t"])
    both = pair.select("pair", own(0).alias("even"), own(1).alias("odd"))
    side = lambda odd, mine, other: F.struct((F.col("pair") * 2 + odd).alias("conv_id"), F.col(mine).alias("own"), F.col(other).alias("other"))
    sides = both.select(F.explode(F.array(side(0, "even", "odd"), side(1, "odd", "even"))).alias("s")).select("s.*").where(F.size("own") > 0)
    at = F.pmod("conv_id", F.size("own") + 1).cast("int")
    return sides.select("conv_id", F.col("own").alias("chosen"), F.concat(F.slice("own", F.lit(1), at), F.slice("other", at + 1, F.greatest(F.size("other"), F.lit(0)))).alias("rejected"))
