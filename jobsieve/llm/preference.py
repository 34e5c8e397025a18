"""Preference pairs from chosen and rejected conversations (SQL functions only).

Both sides of a pair are ordered by turn; their longest common prefix of turns (same role and text) is rendered
once as prompt, the remaining turns of each side as its completion. Rendering is
``<|role|>newline text newline`` per turn. A mask lists, for each completion, the half-open character spans that
are trained on: the texts of assistant turns; everything else, the whole prompt included, is masked out.

Defined cases: null role or text renders as empty; turns are ordered by (turn, role, text), nulls first, so
repeated or tied turns keep a defined order; a pair with one side missing has an empty prefix and an empty
completion there; two equal sides give two empty completions; a null pair id is a pair of its own; an empty table
gives no rows; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit("\n"))), "")


def _trained_spans(turns: Column) -> Column:
    """Character spans of assistant texts in the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.char_length(_head(t["role"]))
        end = begin + F.char_length(t["text"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"),
                        F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def _side(turns: DataFrame, pair: str, name: str) -> DataFrame:
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col(pair).alias("pair_id")).agg(F.sort_array(F.collect_list(row)).alias(name))  # one conversation


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``chosen`` and ``rejected`` hold one row per turn (pair id, turn, role, text)."""
    none = F.array().cast(TURN)
    a, b = _side(chosen, pair, "c"), _side(rejected, pair, "r").withColumnRenamed("pair_id", "_r")
    sides = (a.join(b, a["pair_id"].eqNullSafe(b["_r"]), "full_outer")
             .select(F.coalesce("pair_id", "_r").alias("pair_id"), F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r")))
    same = F.zip_with(
        "c", "r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    shared = F.array_position(same, F.lit(False))
    cut = sides.select("pair_id", "c", "r", F.when(shared == 0, F.least(F.size("c"), F.size("r"))).otherwise(shared - 1).cast("int").alias("k"))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("k") + 1, F.greatest(F.size(side), F.lit(1)))

    parts = cut.select("pair_id", F.col("k").alias("prompt_turns"),
                       F.when(F.col("k") > 0, F.slice(F.col("c"), F.lit(1), F.greatest(F.col("k"), F.lit(1)))).otherwise(none).alias("p"),
                       rest("c").alias("c"), rest("r").alias("r"))
    return parts.select("pair_id", "prompt_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"),
                        _render(F.col("r")).alias("rejected"), _trained_spans(F.col("c")).alias("chosen_mask"),
                        _trained_spans(F.col("r")).alias("rejected_mask"))


def reply_swaps(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: chosen is a conversation up to its last assistant turn; rejected is the same
    conversation with that reply replaced by the last reply of its neighbour (ids 2k and 2k + 1; the own reply where
    there is no neighbour). Both come back as turn rows with ``pair_id`` = conv_id; null turns come first, and the
    rows with a null conv_id are one conversation without a neighbour."""
    conv = conversations.select("conv_id", "turn", "role", "text")
    last = (conv.where("role = 'assistant'").groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("reply")).select("conv_id", F.col("reply.turn").alias("reply_turn"), F.col("reply.text").alias("reply")))
    neighbour = last.select(F.expr("conv_id ^ 1").alias("conv_id"), F.col("reply").alias("other"))
    plan = last.join(neighbour, "conv_id", "left").select("conv_id", "reply_turn", F.coalesce("other", "reply").alias("other"))
    plan = plan.withColumnRenamed("conv_id", "_c")
    turns = conv.join(plan, F.col("conv_id").eqNullSafe(F.col("_c"))).where("turn is null or turn <= reply_turn")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    swapped = F.when(F.col("turn").eqNullSafe(F.col("reply_turn")) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text"))
    return chosen, turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", swapped.alias("text"))
