"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as one array.

    Repeated rows count once; turns with the same number are ordered by role and text. A null role or
    text is empty; rows with a null conv_id or turn belong to no conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where("conv_id is not null and turn is not null").groupBy("conv_id")
            .agg(F.array_sort(F.collect_set(turn)).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
                    .alias("turns")))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _joined(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, rendered))


def _after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def _mask(turns: Column) -> Column:
    """Flag and length in characters of every rendered turn; 1 where a model is trained on it."""
    return F.concat_ws(",", F.transform(turns, lambda t: F.concat_ws(
        ":", F.when(t["role"] == TRAINED_ROLE, "1").otherwise("0"), F.char_length(rendered(t)).cast("string"))))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each row of `pairs` (pair_id, chosen_id, rejected_id) whose conversations both exist, as
    `formatted` makes it. A conversation that many pairs use is repeated by an equi join, whose skew
    the adaptive join splits. Other columns are not read; empty tables give an empty result.
    """
    every = conversations_of(turns.select("conv_id", "turn", "role", "text"))
    side = lambda name: every.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    return formatted(pairs.select("pair_id", "chosen_id", "rejected_id")
                     .join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id"))


def formatted(both: DataFrame) -> DataFrame:
    """One row for each (pair_id, chosen_id, rejected_id, chosen, rejected), the last two arrays of turns.

    The longest common prefix of whole turns is rendered once as `prompt`; what follows in either
    conversation is its completion, with a mask that trains on the assistant's turns only. Equal
    conversations give a pair with two empty completions, conversations without a common turn an empty
    prompt. A conversation is one training example and stands in one row, so it is gathered whole.
    """
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at("chosen", i).eqNullSafe(
        F.element_at("rejected", i))), F.lit(False))
    n = F.when(differs == 0, shorter).otherwise(differs - 1).cast("int")
    cut = both.withColumn("n", n)
    chosen, rejected = _after(F.col("chosen"), F.col("n")), _after(F.col("rejected"), F.col("n"))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("prompt_turns"),
        _joined(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        _joined(chosen).alias("chosen"), _mask(chosen).alias("chosen_mask"),
        _joined(rejected).alias("rejected"), _mask(rejected).alias("rejected_mask"))


def with_other_replies(turns: DataFrame) -> DataFrame:
    """Pairs with a shared history, for `formatted`: chosen is a conversation, rejected the same one with its
    last assistant turn replaced by that of its neighbour (2k and 2k + 1 are neighbours).

    pair_id and chosen_id are the conversation, rejected_id the neighbour. Conversations without an
    assistant turn, and those whose neighbour has none or does not exist, give no pair.
    """
    every = conversations_of(turns.select("conv_id", "turn", "role", "text"))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED_ROLE)
    ends = every.withColumn("last", F.array_max(places)).where("last is not null")
    reply = F.element_at("turns", F.col("last"))["text"]
    others = ends.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("conv_id").alias("rejected_id"), reply.alias("other"))
    both = ends.join(others, "conv_id")
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.col("other")).otherwise(t["text"]).alias("text")))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), "rejected_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))
