"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

A conversation's turn is compared by an order-free digest of its (role, text) rows, so a turn held by many rows is summed before any
shuffle and never gathered. The longest common prefix of turns ends before the first turn at which the two digests differ; it is
emitted once as the prompt, and the rest of either side as its completion, one row a turn, with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "<|{role}|>\n{text}\n<|end|>\n"


def rendered():
    """A turn as it stands in the training text; a null role is 'unknown', a null text empty."""
    return F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))


def preference_rows(turns: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Masked rows of all `pairs` (pair_id, chosen, rejected: ids of conversations in `turns`).

    Columns: pair_id; part ('prompt', 'chosen' or 'rejected'); turn; role; rendered; mask (1 where a completion's assistant turn is
    learned, else 0); copies (rows of `turns` that say the same); prompt_turns (distinct turns in the common prefix).
    A null turn number counts as -1, before all others; rows with a null conversation belong to no pair. A conversation without turns
    gives no rows, and one equal to its partner gives a prompt only. Pairs must have distinct ids. Other columns aren't read.
    """
    say = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("conv")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("conv")))).alias("s")).select("pair_id", "s.*")
    rows = say.join(sides, "conv")
    # the digest of a turn is a sum of hashes, exact as a decimal, so its parts may be summed in any order
    one = lambda seed: F.xxhash64("role", "text", "copies", F.lit(seed)).cast("decimal(20,0)")
    either = lambda part, seed: F.sum(F.when(F.col("part") == part, one(seed)))
    compared = rows.groupBy("pair_id", "turn").agg(either("chosen", 1).alias("c1"), either("chosen", 2).alias("c2"), either("rejected", 1).alias("r1"), either("rejected", 2).alias("r2"))
    equal = F.col("c1").eqNullSafe(F.col("r1")) & F.col("c2").eqNullSafe(F.col("r2"))
    forks = compared.groupBy("pair_id").agg(F.min(F.when(~equal, F.col("turn"))).alias("fork"))
    lengths = compared.join(forks, "pair_id").groupBy("pair_id", "fork").agg(F.count(F.when(F.col("fork").isNull() | (F.col("turn") < F.col("fork")), 1)).alias("prompt_turns"))
    common = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    placed = rows.join(lengths, "pair_id").where(~common | (F.col("part") == "chosen"))
    return placed.select(
        "pair_id", F.when(common, F.lit("prompt")).otherwise(F.col("part")).alias("part"), "turn", "role", rendered().alias("rendered"),
        F.when(~common & (F.col("role") == "assistant"), 1).otherwise(0).alias("mask"), "copies", "prompt_turns",
    )


def cut_replies(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, pairs) for `preference_rows` where no preferences are recorded: a reply in full is preferred to the same reply cut short.

    Each conversation with an assistant turn gives one pair, named by its id. Chosen: its turns up to the last assistant turn. Rejected:
    the same turns, but in that last one the assistant's texts keep only the first half of their code points (rounded down). So the common
    prefix is all that stands before the last reply. A conversation whose last reply is empty or null is equal to its partner and gives a
    prompt only. Null turn numbers count as -1; rows with a null conversation, or after the last reply, and conversations without a reply
    belong to no pair. conv_id in the result is text: the id and the side.
    """
    say = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("pair_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ends = say.where("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"))
    upto = say.join(ends, "pair_id").where("turn <= last")
    half = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.expr("substring(text, 1, cast(length(text) div 2 as int))")).otherwise(F.col("text"))
    name = lambda side: F.concat(F.col("pair_id").cast("string"), F.lit(f" {side}"))
    sides = F.explode(F.array(F.struct(name("chosen").alias("conv_id"), F.col("text")), F.struct(name("rejected").alias("conv_id"), half.alias("text"))))
    pairs = ends.select("pair_id", name("chosen").alias("chosen"), name("rejected").alias("rejected"))
    return upto.select("turn", "role", sides.alias("s")).select("s.conv_id", "turn", "role", "s.text"), pairs
