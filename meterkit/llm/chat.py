"""Preference formatting: a shared prompt and two masked completions of a pair of conversations.

Column functions only. The turns of a conversation are ordered by (turn, role, text), nulls first.
For each pair the longest common prefix of turns (equal role and text) is rendered once as the
prompt; the remaining turns of either side are its completion. A completion comes with a mask:
runs ``length:flag`` in code points, flag 1 for an assistant's words and the end mark after them.

Defined cases: rows without a conversation id belong to none. A null text renders as empty, a null
role as ``unknown``; nulls are equal to nulls. Repeated turns stay, as repeated turns. A pair whose
other side is missing has an empty prompt and null on that side. Identical conversations have
everything in the prompt and empty completions. An empty table gives an empty result. Ids
that are no whole numbers are dealt by their hash. A conversation is one row, with all its turns and whole
texts. Columns besides the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
PARTS = 1024  # of the conversations that share a first turn; also the most rows of its count table


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns as an ordered array of (role, text)."""
    turn = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    listed = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(turn.alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pairs_by_first_turn(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations with the same first turn, two by two in the order of
    (conv_id mod PARTS, conv_id), the first of the two as chosen; an odd last one has no partner.

    Ranks are counted per part and added up over the parts, so a first turn that very many
    conversations share is never ranked in one task."""
    first = F.sha2(F.to_json(F.struct(F.col("turns")[0].alias("t")), {"ignoreNullFields": "false"}), 256)
    number = F.col("conv_id") if isinstance(convs.schema["conv_id"].dataType, IntegralType) else F.xxhash64("conv_id")
    light = convs.select("conv_id", first.alias("key"), F.pmod(number, F.lit(PARTS)).alias("part"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = light.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("conv_id"))
    ranked = light.withColumn("own", own).join(counts, ["key", "part"]).withColumn("at", F.col("before") + F.col("own") - 1)
    side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("conv_id")))
    return ranked.groupBy("key", F.floor(F.col("at") / 2).alias("pair")).agg(side(0).alias("chosen_id"), side(1).alias("rejected_id")).drop("key", "pair")


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(CLOSE), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _mask(turn: Column) -> Column:
    head = F.length(F.coalesce(turn["role"], F.lit("unknown"))) + len(OPEN) + len(CLOSE)
    body = F.length(F.coalesce(turn["text"], F.lit(""))) + len(END)
    trained = F.concat(head.cast("string"), F.lit(":0,"), body.cast("string"), F.lit(":1"))
    return F.when(turn["role"].eqNullSafe(F.lit(TRAINED)), trained).otherwise(F.concat((head + body).cast("string"), F.lit(":0")))


def preference_examples(pairs: DataFrame, convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)."""
    left = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    # pairs without a rejected side match nothing; dealt by their chosen id they don't meet in one task
    right = convs.select(F.col("conv_id").alias("other"), F.col("turns").alias("b"))
    match = (F.coalesce("rejected_id", "chosen_id") == F.col("other")) & F.col("rejected_id").isNotNull()
    both = pairs.join(left, "chosen_id", "left").join(right, match, "left")
    # zip_with fills the shorter side up with null, which equals no turn
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0)).when(differ == 0, F.size("a")).otherwise(differ - 1)
    both = both.withColumn("n", common.cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    text = lambda c: F.array_join(F.transform(c, _render), "")
    mask = lambda c: F.array_join(F.transform(c, _mask), ",")
    return both.select(
        "chosen_id",
        "rejected_id",
        F.col("n").cast("bigint").alias("n_prompt_turns"),
        F.when(F.col("n") > 0, text(F.slice("a", F.lit(1), F.col("n")))).otherwise("").alias("prompt"),
        text(rest("a")).alias("chosen"),
        mask(rest("a")).alias("chosen_mask"),
        text(rest("b")).alias("rejected"),
        mask(rest("b")).alias("rejected_mask"),
    )
