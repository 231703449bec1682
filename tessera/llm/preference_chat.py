"""Chat formatting of preference pairs, by DataFrame functions only.

Of a chosen and a rejected conversation the longest common prefix of turns is
rendered once, as the prompt; what follows on either side is its completion,
with the stretches that are to be learned (the assistant's words and the mark
that ends them) as a mask of character spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT = "<|im_start|>", "<|im_end|>\n"
#: What a mark in a text begins with, and what stands there instead.
FORGED, HARMLESS = "<|im_", "<| im_"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(SHUT))), "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) of code points in the rendered turns, from after an assistant's header to the end of its turn."""
    head = lambda t: F.length(t["role"]) + (len(OPEN) + 1)
    size = lambda t: head(t) + F.length(t["text"]) + len(SHUT)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        end = acc["at"] + size(t)
        span = F.array(F.struct((acc["at"] + head(t)).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step)["spans"]


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row a pair: pair_id, n_prompt, prompt, chosen, rejected, chosen_mask, rejected_mask, usable.

    ``turns``: pair_id, side (``chosen`` or ``rejected``), turn, role, text;
    other columns don't matter. Turns are ordered by turn, then role and text,
    nulls first; null roles and texts render as empty, and compare so. A mark
    that a role or text holds itself can't open or end a turn: ``<|im_`` is
    rendered ``<| im_``. Repeated turns are turns. A side that is missing or ends within the common prefix has an empty
    completion. A pair is ``usable`` if both sides have something to learn.
    Rows of other sides and of null pairs are not part of any pair. A pair is
    gathered once, in one shuffle; only one pair's turns ever stand together.
    """
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(FORGED), F.lit(HARMLESS)).alias(c)
    turn = F.struct(F.col("turn"), plain("role"), plain("text"))
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, turn))).alias(name)
    pairs = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen"), side("rejected"))
    same = lambda c, r: c.isNotNull() & r.isNotNull() & (c["role"] == r["role"]) & (c["text"] == r["text"])
    first = F.array_position(F.zip_with("chosen", "rejected", lambda c, r: F.coalesce(same(c, r), F.lit(False))), F.lit(False))
    longest = F.greatest(F.size("chosen"), F.size("rejected"))
    n = F.when(first > 0, first - 1).otherwise(longest).cast("int")
    pairs = pairs.withColumn("n_prompt", n)
    rest = lambda name: F.slice(F.col(name), F.col("n_prompt") + 1, F.greatest(F.size(name) - F.col("n_prompt"), F.lit(0)))
    out = pairs.select(
        "pair_id", "n_prompt", _render(F.slice("chosen", F.lit(1), F.col("n_prompt"))).alias("prompt"), rest("chosen").alias("c"), rest("rejected").alias("r")
    )
    return out.select(
        "pair_id", "n_prompt", "prompt", _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    ).withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def pair_by_last_turn(conversations: DataFrame) -> DataFrame:
    """Sides of one pair for each conversation: itself, and its turns up to its last assistant turn, which the last assistant turn of the conversation beside it replaces.

    Conversations 2k and 2k + 1 are beside each other. The last turn is that of
    the largest (turn, text) with a turn. The rejected side of a conversation
    without assistant turns is the whole conversation; where the one beside it
    has none, the rejected side ends before the last assistant turn. Turns of a
    null conversation belong to no pair. Two conversations' turns meet in one shuffle.
    """
    said = F.when((F.col("role") == "assistant") & F.col("turn").isNotNull(), F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    beside = Window.partitionBy(F.expr("conv_id div 2"))
    even = F.pmod("conv_id", F.lit(2)) == 0
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    rows = rows.select("*", F.max(F.when(even, said)).over(beside).alias("of_even"), F.max(F.when(~even, said)).over(beside).alias("of_odd"), said.alias("said"))
    rows = rows.select("*", F.when(even, F.col("of_even")).otherwise(F.col("of_odd")).alias("own"), F.when(even, F.col("of_odd")).otherwise(F.col("of_even")).alias("other"))
    side = lambda name, text: F.struct(F.lit(name).alias("side"), F.col("turn").alias("turn"), F.col("role").alias("role"), text.alias("text"))
    before = F.col("own").isNull() | F.col("turn").isNull() | (F.col("turn") < F.col("own")["turn"])
    last = (F.col("said") == F.col("own")) & F.col("other").isNotNull()
    sides = F.array(
        side("chosen", F.col("text")), F.when(before, side("rejected", F.col("text"))), F.when(~before & F.coalesce(last, F.lit(False)), side("rejected", F.col("other")["text"]))
    )
    return rows.select(F.col("conv_id").alias("pair_id"), F.explode(F.array_compact(sides)).alias("s")).select("pair_id", "s.*")
