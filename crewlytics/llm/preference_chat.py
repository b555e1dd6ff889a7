"""Preference examples: one prompt and two masked completions for each pair of conversations.

The turns that two conversations begin with in common are the prompt, rendered once; the turns
after them are the two completions. A trainer learns from the trained spans alone: the assistant's
texts with their end marks, not the headers and not what others say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "concat('<|', coalesce({t}.role, ''), '|>\n')"
END = "<|end|>\n"
SPANS = "array<struct<start:int,length:int>>"


def _render(turns: str) -> str:
    one = f"concat({HEADER.format(t='t')}, coalesce(t.text, ''), '{END}')"
    return f"array_join(transform({turns}, t -> {one}), '')"


def _trained(turns: str) -> str:
    head, body = f"length({HEADER.format(t='t')})", f"length(coalesce(t.text, '')) + {len(END)}"
    span = f"array(struct(acc.at + {head} as start, {body} as length))"
    step = (
        f"struct(acc.at + {head} + {body} as at, case when t.role = 'assistant' "
        f"then concat(acc.spans, {span}) else acc.spans end as spans)"
    )
    start = f"struct(0 as at, cast(array() as {SPANS}) as spans)"
    return f"aggregate({turns}, {start}, (acc, t) -> {step}, acc -> acc.spans)"


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair that both sides name: pair_id, n_prompt_turns, prompt, chosen,
    rejected, chosen_spans, rejected_spans (start and length in characters of the completion).

    Both inputs have pair_id, turn, role and text, and may have more columns. Turns are in order
    of turn, role and text, nulls first; repeated turns stay. Turns are alike when role and text
    are, null like null. Rows with a null pair_id belong to no pair. Conversations that are alike
    have empty completions; a null text is rendered empty. A pair's turns meet in one task, as its
    rendered texts are one row.
    """

    def side(turns: DataFrame, name: str) -> DataFrame:
        turns = turns.where("pair_id is not null")
        return turns.select("pair_id", F.lit(name).alias("side"), F.struct("turn", "role", "text").alias("t"))

    both = side(chosen, "c").unionByName(side(rejected, "r"))
    held = both.groupBy("pair_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in "cr"]
    )
    held = held.where("size(c) > 0 and size(r) > 0")
    unlike = "not (x.role <=> y.role and x.text <=> y.text)"
    first = f"array_position(zip_with(c, r, (x, y) -> x is null or y is null or {unlike}), true)"
    held = held.withColumn("n", F.expr(f"cast(if({first} > 0, {first} - 1, size(c)) as int)"))
    return held.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        F.expr(_render("slice(c, 1, n)")).alias("prompt"),
        *[F.expr(_render(f"slice({s}, n + 1, size({s}))")).alias(name) for s, name in (("c", "chosen"), ("r", "rejected"))],
        *[
            F.expr(_trained(f"slice({s}, n + 1, size({s}))")).alias(f"{name}_spans")
            for s, name in (("c", "chosen"), ("r", "rejected"))
        ],
    )


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from plain ones (conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn; rejected is the same with the last
    assistant turn of its partner in that place, where partners are the ids 2k and 2k + 1.
    Conversations in which either has no assistant turn give no pair. Of several assistant turns
    with the last number, the greatest text counts; turns without a number are left out.
    """
    turns = turns.where("conv_id is not null and turn is not null")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.expr("conv_id ^ 1").alias("conv_id"), F.col("last.text").alias("other_text"))
    ends = last.join(other, "conv_id").select(
        "conv_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"), "other_text"
    )
    before = turns.join(ends, "conv_id").where("turn < last_turn")
    before = before.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    reply = F.col("conv_id").alias("pair_id"), F.col("last_turn").alias("turn"), F.lit("assistant").alias("role")
    return (
        before.union(ends.select(*reply, F.col("last_text").alias("text"))),
        before.union(ends.select(*reply, F.col("other_text").alias("text"))),
    )
