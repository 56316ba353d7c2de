"""Chat formatting of preference pairs, with DataFrame functions only.

Two conversations, a chosen and a rejected one, share their first turns up to the
first place where they differ. Those turns are rendered once, as the prompt; what
follows is rendered for either side, with a mask that is 1 on the assistant's turns
of a completion and 0 elsewhere.

The result has a row for each rendered turn, so no row grows with the length of a
conversation. Rows with the same words under one turn are counted for either side,
partly before the shuffle, and never gathered in a list; the first difference of a pair
is the smallest turn with unequal counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = -(2**63)


def render(role: Column, text: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def numbered_pairs(turns: DataFrame) -> DataFrame:
    """``turns`` with pair_id and side: conversations 2k (chosen, side 0) and 2k + 1 (rejected, side 1).

    Columns of these names that ``turns`` has are replaced. Any long is an id, negative
    ones too; a null conv_id gives neither pair nor side.
    """
    conv = F.col("conv_id").cast("long")
    return turns.withColumns({"pair_id": F.shiftright(conv, 1), "side": conv.bitwiseAND(F.lit(1)).cast("int")})


def preference_segments(paired: DataFrame) -> DataFrame:
    """pair_id, part, turn, seq, segment, mask from rows of pair_id, side, turn, role and text.

    ``part`` is prompt, chosen or rejected. Turns stand in the order of ``turn``, rows
    with the same turn in that of role and text, numbered by ``seq``; repeated rows are
    rendered as often as they stand there. A null turn comes first (and is returned as
    null), a null role is "user", a null text is empty. Rows without pair or side take
    no part. A pair with one side only has no prompt; a pair of equal sides has no
    completions.
    """
    rows = paired.filter(F.col("pair_id").isNotNull() & F.col("side").isin(0, 1)).select(
        F.col("pair_id").cast("long").alias("pair_id"),
        "side",
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    count = lambda k: F.count_if(F.col("side") == k)
    turns = rows.groupBy("pair_id", "turn", "role", "text").agg(count(0).alias("chosen"), count(1).alias("rejected"))
    first = turns.filter(F.col("chosen") != F.col("rejected")).groupBy("pair_id").agg(F.min("turn").alias("_first"))
    cut = turns.join(first, "pair_id", "left")
    same = F.col("_first").isNull() | (F.col("turn") < F.col("_first"))
    part = lambda name, keep: F.struct(F.lit(name).alias("part"), F.when(keep, F.col("rejected" if name == "rejected" else "chosen")).otherwise(0).alias("n"))
    parts = cut.select("pair_id", "turn", "role", "text", F.explode(F.array(part("prompt", same), part("chosen", ~same), part("rejected", ~same))).alias("p"))
    parts = parts.filter("p.n > 0").select("pair_id", "turn", "role", "text", "p.part", "p.n")
    before = Window.partitionBy("pair_id", "turn", "part").orderBy("role", "text").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    said = parts.withColumn("seq", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("n") - 1)))
    return said.select(
        "pair_id",
        "part",
        F.when(F.col("turn") != FIRST, F.col("turn")).alias("turn"),
        F.col("seq").cast("int").alias("seq"),
        render(F.col("role"), F.col("text")).alias("segment"),
        F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), 1).otherwise(0).alias("mask"),
    )


def examples(segments: DataFrame) -> DataFrame:
    """A row for each pair: prompt, chosen, rejected, and the (start, end) spans of each completion under the mask.

    For conversations that fit a row; spans count code points.
    """
    order = F.struct(F.coalesce("turn", F.lit(FIRST)).alias("turn"), "seq", "segment", "mask")
    own = lambda name: F.sort_array(F.collect_list(F.when(F.col("part") == name, order)))
    rows = segments.groupBy("pair_id").agg(*(own(n).alias(f"_{n}") for n in ("prompt", "chosen", "rejected")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.segment), "")

    def spans(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        step = lambda a, x: F.struct(
            (a.at + F.length(x.segment)).alias("at"),
            F.when(x["mask"] == 1, F.concat(a.out, F.array(F.struct(a.at.alias("start"), (a.at + F.length(x.segment)).alias("end"))))).otherwise(a.out).alias("out"),
        )
        return F.aggregate(c, start, step, lambda a: a.out)

    return rows.select("pair_id", text(F.col("_prompt")).alias("prompt"), *(x for n in ("chosen", "rejected") for x in (text(F.col(f"_{n}")).alias(n), spans(F.col(f"_{n}")).alias(f"{n}_spans"))))
