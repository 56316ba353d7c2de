"""Path evidence: what can be reached over facts, with one witness path for each pair.

A frontier of (start, node) pairs grows by one step a round, never beyond ``most`` steps.
Each round is a join of the newest pairs with the facts, a choice of one parent for each
new pair by a partial aggregation, and an anti-join with the pairs known before; rounds
are written tables. A pair keeps its parent only, so the state is one row a pair, and
paths are put together from the parents at the end. Cycles end by themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.sources.shared import stored


def reachable(facts: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, node, steps, parent, p for every node that facts (s, p, o) lead to from a start (node) in at most ``most`` steps.

    The start itself is reached in no step. Of the facts that lead to a node in its
    smallest number of steps the smallest (parent, p) is kept. Null nodes lead nowhere.
    """
    none = F.lit(None).cast("string")
    kind = starts.schema["node"].dataType
    rounds = [stored(starts.filter("node IS NOT NULL").select(F.col("node").alias("start"), "node", F.lit(0).alias("steps"), F.lit(None).cast(kind).alias("parent"), none.alias("p")).distinct(), "reached")]
    edges = facts.filter("s IS NOT NULL AND o IS NOT NULL").select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
    for k in range(1, most + 1):
        met = rounds[-1].select("start", F.col("node").alias("_s")).join(edges, "_s")
        first = met.groupBy("start", F.col("_o").alias("node")).agg(F.min(F.struct(F.col("_s").alias("parent"), F.col("_p").alias("p"))).alias("w"))
        known = reduce(DataFrame.unionByName, rounds).select("start", "node")
        new = stored(first.join(known, ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("steps"), "w.parent", "w.p"), "reached")
        if not new.take(1):
            break
        rounds.append(new)
    return reduce(DataFrame.unionByName, rounds)


def witness_paths(reached: DataFrame) -> DataFrame:
    """start, node, steps, path (the facts from start to node, in order) of what reachable() returns."""
    deepest = reached.agg(F.max("steps")).first()[0] or 0
    out = reached.select("start", "node", "steps", F.col("node").alias("_at"), F.expr("cast(array() AS array<struct<s: string, p: string, o: string>>)").alias("path"))
    up = reached.filter("steps > 0").select("start", F.col("node").alias("_at"), "parent", "p")
    for _ in range(deepest):
        step = F.struct(F.col("parent").cast("string").alias("s"), F.col("p").alias("p"), F.col("_at").cast("string").alias("o"))
        path = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.array_prepend("path", step))
        out = out.join(up, ["start", "_at"], "left").select("start", "node", "steps", F.coalesce("parent", "_at").alias("_at"), path.alias("path"))
    return out.drop("_at")


def path_faults(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """start, node, fault of witness paths that do not hold: wrong ends or length, broken chains, steps that are no facts."""
    size = F.size("path")
    ends = F.when(size == 0, F.col("start").cast("string").eqNullSafe(F.col("node").cast("string"))).otherwise(F.get("path", F.lit(0)).s.eqNullSafe(F.col("start").cast("string")) & F.element_at("path", -1).o.eqNullSafe(F.col("node").cast("string")))
    chain = F.forall(F.arrays_zip(F.transform(F.slice("path", 1, F.greatest(size - 1, F.lit(0))), lambda x: x.o).alias("a"), F.transform(F.slice("path", 2, F.greatest(size, F.lit(1))), lambda x: x.s).alias("b")), lambda z: z.a.eqNullSafe(z.b))
    told = F.array_compact(F.array(F.when(size != F.col("steps"), "length"), F.when(~ends, "ends"), F.when(~chain, "chain")))
    own = paths.select("start", "node", F.explode(told).alias("fault"))
    steps = paths.select("start", "node", F.explode("path").alias("x")).select("start", "node", "x.s", "x.p", "x.o")
    known = facts.select(F.col("s").cast("string").alias("s"), "p", F.col("o").cast("string").alias("o"))
    return own.unionByName(steps.join(known, ["s", "p", "o"], "left_anti").select("start", "node", F.lit("no fact").alias("fault")).distinct())
