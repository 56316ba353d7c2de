"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b).

    Each round turns the edges into ones to smaller nodes and keeps the components;
    it ends when nothing changes, after about log(nodes) rounds. Rounds are written
    to the shared folder, and deleted when the next one is; so is the result, which is left there. A node of very many edges is met as a minimum taken before
    the shuffle and a join that Spark may split.
    """
    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join are plain shuffles, which Spark can split by size.
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "edges")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # After the large stars a node has one edge for each minimum around it; the distinct
        # edges are shuffled once and used twice.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, cur = cur, stored(small.filter("a <> b").distinct(), "edges")
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        del both, large, down, small
        discard(old, low)
        if (now.n, now.h) == mark:
            break
        mark = (now.n, now.h)
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    out = stored(cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    discard(cur)
    return out
