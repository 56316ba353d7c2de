"""Merkle manifest of a dataset: a hash tree in each group of rows, and one over the groups.

Leaves are numbered by ``row_number`` in each group; a level's index divided by the
fanout is its parent's, whose digest hashes the sorted child digests. Levels go up as
DataFrames, one written table each, until a node is left in each group (its subroot);
the subroots make a tree of their own. Proofs come down the same tables: a parent's
path, joined to its run, gives each child that path and its own siblings in front.

No group is numbered in one task: rows are dealt in blocks by range of (group, order),
numbered in their block, and blocks get their starts from sums over counts, of which
there are as many as blocks and groups. Text is read once; what is moved are digests.
A path holds a step for each level, so it grows with the logarithm of a group's size.

Rows without group are a group (the first one), rows without id come first in theirs.
Rows with one id are ordered by digest; whole copies are separate leaves with the same
digest, in any order. Texts of any length are hashed whole. An empty table has no
leaves and no root. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm.common import discard, partitions, stored

#: Of a sha256 digest.
_BYTES = 32
#: Blocks for each shuffle partition, so that the blocks of a large group spread evenly.
_BLOCKS = 4
#: Levels of paths that are left to one plan before they are written.
_LAZY_LEVELS = 4


def leaf_digest(*columns: Column) -> Column:
    """Digest (hex) of a row: '-' for a null, else byte count, ':' and value, one after another."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with i (from 0, in each group by ``order``) and n (rows of the group), as long.

    ``rows`` should be a written table: it is read twice. Whole ties get any order.
    """
    spark = rows.sparkSession
    # The last order column parts rows that are equal in all others, however many there are.
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    blocks = stored(ranged.repartitionByRange(_BLOCKS * partitions(spark), *by).withColumn("_block", F.spark_partition_id()), "merkle-blocks")
    sizes = blocks.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(whole).alias("n"))
    within = Window.partitionBy(group, "_block").orderBy(*by[1:])
    out = blocks.withColumn("_row", F.row_number().over(within)).join(starts, [group, "_block"])
    return out.withColumn("i", F.col("_start") + F.col("_row") - 1).drop("_tie", "_block", "_row", "_start")


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Written tables of the levels above ``nodes`` (g, i, n, h): g, i, n, h, run (its children's digests in order, as bytes).

    The list ends with the level at which every group has one node.
    """
    levels: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("i", "h")))
        grouped = nodes.filter("n > 1").groupBy("g", F.expr(f"i div {fanout}").alias("p")).agg(F.max("n").alias("n"), children.alias("kids"))
        run = grouped.select("g", F.col("p").alias("i"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.array_join(F.transform("kids", lambda k: _hex(k.h)), "").alias("run"))
        nodes = stored(run.select("g", "i", "n", F.unhex(F.sha2(F.col("run").cast("binary"), 256)).alias("h"), F.unhex("run").alias("run")), f"merkle-level-{len(levels) + 1}")
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """g, level, h of the node that is left in each group."""
    out = None
    for k, level in enumerate((nodes, *levels)):
        part = level.filter("n = 1").select("g", F.lit(k).alias("level"), "h")
        out = part if out is None else out.unionByName(part)
    return out


def descend(levels: list[DataFrame], ends: DataFrame, fanout: int, carry: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    """g, i, path, ``carry`` of all nodes at the lowest level, and the written tables this reads.

    ``ends`` (g, level, path, carry) has the groups' last nodes. A step of a path has the
    siblings before and after a node as bytes.
    """
    step = "struct<before: binary, after: binary>"
    at = lambda k: ends.filter(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "path", *carry)
    paths, held = at(len(levels)), []
    for k in range(len(levels), 0, -1):
        run = levels[k - 1].select("g", "i", "run")
        child = F.explode(F.expr(f"sequence(0, octet_length(run) div {_BYTES} - 1)")).alias("_c")
        open_ = run.join(paths, ["g", "i"]).select("g", "i", "run", "path", *carry, child)
        siblings = F.expr(f"cast(struct(substring(run, 1, {_BYTES} * _c) AS before, substring(run, {_BYTES} * (_c + 1) + 1) AS after) AS {step})")
        paths = open_.select("g", (F.col("i") * fanout + F.col("_c")).alias("i"), F.array_prepend(F.col("path"), siblings).alias("path"), *carry).unionByName(at(k - 1))
        if (len(levels) - k) % _LAZY_LEVELS == _LAZY_LEVELS - 1 and k > 1:
            paths = stored(paths, f"merkle-paths-{k - 1}")
            held.append(paths)
    return paths, held


def proof_digest(path: str) -> Column:
    """Digest (hex) of all siblings on a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s.before), _hex(s.after))), "").cast("binary"), 256)


def folded(leaf: Column, path: str) -> Column:
    """The root (hex) that a leaf digest (hex) and the siblings on a path make."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_hex(s.before), h, _hex(s.after)).cast("binary"), 256))


def manifest(leaves: DataFrame, fanout: int = 3) -> DataFrame:
    """The columns of ``leaves``, and subroot, root (hex) and path of each row.

    ``leaves`` has grp (string, may be null), id (orders a group), leaf (hex digest) and any
    other columns, which should be narrow: they are moved with the digests.
    """
    own = [c for c in leaves.columns if c not in ("grp", "leaf")]
    # '0' for no group, so that it comes first and differs from an empty name.
    g = F.when(F.col("grp").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("grp")))
    slim = stored(leaves.select(g.alias("g"), F.unhex("leaf").alias("h"), *own), "merkle-leaves")
    nodes = stored(numbered(slim, "g", ["id", "h"]), "merkle-nodes")
    levels = climb(nodes, fanout)
    subroots = stored(tops(nodes, levels), "merkle-subroots")
    above = stored(numbered(subroots.withColumn("all", F.lit(0)), "all", ["g"]).select(F.lit("").alias("g"), "i", "n", "h", F.col("g").alias("group"), "level"), "merkle-upper")
    upper = climb(above.select("g", "i", "n", "h"), fanout)
    root = tops(above, upper).select("g", "level", F.col("h").alias("root"), F.expr("cast(array() AS array<struct<before: binary, after: binary>>)").alias("path"))
    to_root, held = descend(upper, root, fanout, ["root"])
    ends = stored(above.join(to_root, ["g", "i"]).select(F.col("group").alias("g"), "level", F.col("h").alias("subroot"), "root", "path"), "merkle-ends")
    discard(slim, subroots, above, *upper, *held)
    paths, _ = descend(levels, ends, fanout, ["subroot", "root"])
    out = nodes.join(paths, ["g", "i"])
    grp = F.when(F.col("g") != "0", F.substring("g", 2, 1 << 30)).alias("grp")
    return out.select(grp, *own, _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "path")
