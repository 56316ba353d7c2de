"""Witness facts of whole results, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions.terms import TYPE
from factgraph.plans.catalog import Property
from factgraph.plans.compiler import oriented


def _meets(rows: DataFrame, source, column: str, side, space: str):
    """``column``'s tokens compared with a side of facts, as keys where the space has any."""
    keys = source.unrender(rows[column], space)
    return rows[column] == source.render(side, space) if keys is None else keys == side


def property_witness(rows: DataFrame, source, prop: Property, subject: str, value: str | None, atom: str) -> DataFrame:
    """row_key, atom, s, p, o: the smallest fact of ``prop`` for each row's column ``subject``, and ``value`` if given.

    Facts keep their physical direction, whichever way the property reads them. They are
    joined by key; only those that fit are written as tokens.
    """
    r = oriented(source, prop)
    facts = r.rows.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    on = _meets(rows, source, subject, facts["_a"], r.src)
    if value is not None:
        on = on & _meets(rows, source, value, facts["_b"], r.dst)
    a, b = source.render(F.col("_a"), r.src), source.render(F.col("_b"), r.dst)
    s, o = (b, a) if prop.inverse else (a, b)
    least = rows.join(facts, on).groupBy("row_key").agg(F.min(F.struct(s.alias("s"), F.lit(f"<{prop.predicate}>").alias("p"), o.alias("o"))).alias("w"))
    return least.select("row_key", F.lit(atom).alias("atom"), "w.s", "w.p", "w.o")


def class_witness(rows: DataFrame, source, classes: tuple[str, ...], node: str, atom: str) -> DataFrame:
    """row_key, atom, s, p, o: the smallest type fact of column ``node`` among ``classes``."""
    parts = None
    for c in classes:
        nodes, space = source.members(c)
        nodes = nodes.select(F.col("node").alias("_a"))
        met = rows.join(nodes, _meets(rows, source, node, nodes["_a"], space))
        part = met.select("row_key", F.struct(F.col(node).alias("s"), F.lit(f"<{TYPE}>").alias("p"), F.lit(f"<{c}>").alias("o")).alias("w"))
        parts = part if parts is None else parts.unionByName(part)
    least = parts.groupBy("row_key").agg(F.min("w").alias("w"))
    return least.select("row_key", F.lit(atom).alias("atom"), "w.s", "w.p", "w.o")


def keyed(rows: DataFrame, domain: str = "row") -> DataFrame:
    """``rows`` with row_key, a digest of all columns in order; lengths keep values and nulls apart."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in rows.columns]
    return rows.withColumn("row_key", F.sha2(F.concat_ws(",", F.lit(domain), *parts).cast("binary"), 256))


def certificates(witnesses: DataFrame) -> DataFrame:
    """row_key and its supports (atom, s, p, o) in order of atom."""
    return witnesses.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("atom", "s", "p", "o"))).alias("supports"))


def scalar_violations(source, prop: Property) -> DataFrame:
    """Subjects with several values of a property, and how many."""
    r = oriented(source, prop)
    many = r.rows.groupBy("src").agg(F.count_distinct("dst").alias("n_values")).filter("n_values > 1")
    return many.select(source.render(F.col("src"), r.src).alias("subject"), "n_values")
