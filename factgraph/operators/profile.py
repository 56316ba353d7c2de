"""Profiles of a fact table or of mapped relations, exact or as bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions.terms import TYPE, effective_datatype, token_kind, token_language
from factgraph.sources.shared import spread


def band(n: Column) -> Column:
    """0, 1, 2-10, 11-100 or >100."""
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 10, "2-10").when(n <= 100, "11-100").otherwise(">100")


def type_counts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("p") == f"<{TYPE}>").groupBy(F.col("o").alias("cls")).agg(F.count_distinct("s").alias("n_nodes"))


def coverage(facts: DataFrame, cls: str) -> DataFrame:
    """For each predicate, how many nodes of a class have it, and how many values they have."""
    nodes = facts.filter((F.col("p") == f"<{TYPE}>") & (F.col("o") == f"<{cls}>")).select("s").distinct()
    own = facts.join(nodes, "s").groupBy("p").agg(F.count_distinct("s").alias("n_nodes"), F.count_distinct("o").alias("n_values"))
    return own.withColumn("value_band", band(F.col("n_values")))


def fanout(facts: DataFrame) -> DataFrame:
    """Nodes of each predicate by their number of values."""
    each = facts.groupBy("p", "s").agg(F.count_distinct("o").alias("degree"))
    return each.groupBy("p", "degree").agg(F.count("*").alias("n_nodes"))


def cardinality_bands(facts: DataFrame) -> DataFrame:
    each = facts.groupBy("p", "s").agg(F.count_distinct("o").alias("n"))
    return each.groupBy("p", band(F.col("n")).alias("band")).agg(F.count("*").alias("n_nodes"))


def degrees(source, predicates: list[str]) -> DataFrame:
    """p, n, n_nodes: the nodes of each predicate of a mapped source by their number of values, counted by keys."""
    parts = []
    for p in predicates:
        each = spread(source.relation(p).rows, "src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"))
        parts.append(each.groupBy("n").agg(F.count("*").alias("n_nodes")).select(F.lit(f"<{p}>").alias("p"), "n", "n_nodes"))
    return reduce(DataFrame.unionByName, parts)


def cooccurrence(facts: DataFrame, predicates: list[str]) -> DataFrame:
    """Pairs of the given predicates and the nodes that have both; a node's predicates stay in one short array."""
    own = facts.filter(F.col("p").isin(*predicates)).groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    pairs = own.select(F.explode("ps").alias("a"), "ps").select("a", F.explode("ps").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_nodes"))


def observed(facts: DataFrame) -> DataFrame:
    """What each predicate joins: kinds and datatypes of its ends."""
    return facts.groupBy("p", token_kind(F.col("s")).alias("s_kind"), token_kind(F.col("o")).alias("o_kind"), effective_datatype(F.col("o")).alias("datatype")).agg(F.count("*").alias("n_facts"))


def fan_in(facts: DataFrame) -> DataFrame:
    """Values of each predicate by the number of nodes that have them."""
    each = facts.groupBy("p", "o").agg(F.count_distinct("s").alias("degree"))
    return each.groupBy("p", "degree").agg(F.count("*").alias("n_values"))


def languages(facts: DataFrame) -> DataFrame:
    """Literals of each predicate by language; null for those without one."""
    own = facts.filter(token_kind(F.col("o")) == "literal")
    return own.groupBy("p", token_language(F.col("o")).alias("language")).agg(F.count("*").alias("n_facts"))


def empty_classes(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Of ``classes`` (cls) those that no node has."""
    met = facts.filter(F.col("p") == f"<{TYPE}>").select(F.col("o").alias("cls"))
    return classes.select("cls").distinct().join(met, "cls", "left_anti")


def counterexamples(facts: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """For each predicate in ``expected`` (p, o_kind, datatype), its facts of another kind or datatype: how many, and the first ``k``."""
    what = F.broadcast(expected.withColumnsRenamed({"o_kind": "_k", "datatype": "_d"}))  # a row for each predicate of a catalog
    fits = (token_kind(F.col("o")) == F.col("_k")) & (F.col("_d").isNull() | (effective_datatype(F.col("o")) == F.col("_d")))
    odd = facts.join(what, "p").filter(~F.coalesce(fits, F.lit(False)))
    counts = odd.groupBy("p").agg(F.count("*").alias("n_odd"))
    first = odd.withColumn("position", F.row_number().over(Window.partitionBy("p").orderBy("s", "o"))).filter(F.col("position") <= k)
    return first.join(counts, "p").select("p", "s", "o", F.col("position").cast("long").alias("position"), "n_odd")


DISCLOSURE = ("exact", "bucketed", "local_only", "prohibited")


def disclosed(rows: DataFrame, classes: dict[str, str], outside: bool = True) -> DataFrame:
    """``rows`` as they may be shown: exact columns as they are, bucketed ones as bands, local ones only if not ``outside``, others never.

    A column without a class is prohibited.
    """
    if unknown := set(classes.values()) - set(DISCLOSURE):
        raise ValueError(f"no disclosure classes: {sorted(unknown)}")
    shown = []
    for c in rows.columns:
        kind = classes.get(c, "prohibited")
        if kind == "exact" or kind == "local_only" and not outside:
            shown.append(F.col(c))
        elif kind == "bucketed":
            shown.append(band(F.col(c)).alias(c))
    return rows.select(*shown)


def contract_report(source, catalog) -> DataFrame:
    """For each property of a catalog that reads its facts forwards: shape, predicate, scalar, n_facts, n_nodes, n_several (nodes with several values), n_outside (facts whose value its first branch does not accept, classes apart)."""
    from factgraph.plans.compiler import accepts

    shapes = {lens.key: lens.shape.strip("<>") for lens in catalog.lenses}
    parts = []
    for p in catalog.properties:
        if p.inverse:
            continue
        r = source.relation(p.predicate)
        value = source.render(F.col("dst"), r.dst)
        each = r.rows.distinct().groupBy("src").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(accepts(value, p.branches[0]), F.lit(False))).alias("odd"))
        one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"), F.count("*").alias("n_nodes"), F.count_if(F.col("n") > 1).alias("n_several"), F.coalesce(F.sum("odd"), F.lit(0)).alias("n_outside"))
        parts.append(one.select(F.lit(shapes[p.lens]).alias("shape"), F.lit(p.predicate).alias("predicate"), F.lit(p.scalar).alias("scalar"), "n_facts", "n_nodes", "n_several", "n_outside"))
    return reduce(DataFrame.unionByName, parts)


def source_size(facts: DataFrame, once: bool = False) -> DataFrame:
    """n_facts, n_bytes: distinct (s, p, o) tokens and the bytes of their N-Triples lines; ``once``: the facts are a set."""
    own = facts.select("s", "p", "o")
    own = own if once else own.distinct()
    return own.agg(F.count("*").alias("n_facts"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "s", "p", "o")) + 3), F.lit(0)).alias("n_bytes"))
