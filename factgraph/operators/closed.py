"""Evidence for what plans do not ask: absence and counts, over tables that are stated to be whole.

Absence and counts hold only of a scope that is known: so their evidence names it by a
digest that does not depend on order or partitions (how many distinct rows, and the sum
of a hash of each), and gives numbers that add up. Whoever has the tables can count
again, group by group, and sees where they have changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of a group are dealt, so that a change is found in a small piece.
PARTS = 16


def row_hash(*columns: Column) -> Column:
    """60 bits of a row's digest as a number; lengths keep values and nulls apart."""
    text = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substr(F.md5(F.concat_ws(",", *text).cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")


def scope_digest(rows: DataFrame) -> DataFrame:
    """One row: n (distinct rows) and total (sum of their hashes) of a table."""
    own = rows.distinct().select(row_hash(*map(F.col, rows.columns)).alias("_h"))
    return own.agg(F.count("*").alias("n"), F.coalesce(F.sum("_h"), F.lit(0)).cast("decimal(38,0)").alias("total"))


def absent(population: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The distinct ``key`` of the population that no fact has; null keys are none."""
    return population.select(key).filter(F.col(key).isNotNull()).distinct().join(facts.select(key), key, "left_anti")


def absence_statement(population: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """what, n, total: digests of population, facts and absent keys, and of those that have facts.

    The keys with facts are counted by a semi-join of their own, so that the two counts must add up to the population's.
    """
    own = population.select(key).filter(F.col(key).isNotNull())
    parts = {"population": own, "facts": facts, "present": own.join(facts.select(key), key, "left_semi"), "absent": absent(population, facts, key)}
    return reduce(DataFrame.unionByName, [scope_digest(v).select(F.lit(k).alias("what"), "n", "total") for k, v in parts.items()])


def statement_faults(statement: DataFrame, population: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """what, stated, found of the digests that the tables do not have, and 'sum' where present and absent do not make up the population."""
    now = absence_statement(population, facts, key).withColumnsRenamed({"n": "_n", "total": "_total"})
    wrong = statement.join(now, "what", "full_outer").filter(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("total").eqNullSafe(F.col("_total")))).select("what", F.col("n").alias("stated"), F.col("_n").alias("found"))
    of = lambda w: F.coalesce(F.sum(F.when(F.col("what").isin(*w), F.col("n"))), F.lit(0))
    sums = statement.agg(of(["population"]).alias("stated"), of(["present", "absent"]).alias("found")).filter("stated <> found")
    return wrong.unionByName(sums.select(F.lit("sum").alias("what"), "stated", "found"))


def counted(rows: DataFrame, by: str, value: str, parts: int = PARTS) -> DataFrame:
    """``by``, part, n, total: distinct values of each group in parts by their hash; a group's count is the sum of its parts'.

    Pairs are made distinct before they are counted, so a group of any size is spread.
    """
    pairs = rows.select(by, value).filter(F.col(value).isNotNull()).distinct().withColumn("_h", row_hash(F.col(value)))
    return pairs.groupBy(by, F.pmod(F.col("_h"), F.lit(parts)).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum("_h").cast("decimal(38,0)").alias("total"))


def count_faults(claims: DataFrame, evidence: DataFrame, rows: DataFrame, by: str, value: str, parts: int = PARTS) -> DataFrame:
    """``by``, part, fault: parts that the rows do not have, and groups whose claimed count (n) is not the sum of their parts."""
    now = counted(rows, by, value, parts).select(F.col(by).alias("_by"), F.col("part").alias("_part"), F.col("n").alias("_n"), F.col("total").alias("_total"))
    both = evidence.join(now, evidence[by].eqNullSafe(now["_by"]) & (evidence["part"] == now["_part"]), "full_outer")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("total").eqNullSafe(F.col("_total"))
    changed = both.filter(~same).select(F.coalesce(by, "_by").alias(by), F.coalesce("part", "_part").alias("part"), F.lit("changed").alias("fault"))
    sums = evidence.groupBy(F.col(by).alias("_by")).agg(F.sum("n").alias("_n"))
    odd = claims.join(sums, claims[by].eqNullSafe(sums["_by"]), "full_outer").filter(~F.col("n").eqNullSafe(F.col("_n")))
    return changed.unionByName(odd.select(F.coalesce(by, "_by").alias(by), F.lit(None).cast("int").alias("part"), F.lit("count").alias("fault")))
