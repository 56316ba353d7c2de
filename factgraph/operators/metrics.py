"""Reports over runs: ratios, percentiles, gates, and multiset comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.sources.shared import stored


def ratio(condition: Column) -> Column:
    """Share of rows that meet a condition; null over no rows."""
    return F.try_divide(F.sum(F.when(condition, 1).otherwise(0)).cast("double"), F.count("*").cast("double"))


def nearest_rank(column: str, share: float) -> Column:
    """The value at rank ceil(share * n) of few values: they stand in one buffer. For whole tables: nth_values()."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[f"_{c}"])
    return out


def _beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with ``table`` on ``by``, where nulls are equal."""
    named = table.withColumnsRenamed({c: f"_{c}" for c in by})
    return rows.join(named, _same(rows, named, by)).drop(*(f"_{c}" for c in by))


#: A range with so many values at most is sorted; larger ones are cut again, into so many parts.
SORTED, CUTS = 65_536, 64


def nth_values(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], most: int = SORTED) -> DataFrame:
    """by, name, nth: in each group, the value at each rank that ``ranks`` makes of the number of values.

    For all groups and ranks at once, each pass cuts the range in which a rank lies at
    approximate quantiles, counts its parts exactly, and keeps the one the rank falls in: a
    single value, which is the answer, or the open range between two, with a 64th of the
    values or little more. Ranges of at most ``most`` values are sorted. So no buffer holds
    a group, and the number of passes grows with the logarithm of the largest one.
    Nulls are no values; groups without values are left out. ``rows`` is read twice a pass.
    """
    own = rows.select(*by, F.col(value).alias("_v")).filter("_v IS NOT NULL")
    sizes = own.groupBy(*by).agg(F.count("*").alias("_m"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.least(F.greatest(f(F.col("_m")).cast("long"), F.lit(1)), F.col("_m")).alias("_rank")) for k, f in ranks.items()))).alias("x")
    none = F.lit(None).cast(rows.schema[value].dataType)
    # _rank counts in the open range from _lo to _hi, which has _m values.
    state = stored(sizes.select(*by, asked, "_m").select(*by, "x.name", "x._rank", "_m", none.alias("_lo"), none.alias("_hi")), "ranks")
    inside = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    keys, found = [*by, "name"], []
    while True:
        few = _beside(own, state.filter(F.col("_m") <= most), by).filter(inside)
        order = Window.partitionBy(*keys).orderBy("_v")
        found.append(stored(few.withColumn("_n", F.row_number().over(order)).filter("_n = _rank").select(*keys, F.col("_v").alias("nth")), "ranked"))
        many = state.filter(F.col("_m") > most)
        if not many.take(1):
            break
        held = _beside(own, many, by).filter(inside)
        cuts = held.groupBy(*keys).agg(F.percentile_approx("_v", [k / CUTS for k in range(1, CUTS)], 1000).alias("_cuts"))
        cut = stored(_beside(many, cuts.withColumn("_cuts", F.array_sort(F.array_distinct("_cuts"))), keys), "rank-cuts")
        # An even part lies between two cuts, an odd one is a cut.
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        part = below * 2 + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = _beside(own, cut.select(*by, "name", "_lo", "_hi", "_cuts"), by).filter(inside).groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_c"))
        run = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")))  # at most twice as many rows as cuts
        at = _beside(run, cut, keys).filter((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_c") < F.col("_rank")))
        k = F.floor(F.col("_part") / 2).cast("int")
        edge = lambda i, other: F.coalesce(F.get("_cuts", i), F.col(other))
        state = stored(at.select(*keys, (F.col("_rank") - F.col("_to") + F.col("_c")).alias("_rank"), F.col("_c").alias("_m"), edge(k - 1, "_lo").alias("_lo"), edge(k, "_hi").alias("_hi"), (F.col("_part") % 2 == 1).alias("_met"), F.get("_cuts", k).alias("_cut")), "ranks")
        found.append(state.filter("_met").select(*keys, F.col("_cut").alias("nth")))
        state = state.filter("NOT _met").drop("_met", "_cut")
    return reduce(DataFrame.unionByName, found)


def share_rank(share: float) -> Callable[[Column], Column]:
    """The nearest rank of a share: ceil(share * n)."""
    return lambda n: F.ceil(n * share)


def _wide(found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("nth"))).alias(n) for n in names))


def summary(rows: DataFrame, value: str, by: list[str], sets: list[list[str]]) -> DataFrame:
    """The same metrics for every grouping in ``sets``; ``level`` says which columns were grouped away."""
    whole = rows.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    level = lambda s: sum(1 << (len(by) - 1 - k) for k, c in enumerate(by) if c not in s)
    one = lambda s: F.struct(F.lit(level(s)).cast("long").alias("level"), *((F.col(c) if c in s else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in by))
    spread = rows.select(F.explode(F.array(*map(one, sets))).alias("x"), F.col(value).alias("_value")).select("x.*", "_value")
    keys = ["level", *by]
    found = _wide(nth_values(spread, keys, "_value", {"p95": share_rank(0.95)}), keys, ["p95"])
    named = found.withColumnsRenamed({c: f"_{c}" for c in keys})
    return whole.join(named, _same(whole, named, keys), "left").select(*whole.columns, "p95")


def gates(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: every condition over all rows, and all of them together."""
    held = rows.agg(*(F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in conditions.items()))
    all_of = F.lit(True)
    for n in conditions:
        all_of = all_of & F.col(n)
    return held.withColumn("all_gates", all_of)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other has fewer of; empty if the multisets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def multiset_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both sides have, as often as the one that has fewer of them."""
    return a.intersectAll(b)


def set_overlap(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """For each key, how many of the distinct values of ``a`` are values of ``b`` too, and how many are not."""
    sets = rows.groupBy(key).agg(F.collect_set(a).alias("_a"), F.collect_set(b).alias("_b"))
    return sets.select(key, F.size(F.array_intersect("_a", "_b")).cast("long").alias("n_both"), F.size(F.array_except("_a", "_b")).cast("long").alias("n_left"))


def first_of(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their position; keys are compared one after another, never added up."""
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return placed.filter(F.col("position") <= k)


def dedup_by(rows: DataFrame, skeleton: Column, first: Column, name: str = "skeleton") -> DataFrame:
    """One row for each skeleton, with the smallest ``first`` of those that share it and how many they are."""
    return rows.groupBy(skeleton.alias(name)).agg(F.min(first).alias("first"), F.count("*").alias("n"))


def at_k(rows: DataFrame, k: int, by: str, order: list[Column], relevant: Column) -> DataFrame:
    """Precision and recall of the first ``k`` rows of each group; the others are counted, not ranked."""
    rows = rows.withColumn("_hit", relevant.cast("long"))
    whole = rows.groupBy(by).agg(F.count("*").alias("_n"), F.sum("_hit").alias("_all"))
    top = first_of(rows, by, order, k).groupBy(F.col(by).alias("_by")).agg(F.sum("_hit").alias("_top"))
    both = whole.join(top, F.col(by).eqNullSafe(F.col("_by")))
    hits = F.col("_top").cast("double")
    return both.select(by, (hits / F.least(F.lit(k), F.col("_n"))).alias("precision"), F.try_divide(hits, F.col("_all").cast("double")).alias("recall"))


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, median, largest value and number of each group's values, by exact selection."""
    ranks = {n: share_rank(s) for n, s in shares.items()} | {"_low": lambda n: F.ceil(n / 2), "_high": lambda n: F.floor(n / 2) + 1}
    found = _wide(nth_values(rows, [by], value, ranks), [by], list(ranks)).withColumnRenamed(by, "_by")
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    both = n.join(found, F.col(by).eqNullSafe(F.col("_by")), "left")
    return both.select(by, "n", *shares, ((F.col("_low") + F.col("_high")) / 2).alias("med"), "most")


def diversity_at(rows: DataFrame, k: int, by: str, order: list[Column], what: Column) -> DataFrame:
    """Of the first ``k`` rows of each group, the share that differ in ``what``."""
    top = first_of(rows.withColumn("_w", what), by, order, k)
    return top.groupBy(by).agg((F.count_distinct("_w") / F.count("*")).alias("diversity"))
