"""A fact store with a term dictionary: facts are longs, sorted twice, and joins compare nothing else.

Below a folder lie, as Parquet:

* ``terms`` (id, token): every term once. Ids run from 0 in the order of the tokens, so
  the smallest id is the smallest token, and files hold ranges of both. They are given by
  range partitions and their counts; no term passes through the driver.
* ``subjects`` and ``objects`` (g, s, p, o as ids): the facts in buckets of s and of o,
  in each bucket by predicate. A predicate, and a constant at either end, reaches the
  row groups that can hold it; a constant also picks its bucket. Joins of two predicates
  at their subjects find both sides in the same buckets and exchange nothing.
* ``predicates`` (p, n_facts, n_subjects, n_objects), ``classes`` (o, n) and
  ``characteristics`` (ps, n_subjects, facts): how many subjects have exactly the
  predicates ps, and how many facts of each. The compiler orders joins by them.

A term that holds more than a thousandth of all facts (a class, a hub) has the facts of
its bucket written by several tasks, as several files.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.errors import PolicyError
from factgraph.functions.terms import TYPE, Term
from factgraph.sources.facts import TOKEN, FactsTable, MappedTables, Relation
from factgraph.sources.shared import spread, stored

ID = "id"
#: Facts of a bucket, and tasks among which the facts of a hot term are dealt.
BUCKET_FACTS, SPLIT = 20_000_000, 16
#: How many files a task may write at once; without it, it sorts by file.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Bits of a code that say which template its number belongs to.
PLACE = 6
#: Facts of a task that gives them ids.
TASK_FACTS = 2_000_000
#: A term with more than one in so many facts is hot; there are fewer such terms than this.
HOT = 1000
#: A class or predicate of so many facts at most is broadcast to the joins at it: less than Spark's own bound of 10 MB.
SMALL = 400_000
#: How many facts have a term as subject, predicate, object, graph.
ROLES = ("n_s", "n_p", "n_o", "n_g")


def _hashed(token: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(token))


class TokenFacts:
    """A table of (s, p, o) or (g, s, p, o) tokens as what a store is built of. A term's code is a hash of its token."""

    def __init__(self, facts: DataFrame):
        self.facts, self.columns = facts, "gspo" if "g" in facts.columns else "spo"

    def terms(self) -> DataFrame:
        """token, code and in how many facts it has which role: every term once; codes of null are hashes of the token, given later."""
        ends = F.array(*(F.struct(F.col(c).alias("token"), *(F.lit(int(r == f"n_{c}")).cast("long").alias(r) for r in ROLES)) for c in self.columns))
        tokens = self.facts.select(F.explode(ends).alias("x")).select("x.*").filter("token IS NOT NULL")
        return grouped_terms(tokens)

    def coded(self, seed: int) -> DataFrame:
        """The facts, repeated ones too, with codes in place of tokens."""
        return self.facts.select(*(F.when(F.col(c).isNotNull(), _hashed(c, seed)).alias(c) for c in self.columns))


class KeyedFacts:
    """Relations and classes of mapped tables as what a store is built of, by their keys.

    The code of a number in an IRI template is that number and the template's place, so
    numbers are counted and dealt out, and a token is written once for each. Numbers
    without room for the place, and terms of other kinds, have hashes of their tokens.
    """

    def __init__(self, source: MappedTables, predicates: list[str], classes: list[str] = ()):
        self.source = source
        self.places = [n for n, t in source.templates.items() if t.kind == "long"][: 1 << PLACE]
        self.relations = [(p, None, source.relation(p)) for p in predicates]
        for c in classes:
            nodes, space = source.members(c)
            self.relations.append((TYPE, c, Relation(nodes.select(F.col("node").alias("src"), F.lit(f"<{c}>").alias("dst")), space, TOKEN)))

    def _fits(self, column: str, space: str) -> Column:
        room = 1 << (62 - PLACE)
        return F.col(column).between(-room, room) if space in self.places else F.lit(False)

    def _placed(self, column: str, space: str) -> Column:
        if space not in self.places:
            return F.lit(None).cast("long")
        return F.shiftleft(F.col(column).cast("long"), PLACE).bitwiseOR(F.lit(self.places.index(space)).cast("long"))

    def terms(self) -> DataFrame:
        keys, tokens = [], []
        for _, cls, r in self.relations:
            for column, space, s in (("src", r.src, True), ("dst", r.dst, False))[: 1 if cls else 2]:
                fits = self._fits(column, space)
                if space in self.places:
                    keys.append(r.rows.filter(fits).select(self._placed(column, space).alias("code"), F.lit(s).alias("_s")))
                counts = (F.lit(int(x)).cast("long").alias(c) for c, x in zip(ROLES, (s, 0, not s, 0), strict=True))
                tokens.append(r.rows.filter(~fits).select(self.source.render(F.col(column), space).alias("token"), *counts))
        # Predicates and classes, from the number of facts of each relation.
        none = F.lit(0).cast("long")
        for p, cls, r in self.relations:
            roles = F.array(*(F.struct(F.lit(f"<{x}>").alias("token"), none.alias("n_s"), (F.col("_n") if x is p else none).alias("n_p"), (none if x is p else F.col("_n")).alias("n_o"), none.alias("n_g")) for x in (p, cls) if x))
            tokens.append(r.rows.agg(F.count("*").alias("_n")).filter("_n > 0").select(F.explode(roles).alias("x")).select("x.*"))
        out = grouped_terms(reduce(DataFrame.unionByName, tokens))
        if not keys:
            return out
        each = spread(reduce(DataFrame.unionByName, keys), "code").groupBy("code").agg(F.count_if("_s").alias("n_s"), F.count_if(~F.col("_s")).alias("n_o"))
        each = stored(each, "keys")  # ranges of tokens read them twice
        heads = F.array(*(F.lit(f"<{self.source.templates[n].prefix}") for n in self.places))
        token = F.concat(F.get(heads, F.col("code").bitwiseAND((1 << PLACE) - 1).cast("int")), F.shiftright("code", PLACE).cast("string"), F.lit(">"))
        return out.unionByName(each.select(token.alias("token"), "code", "n_s", none.alias("n_p"), "n_o", none.alias("n_g")))

    def coded(self, seed: int) -> DataFrame:
        """The facts, repeated ones too, with codes in place of keys."""
        parts = []
        for p, _, r in self.relations:
            rows = r.rows.select("src", "dst", self.source.render(F.col("src"), r.src).alias("_s"), F.lit(f"<{p}>").alias("_p"), self.source.render(F.col("dst"), r.dst).alias("_o"))
            code = lambda c, space, token: F.when(self._fits(c, space), self._placed(c, space)).otherwise(_hashed(token, seed))
            parts.append(rows.select(code("src", r.src, "_s").alias("s"), _hashed("_p", seed).alias("p"), code("dst", r.dst, "_o").alias("o")))
        return reduce(DataFrame.unionByName, parts)


def grouped_terms(tokens: DataFrame) -> DataFrame:
    """Rows of (token, counts of ROLES) as terms whose codes are hashes."""
    return tokens.groupBy("token").agg(*(F.sum(c).alias(c) for c in ROLES)).select("token", F.lit(None).cast("long").alias("code"), *ROLES)


def number_terms(terms: DataFrame, parts: int, folder: str) -> tuple[DataFrame, int]:
    """Number ``terms`` (token, code, counts of ROLES) and write them below ``folder``, ids in the order of the tokens.

    Returns h, id and the counts of each, h the code or a hash, which no two terms share;
    and the seed of that hash.
    """
    spark = terms.sparkSession
    ranged = terms.repartitionByRange(parts, "token").sortWithinPartitions("token")
    ranged.select(F.monotonically_increasing_id().alias("_at"), "token", "code", *ROLES).write.option("compression", "zstd").parquet(f"{folder}/ranges")
    # _at is the range's number and the row in it.
    counts = ", ".join(f"{c} long" for c in ROLES)
    rows = spark.read.schema(f"_at long, token string, code long, {counts}").parquet(f"{folder}/ranges")
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    h = lambda seed: F.coalesce("code", _hashed("token", seed)).alias("h")
    seed = 0
    while rows.select(h(seed)).repartition(parts, "h").groupBy("h").count().filter("count > 1").take(1):
        seed += 1
    numbered = rows.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_row")).alias("id"), "token", h(seed), *ROLES)
    numbered.sortWithinPartitions("id").write.option("compression", "zstd").parquet(f"{folder}/terms")
    return spark.read.schema(f"id long, h long, {counts}").parquet(f"{folder}/terms"), seed


def _coded(facts: DataFrame, end: str, other: str, role: str, codes: DataFrame, total: int, parts: int, once: bool = False) -> DataFrame:
    """``facts`` with the id of a term in place of its code in column ``end``; ``once``: as a set.

    Facts are dealt by that code and find the terms in a hash table: nothing is sorted.
    Hot terms are broadcast, and their facts dealt by ``other`` instead, whether or not
    that meets some code.
    """
    own = codes.filter(F.col(role) > 0)
    hot = own.filter(F.col(role) * HOT > total).select(F.col("h").alias(end), F.col("id").alias("_hot"))
    rows = facts.join(F.broadcast(hot), end, "left").withColumn("_k", F.when(F.col("_hot").isNull(), F.col(end)).otherwise(F.col(other)))
    rows = rows.drop(end).repartition(parts, "_k")
    if once:
        rows = rows.distinct()
    met = rows.join(own.select(F.col("h").alias("_k"), F.col("id").alias("_id")).hint("shuffle_hash"), "_k", "left")
    return met.withColumn(end, F.coalesce("_hot", "_id")).drop("_k", "_hot", "_id")


def _write_order(facts: DataFrame, key: str, other: str, hot: DataFrame, buckets: int, path: str, table: str) -> None:
    """The facts in buckets of ``key``; those of a hot key are dealt among tasks by ``other``.

    A task meets few buckets and keeps their files open: facts are sorted once, by what
    they hold, and not by their bucket first, which would be computed in each comparison.
    """
    salted = facts.join(F.broadcast(hot.select(F.col("id").alias(key), F.lit(True).alias("_hot"))), key, "left")
    deal = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.hash(other), F.lit(SPLIT)))
    dealt = salted.repartitionById(buckets, F.pmod(F.pmod(F.hash(key), F.lit(buckets)) + deal, F.lit(buckets)))
    write = dealt.select("g", "s", "p", "o").sortWithinPartitions("p", key, other).write.bucketBy(buckets, key)
    conf, before = facts.sparkSession.conf, facts.sparkSession.conf.get(OPEN_FILES)
    conf.set(OPEN_FILES, str(SPLIT))
    try:
        write.option("path", path).option("compression", "zstd").mode("errorifexists").saveAsTable(table)
    finally:
        conf.set(OPEN_FILES, before)


def build_store(facts: DataFrame | TokenFacts | KeyedFacts, folder: str, buckets: int | None = None) -> None:
    """Write facts, a table of (s, p, o) or (g, s, p, o) tokens or what answers like TokenFacts, as a store below ``folder``, a new one.

    Facts are a set; repeated ones are one. ``facts`` is read twice. A fact is dealt out
    by its subject and by its object, as codes, to get their ids, and then once for each
    order; all counts come from the buckets as they lie. As many tasks do it as facts ask for.
    """
    facts = TokenFacts(facts) if isinstance(facts, DataFrame) else facts
    terms = facts.terms()
    spark = terms.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes, seed = number_terms(terms, parts, folder)
    total, n_p = codes.agg(F.coalesce(F.sum("n_s"), F.lit(0)), F.count_if(F.col("n_p") > 0)).first()  # repeated facts included
    parts = max(parts, math.ceil(total / TASK_FACTS))
    predicates = codes.filter("n_p > 0")  # one row a predicate
    rows = facts.coded(seed)
    named = "g" in rows.columns
    rows = rows.join(F.broadcast(predicates.select(F.col("h").alias("p"), F.col("id").alias("_p"))), "p", "left").drop("p").withColumnRenamed("_p", "p")
    rows = _coded(rows, "s", "o", "n_s", codes, total, parts, once=True)
    rows = _coded(rows, "o", "s", "n_o", codes, total, parts)
    if named:
        inside = _coded(rows.filter("g IS NOT NULL"), "g", "s", "n_g", codes, total, parts)
        rows = rows.filter("g IS NULL").unionByName(inside)
    else:
        rows = rows.withColumn("g", F.lit(None).cast("long"))
    buckets = buckets or max(parts, math.ceil(total / BUCKET_FACTS))
    hot = lambda role: codes.filter(F.col(role) * HOT > total)
    _write_order(rows, "o", "s", hot("n_o"), buckets, f"{folder}/objects", _table(folder, "objects"))
    objects = spark.table(_table(folder, "objects"))
    _write_order(objects, "s", "o", hot("n_s"), buckets, f"{folder}/subjects", _table(folder, "subjects"))
    spark.range(1).coalesce(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/layout")
    _write_characteristics(spark.table(_table(folder, "subjects")), predicates, n_p, f"{folder}/characteristics")
    held = spark.read.schema("ps array<long>, n_subjects long, facts array<long>").parquet(f"{folder}/characteristics")
    held = held.select("n_subjects", F.explode(F.arrays_zip("ps", "facts")).alias("x")).groupBy(F.col("x.ps").alias("p")).agg(F.sum("x.facts").alias("n_facts"), F.sum("n_subjects").alias("n_subjects"))
    values = objects.groupBy("o", "p").agg(F.count("*").alias("n")).groupBy("p").agg(F.count("*").alias("n_objects"))
    held.join(values, "p").write.parquet(f"{folder}/predicates")
    kind = spark.read.schema("id long, token string").parquet(f"{folder}/terms").filter(F.col("token") == f"<{TYPE}>").select(F.col("id").alias("p"))
    objects.join(F.broadcast(kind), "p", "left_semi").groupBy("o").agg(F.count("*").alias("n")).write.parquet(f"{folder}/classes")


def _write_characteristics(subjects: DataFrame, predicates: DataFrame, n_p: int, path: str) -> None:
    """Sets of predicates, their subjects and facts: a subject's set is a row of bits, 62 to a long, beside each of its predicates."""
    at = F.broadcast(predicates.select(F.col("id").alias("p"), (F.row_number().over(Window.orderBy("id")) - 1).alias("_at")))  # one row a predicate
    own = subjects.groupBy("s", "p").agg(F.count("*").alias("n")).join(at, "p")
    bits = [f"_b{k}" for k in range(max(1, math.ceil(n_p / 62)))]
    bit = lambda k: F.when(F.floor(F.col("_at") / 62) == k, F.expr("shiftleft(1L, CAST(_at % 62 AS int))")).otherwise(F.lit(0).cast("long"))
    own = own.select("p", "n", *(F.bit_or(bit(k)).over(Window.partitionBy("s")).alias(b) for k, b in enumerate(bits)))
    by = own.groupBy(*bits, "p").agg(F.count("*").alias("n_subjects"), F.sum("n").alias("n"))
    sets = by.groupBy(*bits).agg(F.max("n_subjects").alias("n_subjects"), F.array_sort(F.collect_list(F.struct("p", "n"))).alias("x"))
    sets.select(F.col("x.p").alias("ps"), "n_subjects", F.col("x.n").alias("facts")).write.parquet(path)


def _table(folder: str, name: str) -> str:
    return f"facts_{name}_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"


@dataclass(frozen=True)
class Counts:
    """What is known of a predicate."""

    facts: int
    subjects: int
    objects: int


class StoredFacts:
    """A store as a source of facts. All keys are ids of one space; constants the store does not have get ids below 0."""

    def __init__(self, spark: SparkSession, folder: str, graphs: tuple[str, ...] = ()):
        self.spark, self.folder, self.graphs = spark, folder, graphs
        self.terms = spark.read.schema("id long, token string").parquet(f"{folder}/terms")
        buckets = spark.read.parquet(f"{folder}/layout").first().buckets
        self.orders = {k: self._open(k, key, buckets) for k, key in (("subjects", "s"), ("objects", "o"))}
        self.known: dict[str, int] = {}
        self.counted: dict[int, Counts] | None = None
        self.sizes: dict[str, int] = {}

    def _open(self, name: str, key: str, buckets: int) -> DataFrame:
        table = _table(self.folder, name)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (g BIGINT, s BIGINT, p BIGINT, o BIGINT) USING parquet CLUSTERED BY ({key}) SORTED BY (p, {key}, {'o' if key == 's' else 's'}) INTO {buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(table)

    # Constants

    def ids(self, tokens: list[str]) -> list[int]:
        """Ids of a plan's constants, looked up once each."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.known]
        if new:
            self.known |= {r.token: r.id for r in self.terms.filter(F.col("token").isin(new)).collect()}  # at most the constants asked for
            for t in new:
                if t not in self.known:
                    self.known[t] = -1 - sum(v < 0 for v in self.known.values())
        return [self.known[t] for t in tokens]

    def key(self, term: Term, space: str) -> int:
        return self.ids([term.token])[0]

    def own_space(self) -> tuple[str, str]:
        return ID, "bigint"

    # Facts

    def _scoped(self, order: str) -> DataFrame:
        rows = self.orders[order]
        if self.graphs:
            return rows.filter(F.col("g").isin(self.ids([f"<{g}>" for g in self.graphs])))
        return rows.filter(F.col("g").isNull())

    def relation(self, predicate: str, known: str = "") -> Relation:
        """Pairs of a predicate; ``known`` names the end (src or dst) that will be a constant or joined, and so the order to read."""
        (p,) = self.ids([f"<{predicate}>"])
        rows = self._scoped("objects" if known == "dst" else "subjects").filter(F.col("p") == p).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        rows = rows.distinct() if len(self.graphs) > 1 else rows
        return Relation(F.broadcast(rows) if self.counts(predicate).facts <= SMALL else rows, ID, ID)

    def members(self, cls: str) -> tuple[DataFrame, str]:
        """Nodes of a class: few of them from the class's bucket, else each from its own, where its facts are."""
        p, o = self.ids([f"<{TYPE}>", f"<{cls}>"])
        small = self.class_size(cls) <= SMALL
        rows = self._scoped("objects" if small else "subjects").filter((F.col("p") == p) & (F.col("o") == o)).select(F.col("s").alias("node"))
        rows = rows.distinct() if len(self.graphs) > 1 else rows
        return (F.broadcast(rows) if small else rows), ID

    def tokens(self, rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
        """``rows`` with tokens of id columns, by their names: a join with the terms for each."""
        fixed = {v: t for t, v in self.known.items() if v < 0}
        for c, (name, _) in columns.items():
            rows = rows.join(self.terms.select(F.col("id").alias(c), F.col("token").alias(name)), c, "left")
            if fixed:
                own = F.create_map(*(x for v, t in fixed.items() for x in (F.lit(v).cast("long"), F.lit(t))))
                rows = rows.withColumn(name, F.coalesce(F.col(name), F.element_at(own, F.col(c))))
        return rows

    def render(self, column: Column, space: str) -> Column:
        raise PolicyError("ids become tokens by a join only")

    def as_tokens(self) -> FactsTable:
        """The same facts as tokens, for evidence."""
        rows = self.orders["subjects"]
        for c in "gspo":
            rows = rows.join(self.terms.select(F.col("id").alias(c), F.col("token").alias(f"_{c}")), c, "left")
        return FactsTable(rows.select(*(F.col(f"_{c}").alias(c) for c in "gspo")), self.graphs)

    # Statistics

    def counts(self, predicate: str) -> Counts:
        """Facts, subjects and objects of a predicate, from the table of all predicates."""
        if self.counted is None:
            rows = self.spark.read.parquet(f"{self.folder}/predicates").collect()  # one row a predicate
            self.counted = {r.p: Counts(r.n_facts, r.n_subjects, r.n_objects) for r in rows}
        return self.counted.get(self.ids([f"<{predicate}>"])[0], Counts(0, 0, 0))

    def class_size(self, cls: str) -> int:
        """Facts that give a node this class."""
        if cls not in self.sizes:
            got = self.spark.read.parquet(f"{self.folder}/classes").filter(F.col("o") == self.ids([f"<{cls}>"])[0]).first()
            self.sizes[cls] = got.n if got else 0
        return self.sizes[cls]

    def star(self, predicates: list[str]) -> tuple[int, float]:
        """How many subjects have all predicates, and how many rows their star has (values taken as independent in a set)."""
        want = self.ids([f"<{p}>" for p in predicates])
        rows = self.spark.read.parquet(f"{self.folder}/characteristics")
        held = rows.filter(F.size(F.array_intersect("ps", F.array(*map(F.lit, set(want))))) == len(set(want)))
        each = F.lit(1.0)
        for p in want:
            each = each * F.element_at("facts", F.array_position("ps", p).cast("int")) / F.col("n_subjects")
        got = held.agg(F.sum("n_subjects").alias("n"), F.sum(F.col("n_subjects") * each).alias("rows")).first()
        return got.n or 0, got.rows or 0.0
