"""Canonical plans as lazy DataFrames.

Each entity is a column of keys, or a constant where the plan binds it: a bound
entity never costs a join but a filter at the scan. Conditions whose values are not
returned (selectors on a joined entity, value classes, equality, existence, edges that
close a cycle) are semi-joins, so they never multiply rows. Atoms are taken in a
connected order, constants first; no plan has a Cartesian product.

Where the source counts its facts, joins are ordered by what they are expected to give:
the edge with the fewest rows first, its ends' own conditions included, then always the
edge that grows the result least. Elsewhere constants come first, then edges that are
followed from the subjects of their facts.

Contracts that do not filter are observed where a field is joined: the scan that gives
its values says whether their entity has several, so a checked result needs no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.errors import PolicyError
from factgraph.functions.terms import Term, digest, effective_datatype, kind_allowed, token_kind
from factgraph.plans.catalog import Branch, Catalog, Property
from factgraph.plans.query import Plan, QueryPolicy
from factgraph.sources.facts import TOKEN, Relation


@dataclass(frozen=True)
class Compiled:
    """A plan's lazy result: ``rows`` has the columns of ``public`` and ``entities`` as tokens, distinct."""

    plan: Plan
    public: tuple[str, ...]
    entities: tuple[str, ...]
    query_digest: str
    nodes: int
    builder: Callable[[bool], "_Builder"]

    @cached_property
    def _plain(self) -> "_Builder":
        return self.builder(False)

    @cached_property
    def _checking(self) -> "_Builder":
        return self.builder(True)

    @property
    def rows(self) -> DataFrame:
        return self._plain.result

    @property
    def checked(self) -> DataFrame:
        """``rows`` with the key of each free entity and field (KEY), and for each field whether its
        entity has several values (MANY) and whether this one is outside the contract (BAD)."""
        return self._checking.result

    @property
    def spaces(self) -> dict[str, str]:
        """Key spaces of the free entities and fields of ``checked``."""
        return self._checking.space

    @property
    def order(self) -> tuple[str, ...]:
        """Predicates of the edges in the order in which they are joined."""
        return tuple(self._plain.order)


#: Before an id: names of the further columns of a checked result.
KEY, MANY, BAD = "_key_", "_many_", "_bad_"
TOKENS = "_token_"


def accepts(token: Column, branch: Branch) -> Column:
    """Branch.accepts() as a column: whether a term meets everything but class membership."""
    out = kind_allowed(token, branch.node_kinds)
    if branch.allowed:
        out = out & token.isin(*(t.token for t in branch.allowed))
    if branch.datatypes:
        out = out & F.coalesce(effective_datatype(token).isin(*branch.datatypes), F.lit(False))
    return out & (token_kind(token) == "iri") if branch.classes else out


def oriented(source, prop: Property, known: str = "") -> Relation:
    """Pairs as the property reads them; ``known`` names the end (src or dst) by which they are looked up, for sources that hold several orders."""
    if known and hasattr(source, "orders"):
        r = source.relation(prop.predicate, {"src": "dst", "dst": "src"}[known] if prop.inverse else known)
    else:
        r = source.relation(prop.predicate)
    if not prop.inverse:
        return r
    return Relation(r.rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")), r.dst, r.src)


def count_nodes(plan: Plan, catalog: Catalog) -> int:
    """Patterns of the plan; optional blocks and alternatives count themselves and their parts."""
    n = sum(e.binding is not None for e in plan.entities)
    for u in plan.selectors:
        s = catalog.selector(u.key)
        n += 2 * bool(s.classes) + bool(s.targets) + (s.kind == "union")

    def contract(b: Branch) -> int:
        return len(b.classes) + bool(b.allowed)

    for e in plan.edges:
        n += 1 + contract(catalog.property(e.property_key).branch(e.branch_key))
    for f in plan.filters:
        n += 1 if f.kind == "exists" else 2 + len(catalog.property(f.property_key).branch(f.branch_key).classes)
    for p in plan.projections:
        if p.kind == "field":
            n += 1 + contract(catalog.property(p.property_key).branch(p.branch_key)) + (not p.required)
    return n


class _Builder:
    def __init__(self, spark: SparkSession, source, catalog: Catalog, plan: Plan, checked: bool = False):
        self.spark, self.source, self.catalog, self.plan, self.checked = spark, source, catalog, plan, checked
        self.df: DataFrame | None = None
        self.space: dict[str, str] = {}
        self.bound = {e.id: e.binding for e in plan.entities if e.binding}
        self.serial = 0
        self.order: list[str] = []
        self.count: float | None = None  # about how many rows there are, over sources that count facts
        self.lens_entity = {u.id: u.entity for u in plan.lenses}
        self.result = self.run()

    # Comparable columns of two key spaces; None if they can never be equal.
    def meet(self, a: Column, a_space: str, b: Column, b_space: str) -> tuple[Column, Column] | None:
        if a_space == b_space:
            return a, b
        if TOKEN in (a_space, b_space):
            return self.source.render(a, a_space), self.source.render(b, b_space)
        return None

    def none(self, df: DataFrame) -> DataFrame:
        return df.filter(F.lit(False))

    def equal(self, df: DataFrame, column: str, space: str, term: Term) -> DataFrame:
        key = self.source.key(term, space)
        return self.none(df) if key is None else df.filter(F.col(column) == F.lit(key))

    def among(self, df: DataFrame, column: str, space: str, terms: tuple[Term, ...]) -> DataFrame:
        keys = [k for t in terms if (k := self.source.key(t, space)) is not None]
        return df.filter(F.col(column).isin(keys)) if keys else self.none(df)

    def of_class(self, df: DataFrame, column: str, space: str, cls: str) -> DataFrame:
        nodes, node_space = self.source.members(cls)
        return self.semi(df, [(column, space, "node", node_space)], nodes)

    def semi(self, df: DataFrame, on: list[tuple[str, str, str, str]], other: DataFrame) -> DataFrame:
        self.serial += 1
        names, made = [], {}
        for k, (mine, space, theirs, their_space) in enumerate(on):
            both = self.meet(F.col(mine), space, F.col(theirs), their_space)
            if both is None:
                return self.none(df)
            made[f"_k{self.serial}_{k}"] = both
        names = list(made)
        left = df.withColumns({n: v[0] for n, v in made.items()})
        return left.join(other.select(*(v[1].alias(n) for n, v in made.items())), names, "left_semi").drop(*names)

    def contract(self, df: DataFrame, column: str, space: str, branch: Branch) -> DataFrame:
        for cls in branch.classes:
            df = self.of_class(df, column, space, cls)
        return self.among(df, column, space, branch.allowed) if branch.allowed else df

    def keep(self, entity: str, nodes: DataFrame) -> None:
        """Rows whose ``entity`` is one of ``nodes``, each there once. The optimizer would push a semi-join down to all facts of an edge."""
        self.df = self.df.join(nodes.select(F.col("node").alias(entity)), entity)

    def given(self, df: DataFrame, facts: DataFrame) -> DataFrame:
        """``df`` if ``facts`` has a row, else nothing."""
        self.serial += 1
        name = f"_g{self.serial}"
        return df.withColumn(name, F.lit(1)).join(facts.limit(1).select(F.lit(1).alias(name)), name, "left_semi").drop(name)

    def base(self) -> DataFrame:
        if self.df is None:
            self.df = self.spark.range(1).select()
        return self.df

    def selected(self, key: str) -> tuple[DataFrame, str]:
        """Nodes of a selector and their key space."""
        s = self.catalog.selector(key)
        parts = [self.source.members(c) for c in s.classes]
        spaces = {sp for _, sp in parts}
        targets = [Term("iri", t) for t in s.targets]
        own, own_kind = self.source.own_space()
        space = spaces.pop() if len(spaces) == 1 and all(self.source.key(t, parts[0][1]) is not None for t in targets) else own
        frames = [df.select((F.col("node") if sp == space else self.source.render(F.col("node"), sp)).alias("node")) for df, sp in parts]
        if targets:
            kind = frames[0].schema["node"].dataType.simpleString() if frames else own_kind
            keys = [(self.source.key(t, space),) for t in targets]
            frames.append(self.spark.createDataFrame(keys, f"node {kind}"))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return (out.distinct() if len(frames) > 1 else out), space

    def run(self) -> DataFrame:
        uses = {u.entity: u for u in self.plan.selectors}
        edges = list(self.plan.edges)
        lens_entity = self.lens_entity
        filters_of: dict[str, list] = {}
        for f in self.plan.filters:
            filters_of.setdefault(lens_entity[f.lens], []).append(f)

        def settle(entity: str) -> None:
            """Conditions on an entity that is known now."""
            if (u := uses.pop(entity, None)) is not None:
                nodes, space = self.selected(u.key)
                if entity in self.bound:
                    self.df = self.given(self.base(), self.equal(nodes, "node", space, self.bound[entity]))
                elif hasattr(self.source, "counts") and self.catalog.selector(u.key).classes:
                    self.keep(entity, nodes)
                else:
                    self.df = self.semi(self.df, [(entity, self.space[entity], "node", space)], nodes)
            for f in filters_of.pop(entity, ()):
                self.filter(f, entity)

        for e in list(self.bound):
            settle(e)
        while edges:
            edge = self.next_edge(edges)
            edges.remove(edge)
            self.order.append(self.catalog.property(edge.property_key).predicate)
            ends = self.ends
            if not self.space and not any(map(self.is_known, ends(edge))) and (start := next((e for e in ends(edge) if e in uses), None)):
                self.start(start, uses.pop(start))
                settle(start)
            self.edge(edge, *ends(edge))
            for e in ends(edge):
                settle(e)
        for e in list(uses):  # one entity, no edge
            u = uses.pop(e)
            self.start(e, u)
            settle(e)
        self.df = self.base()
        for p in self.plan.projections:
            if p.kind == "field":
                self.field(p, lens_entity[p.lens])
        names = [p.id for p in self.plan.projections] + [e.id for e in self.plan.entities]
        # Rows are told apart by their keys; tokens are written afterwards.
        keys = list(self.space)
        fields = [p for p in self.plan.projections if p.kind == "field"] if self.checked else []
        held = self.df.select(*keys, *(MANY + p.id for p in fields)).distinct() if keys else self.df.limit(1)
        held = self.source.tokens(held, {k: (TOKENS + k, s) for k, s in self.space.items()})
        out = {e.id: F.lit(e.binding.token) if e.binding else F.col(TOKENS + e.id) for e in self.plan.entities}
        out |= {p.id: out[p.entity] if p.kind == "node" else F.col(TOKENS + p.id) for p in self.plan.projections}
        if not self.checked:
            return held.select(*(out[n].alias(n) for n in names))
        more = [F.col(k).alias(KEY + k) for k in keys]
        for p in fields:
            branch = self.catalog.property(p.property_key).branch(p.branch_key)
            more += [F.coalesce(MANY + p.id, F.lit(False)).alias(MANY + p.id), F.coalesce(~accepts(out[p.id], branch), F.lit(False)).alias(BAD + p.id)]
        return held.select(*(out[n].alias(n) for n in names), *more)

    def ends(self, edge) -> tuple[str, str]:
        return self.lens_entity[edge.source_lens], edge.target_entity

    def is_known(self, entity: str) -> bool:
        return entity in self.bound or entity in self.space

    def next_edge(self, edges: list):
        """The edge to join next; what is there already stays connected."""
        known, ends = self.is_known, self.ends
        near = [x for x in edges if all(map(known, ends(x))) or any(e in self.space for e in ends(x))] if self.space else edges
        if hasattr(self.source, "counts"):
            if self.space:
                return min(near or edges, key=lambda x: (self.growth(x), x.id))
            return min(edges, key=lambda x: (self.cost(x, edges), self.growth(x), x.id))
        conditions = {u.entity for u in self.plan.selectors} | {self.lens_entity[f.lens] for f in self.plan.filters}

        def subject(x) -> str:
            return ends(x)[self.catalog.property(x.property_key).inverse]

        # Both ends known, then those at a constant, then those at a column. Facts are followed from their subjects
        # where they can be: a subject has few values, but a value may have a great share of all subjects.
        rank = lambda x: (
            not all(map(known, ends(x))),
            not any(e in self.bound for e in ends(x)),
            not any(e in self.space for e in ends(x)),
            subject(x) not in (self.space or conditions),
            not any(e in conditions and not known(e) for e in ends(x)),
            x.id,
        )
        return min(near or edges, key=rank)

    def size(self, entity: str) -> float | None:
        """About how many nodes meet an entity's own conditions; None if it has none."""
        if entity in self.bound:
            return 1.0
        sizes = []
        for u in self.plan.selectors:
            if u.entity == entity:
                s = self.catalog.selector(u.key)
                sizes.append(float(sum(map(self.source.class_size, s.classes)) + len(s.targets)))
        for f in self.plan.filters:
            if self.lens_entity[f.lens] == entity:
                prop = self.catalog.property(f.property_key)
                facts, sources, values = self.sides(prop)
                sizes.append(facts / max(values, 1) if f.kind == "eq" else float(sources))
        return min(sizes) if sizes else None

    def sides(self, prop: Property) -> tuple[int, int, int]:
        """Facts of a property, and how many nodes it leads from and to."""
        c = self.source.counts(prop.predicate)
        return (c.facts, c.objects, c.subjects) if prop.inverse else (c.facts, c.subjects, c.objects)

    def growth(self, edge) -> float:
        """Rows an edge gives for each row that is there, or by itself if there is none; 0 if it only filters."""
        (source, target), (facts, sources, values) = self.ends(edge), self.sides(self.catalog.property(edge.property_key))
        if self.is_known(source) and self.is_known(target):
            return 0.0
        out = float(facts)
        for e, n in ((source, sources), (target, values)):
            if e in self.space:
                out /= max(n, 1)
            elif (size := self.size(e)) is not None:
                out *= min(1.0, size / max(n, 1))
        return out

    def cost(self, first, edges: list) -> float:
        """About how many rows there are after each of ``edges``, summed, if ``first`` is joined first."""
        left, rows, total, self.space = list(edges), 1.0, 0.0, {}
        edge = first
        while True:
            left.remove(edge)
            rows *= self.growth(edge) or 1.0
            total += rows
            self.space |= {e: "" for e in self.ends(edge) if e not in self.bound}
            if not left:
                self.space = {}
                return total
            edge = self.next_edge(left)

    def grown(self, edge, known: str) -> bool:
        """Count the rows that an edge gives; whether there are no more before it than nodes at its ``known`` end."""
        if not hasattr(self.source, "counts"):
            return False
        _, sources, values = self.sides(self.catalog.property(edge.property_key))
        few = self.count is not None and self.count <= {"src": sources, "dst": values}.get(known, 0)
        growth = self.growth(edge)
        if growth:
            self.count = growth if self.count is None else self.count * growth
        return few

    def start(self, entity: str, use) -> None:
        nodes, self.space[entity] = self.selected(use.key)
        if hasattr(self.source, "counts"):
            self.count = self.size(entity)
        self.df = nodes.select(F.col("node").alias(entity)) if self.df is None else self.df.crossJoin(nodes.select(F.col("node").alias(entity)))

    def edge(self, edge, source: str, target: str) -> None:
        prop = self.catalog.property(edge.property_key)
        known = next((end for held in (self.bound, self.space) for end, e in (("src", source), ("dst", target)) if e in held), "")
        r, branch = oriented(self.source, prop, known), prop.branch(edge.branch_key)
        # Where there are fewer rows than nodes that the facts could be met at, the facts are looked up first and lie as they are.
        late = self.grown(edge, known) and (source in self.space) != (target in self.space) and not {source, target} & self.bound.keys()
        rows = r.rows if late else self.contract(r.rows, "dst", r.dst, branch)
        ends, new = [("src", r.src, source), ("dst", r.dst, target)], []
        if source == target:
            both = self.meet(F.col("src"), r.src, F.col("dst"), r.dst)
            rows, ends = (self.none(rows) if both is None else rows.filter(both[0] == both[1])), ends[:1]
        for column, space, e in ends:
            if e in self.bound:
                rows = self.equal(rows, column, space, self.bound[e])
        free = [x for x in ends if x[2] not in self.bound]
        if not free:
            self.df = self.given(self.base(), rows)
            return
        new = [x for x in free if x[2] not in self.space]
        old = [x for x in free if x[2] in self.space]
        if not new:
            self.df = self.semi(self.df, [(e, self.space[e], c, s) for c, s, e in old], rows)
            return
        if not old:
            fresh = rows.select(*(F.col(c).alias(e) for c, _, e in new)).distinct()
            self.df = fresh if self.df is None else self.given(fresh, self.df)
        else:
            (column, space, e), = old
            both = self.meet(F.col(e), self.space[e], F.col(column), space)
            side = rows.select(*(F.col(c).alias(n) for c, _, n in new), F.lit(0).alias("_j") if both is None else both[1].alias("_j"))
            left = self.none(self.df).withColumn("_j", F.lit(0)) if both is None else self.df.withColumn("_j", both[0])
            self.df = left.join(side, "_j").drop("_j")
        for _, s, e in new:
            self.space[e] = s
        if late:
            for cls in branch.classes:
                self.keep(target, self.source.members(cls)[0])
            if branch.allowed:
                self.df = self.among(self.df, target, r.dst, branch.allowed)

    def filter(self, f, entity: str) -> None:
        prop = self.catalog.property(f.property_key)
        r = oriented(self.source, prop, "src" if entity in self.bound else "dst" if f.kind == "eq" else "")
        rows = r.rows
        if f.kind == "eq":
            rows = self.equal(rows, "dst", r.dst, f.value)
            for cls in prop.branch(f.branch_key).classes:
                nodes, space = self.source.members(cls)
                rows = self.given(rows, self.equal(nodes, "node", space, f.value))
        if entity in self.bound:
            self.df = self.given(self.base(), self.equal(rows, "src", r.src, self.bound[entity]))
        elif hasattr(self.source, "counts") and f.kind == "eq":
            self.keep(entity, rows.select(F.col("src").alias("node")))
        else:
            self.df = self.semi(self.df, [(entity, self.space[entity], "src", r.src)], rows)

    def field(self, p, entity: str) -> None:
        prop = self.catalog.property(p.property_key)
        branch = prop.branch(p.branch_key)
        r = oriented(self.source, prop, "src" if entity in self.bound else "")
        rows, names = r.rows, [p.id]
        if entity in self.bound:
            rows = self.equal(rows, "src", r.src, self.bound[entity])
        if self.checked:
            several = Window.partitionBy("src")
            names.append(MANY + p.id)
            rows = rows.withColumn(names[1], F.min("dst").over(several) < F.max("dst").over(several))
        fit = self.contract(rows, "dst", r.dst, branch).withColumnRenamed("dst", p.id)
        if self.checked and not p.required and (branch.classes or branch.allowed):
            # An entity with several values is told even if none of them fits.
            fit = fit.unionByName(rows.filter(names[1]).withColumn(p.id, F.lit(None).cast(rows.schema["dst"].dataType)).select("src", *names))
        how = "inner" if p.required else "left"
        self.space[p.id] = r.dst
        if entity in self.bound:
            # The values of one entity, all of them: a condition on constants has no key to join by.
            self.df = self.df.join(fit.select(*names).distinct(), F.lit(True), how)
            return
        both = self.meet(F.col(entity), self.space[entity], F.col("src"), r.src)
        if both is None:
            fit, both = self.none(fit), (F.col(entity).cast("string"), F.col("src").cast("string"))
        self.df = self.df.withColumn("_j", both[0]).join(fit.select(both[1].alias("_j"), *names), "_j", how).drop("_j")


def compile_plan(spark: SparkSession, source, catalog: Catalog, plan: Plan, policy: QueryPolicy) -> Compiled:
    """``plan`` must be validated and canonical."""
    nodes = count_nodes(plan, catalog)
    if nodes > policy.max_nodes:
        raise PolicyError("plan has more patterns than the policy allows")
    public, entities = tuple(p.id for p in plan.projections), tuple(e.id for e in plan.entities)
    query = digest("query", {"plan": plan.digest, "columns": [*public, *entities]})
    return Compiled(plan, public, entities, query, nodes, lambda checked: _Builder(spark, source, catalog, plan, checked))
