"""What supports a result: witness facts, certificates and their checks, as columns of the result.

``certified`` gives every row of a result, however many there are, its key, a support for
each atom of the plan and the id of its certificate; ``faults`` checks rows and
certificates that may come from anywhere against plan and data, and returns every fault.
The engine uses both on the bounded rows of an execution.

What a row asserts fixes most of its witnesses: they are written down from the row, not
looked up, and it is the check that asks the data for them, in one anti-join for each
predicate or class. Only what the row leaves open is joined: the smallest value of a
property that must exist, the smallest class of a selector that has several. So evidence
does not depend on execution order, and no row is gathered from parts.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.errors import EvidenceError
from factgraph.functions.terms import TYPE, Term, canonical_json, digest, digest_sql, json_sql, sql_text, term_json_sql
from factgraph.plans.catalog import Catalog, Property
from factgraph.plans.compiler import KEY, Compiled, oriented
from factgraph.sources.facts import FactsTable


@dataclass(frozen=True)
class Witness:
    id: str
    execution_id: str
    atom: str
    subject: Term
    predicate: str
    object: Term
    assertion: str = "unknown"


@dataclass(frozen=True)
class Support:
    kind: str
    atom: str
    status: str
    witnesses: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()


@dataclass(frozen=True)
class ResultRow:
    key: str
    values: tuple[Term | None, ...]
    bindings: tuple[tuple[str, Term], ...]


@dataclass(frozen=True)
class Certificate:
    id: str
    execution_id: str
    plan_digest: str
    query_digest: str
    row_key: str
    bindings: tuple[tuple[str, Term], ...]
    supports: tuple[Support, ...]


@dataclass(frozen=True)
class Packet:
    execution_id: str
    catalog_revision: str
    policy_revision: str
    authorization_digest: str
    dataset_digest: str
    plan_digest: str
    request_digest: str
    query_digest: str
    result_kind: str
    row_count: int
    boolean: bool | None
    more: bool
    completed: bool
    completeness: str
    witnesses: tuple[Witness, ...] = ()
    certificates: tuple[Certificate, ...] = ()
    id: str = ""

    def sealed(self) -> "Packet":
        return replace(self, id=self.own_id())

    def own_id(self) -> str:
        names = "execution_id query_digest result_kind row_count boolean more completed completeness".split()
        return digest("query-result", {n: getattr(self, n) for n in names})


def packet_record(packet: Packet) -> dict:
    """A packet as plain JSON data."""
    return asdict(packet)


def packet_supports(spark: SparkSession, packet: Packet) -> DataFrame:
    """row_key, certificate, atom, kind, status, witness, s, p, o of every support, to be written as any table; bounded by the result's rows."""
    by_id = {w.id: w for w in packet.witnesses}
    rows = []
    for c in packet.certificates:
        for x in c.supports:
            for i in x.witnesses or (None,):
                w = by_id.get(i)
                rows.append((c.row_key, c.id, x.atom, x.kind, x.status, i, *((w.subject.token, w.predicate, w.object.token) if w else (None,) * 3)))
    return spark.createDataFrame(rows, "row_key string, certificate string, atom string, kind string, status string, witness string, s string, p string, o string")


def row_key(values: tuple[Term | None, ...], bindings: tuple[tuple[str, Term], ...]) -> str:
    return digest("row", [[v and v.json() for v in values], [[e, t.json()] for e, t in bindings]])


def make_row(values: list[str | None], bindings: list[tuple[str, str]]) -> ResultRow:
    vs = tuple(None if v is None else Term.parse(v) for v in values)
    bs = tuple((e, Term.parse(t)) for e, t in bindings)
    if any(t.kind != "iri" for _, t in bs):
        raise EvidenceError("an entity of the result is no IRI")
    return ResultRow(row_key(vs, bs), vs, bs)


def witness_id(execution: str, atom: str, s: Term, p: str, o: Term) -> str:
    return digest("witness", [execution, atom, s.token, p, o.token])


# Expressions over rows are SQL text: there are many of them, and one call takes them all to Spark.


@dataclass(frozen=True)
class Token:
    """A token of a row: its text and its JSON spelling, as SQL."""

    text: str
    json: str


#: Before a column's name: the JSON spelling of its token.
JSON = "_json_"


def of_row(name: str) -> Token:
    return Token(f"`{name}`", f"`{JSON}{name}`")


def fixed(token: str) -> Token:
    return Token(sql_text(token), sql_text(canonical_json(token)))


def spelled(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the JSON spelling of token columns."""
    return rows.selectExpr("*", *(f"{json_sql(f'`{n}`')} AS `{JSON}{n}`" for n in names))


@dataclass(frozen=True)
class Step:
    """A fact that an atom needs: of a property from a node to a value (None: any), or of a node to one of some classes."""

    node: Token
    prop: Property | None = None
    value: Token | None = None
    classes: tuple[str, ...] = ()
    entity: str = ""


@dataclass(frozen=True)
class Atom:
    """What must support an atom of a plan; ``derived`` and ``unbound`` say when it needs no facts."""

    id: str
    kind: str
    status: str
    steps: tuple[Step, ...]
    entity: str = ""
    derived: str = "false"
    unbound: str = "false"

    @property
    def status_sql(self) -> str:
        return f"CASE WHEN {self.derived} THEN 'derived' WHEN {self.unbound} THEN 'optional_unbound' ELSE '{self.status}' END"

    @property
    def bare(self) -> str:
        """When it has no witnesses."""
        return f"({self.derived} OR {self.unbound})"

    @property
    def entities_sql(self) -> str:
        none = "CAST(array() AS array<string>)"
        return f"if({self.derived}, array('{self.entity}'), {none})" if self.entity else none


def _listed(values) -> str:
    return ", ".join(map(sql_text, values))


def plan_atoms(compiled: Compiled, catalog: Catalog) -> list[Atom]:
    """The atoms in the plan's order, over the token columns of its result."""
    plan, out = compiled.plan, []

    def types(node: Token, classes: tuple[str, ...]) -> list[Step]:
        return [Step(node, classes=(c,)) for c in classes]

    for u in plan.selectors:
        s = catalog.selector(u.key)
        given = f"`{u.entity}` IN ({_listed(f'<{t}>' for t in s.targets)})" if s.targets else "false"
        out.append(Atom(u.id, "selector", "witnessed", (Step(of_row(u.entity), classes=s.classes, entity=u.entity),) if s.classes else (), u.entity, given))
    for e in plan.edges:
        prop, node = catalog.property(e.property_key), of_row(e.target_entity)
        out.append(Atom(e.id, "edge", "witnessed", (Step(of_row(plan.entity_of(e.source_lens)), prop, node), *types(node, prop.branch(e.branch_key).classes))))
    for f in plan.filters:
        prop, entity = catalog.property(f.property_key), plan.entity_of(f.lens)
        if f.kind == "eq":
            value = fixed(f.value.token)
            out.append(Atom(f.id, "filter", "derived", (Step(of_row(entity), prop, value), *types(value, prop.branch(f.branch_key).classes))))
        else:
            out.append(Atom(f.id, "filter", "derived", (Step(of_row(entity), prop, entity=entity),)))
    for p in plan.projections:
        if p.kind == "node":
            out.append(Atom(p.id, "projection", "derived", (), p.entity, "true"))
        else:
            prop, value = catalog.property(p.property_key), of_row(p.id)
            none = "false" if p.required else f"`{p.id}` IS NULL"
            out.append(Atom(p.id, "projection", "witnessed", (Step(of_row(plan.entity_of(p.lens)), prop, value), *types(value, prop.branch(p.branch_key).classes)), unbound=none))
    return out


_FACT = "struct<id: string, s: string, p: string, o: string>"
_SUPPORT = f"struct<kind: string, atom: string, status: string, witnesses: array<{_FACT}>, entities: array<string>>"


def _row_key_sql(compiled: Compiled) -> str:
    """row_key() over the token columns of a result and their spellings."""
    own = lambda n: term_json_sql(f"`{n}`", f"`{JSON}{n}`")
    values = ", ',', ".join(f"coalesce({own(p)}, 'null')" for p in compiled.public)
    bindings = ", ',', ".join(f"concat({sql_text(f'[{canonical_json(e)},')}, {own(e)}, ']')" for e in compiled.entities)
    return digest_sql("row", f"concat('[[', {values}, '],[', {bindings}, ']]')")


def _witness_id_sql(execution: str, atom: str, s: str, p: str, o: str) -> str:
    """witness_id() from JSON spellings; null if one of them is."""
    return digest_sql("witness", f"concat({sql_text('[' + canonical_json(execution) + ',')}, {atom}, ',', {s}, ',', {p}, ',', {o}, ']')")


def _certificate_id_sql(execution: str, compiled: Compiled) -> str:
    """The digest of _certificate() over row_key and supports; names in them are checked elsewhere and need no escapes."""
    quote = lambda c: f"'\"', {c}, '\"'"
    listed = lambda a, x, f: f"'[', array_join(transform({a}, {x} -> {f}), ','), ']'"
    entities = listed("x.entities", "e", f"concat({quote('e')})")
    witnesses = listed("x.witnesses", "w", f"concat({quote('w.id')})")
    one = f"""concat('{{"atom":', {quote('x.atom')}, ',"entities":', {entities}, ',"kind":', {quote('x.kind')}, ',"status":', {quote('x.status')}, ',"witnesses":', {witnesses}, '}}')"""
    head = f'{{"execution":{canonical_json(execution)},"plan":"{compiled.plan.digest}","query":"{compiled.query_digest}","row":"'
    return digest_sql("certificate", f"""concat({sql_text(head)}, row_key, '","supports":', {listed('supports', 'x', one)}, '}}')""")


def _fact_sql(execution: str, atom: str, s: Token, p: str, o: Token) -> str:
    known = _witness_id_sql(execution, sql_text(canonical_json(atom)), s.json, sql_text(canonical_json(p)), o.json)
    return f"named_struct('id', {known}, 's', {s.text}, 'p', {sql_text(p)}, 'o', {o.text})"


def _by_entity(rows: DataFrame, source, compiled: Compiled, entity: str, facts: DataFrame, space: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` beside _at, keys of ``space``, that meet an entity; null where none does."""
    binding = next(e.binding for e in compiled.plan.entities if e.id == entity)
    more = [c for c in facts.columns if c != "_at"]
    if binding is not None:
        key = source.key(binding, space)
        facts = facts.filter(F.lit(False) if key is None else F.col("_at") == F.lit(key))
    if binding is None and compiled.spaces[entity] == space:
        return rows.join(facts.withColumnRenamed("_at", KEY + entity), KEY + entity, "left")
    return rows.withColumn("_on", F.col(entity)).join(facts.select(source.render(F.col("_at"), space).alias("_on"), *more), "_on", "left").drop("_on")


def _open_steps(rows: DataFrame, source, compiled: Compiled, atoms: list[Atom]) -> tuple[DataFrame, dict[str, Token]]:
    """``rows`` with what the data chooses, and for each atom that leaves something open, the chosen token."""
    chosen: dict[str, Token] = {}
    for a in atoms:
        for s in a.steps:
            name = f"_open_{a.id}"
            if s.prop is not None and s.value is None:
                r = oriented(source, s.prop)
                value, node = source.render(F.col("dst"), r.dst), source.render(F.col("src"), r.src)
                named = r.rows.filter(~value.startswith("_:") & ~node.startswith("_:"))
                rows = _by_entity(rows, source, compiled, s.entity, named.groupBy(F.col("src").alias("_at")).agg(F.min(value).alias(name)), r.src)
            elif len(s.classes) > 1:
                for k, c in enumerate(s.classes):
                    nodes, space = source.members(c)
                    marked = nodes.select(F.col("node").alias("_at")).distinct().withColumn(f"{name}_{k}", F.lit(f"<{c}>"))
                    rows = _by_entity(rows, source, compiled, s.entity, marked, space)
                rows = rows.withColumn(name, F.array_min(F.array_compact(F.array(*(F.col(f"{name}_{k}") for k in range(len(s.classes)))))))
            else:
                continue
            chosen[a.id] = of_row(name)
    return rows, chosen


def _step_fact(execution: str, a: Atom, s: Step, chosen: dict[str, Token]) -> str:
    if s.prop is None:
        return _fact_sql(execution, a.id, s.node, TYPE, chosen[a.id] if len(s.classes) > 1 else fixed(f"<{s.classes[0]}>"))
    value = chosen[a.id] if s.value is None else s.value
    return _fact_sql(execution, a.id, *((value, s.prop.predicate, s.node) if s.prop.inverse else (s.node, s.prop.predicate, value)))


def certified(rows: DataFrame, source, compiled: Compiled, catalog: Catalog, execution: str) -> DataFrame:
    """The columns of ``rows`` (Compiled.checked, or some of its rows) with row_key, certificate and supports."""
    atoms = plan_atoms(compiled, catalog)
    names = rows.columns
    rows, chosen = _open_steps(rows, source, compiled, atoms)
    rows = spelled(rows, [*compiled.public, *compiled.entities, *(f"_open_{a}" for a in chosen)])
    supports = []
    for a in atoms:
        held = f"if({a.bare}, array(), array({', '.join(_step_fact(execution, a, s, chosen) for s in a.steps)}))" if a.steps else "array()"
        supports.append(f"CAST(named_struct('kind', '{a.kind}', 'atom', '{a.id}', 'status', {a.status_sql}, 'witnesses', {held}, 'entities', {a.entities_sql}) AS {_SUPPORT})")
    # Keys and facts are written before digests are taken over them.
    out = rows.selectExpr(*(f"`{n}`" for n in names), f"{_row_key_sql(compiled)} AS row_key", f"array({', '.join(supports)}) AS supports")
    return out.selectExpr("*", f"{_certificate_id_sql(execution, compiled)} AS certificate")


def witness_table(certificates: DataFrame) -> DataFrame:
    """id, atom, s, p, o of every witness of some certificates, once."""
    each = certificates.select(F.explode("supports").alias("x")).select("x.atom", F.explode("x.witnesses").alias("w"))
    return each.select("w.id", "atom", "w.s", "w.p", "w.o").distinct()


def _row_faults_sql(atoms: list[Atom]) -> str:
    """Faults of one row beside its certificate, as an array of (atom, fault); an atom's support is the column of its id after _of_."""
    found = []

    def need(ok: str, fault: str, atom: str | None = None) -> None:
        found.append(f"if(coalesce({ok}, false), NULL, named_struct('atom', {sql_text(atom) if atom else 'CAST(NULL AS string)'}, 'fault', '{fault}'))")

    need("row_key = _own_key", "row key")
    need("certificate = _own_id", "certificate id")
    # In the plan's order, so that one row has one certificate.
    need(f"transform(supports, x -> x.atom) = array({_listed(a.id for a in atoms)})", "atoms")
    for a in atoms:
        x = f"`_of_{a.id}`"
        need(f"{x} IS NULL OR {x}.kind = '{a.kind}'", "support kind", a.id)
        need(f"{x} IS NULL OR {x}.status = {a.status_sql}", "support status", a.id)
        need(f"{x} IS NULL OR {x}.entities = {a.entities_sql}", "support entities", a.id)
        need(f"{x} IS NULL OR size({x}.witnesses) = if({a.bare}, 0, {len(a.steps)})", "number of witnesses", a.id)
        fits = []
        for k, s in enumerate(a.steps):
            w = f"get({x}.witnesses, {k})"
            if s.prop is None:
                own = f"{w}.s = {s.node.text} AND {w}.p = {sql_text(TYPE)} AND {w}.o IN ({_listed(f'<{c}>' for c in s.classes)})"
            else:
                node, value = ("o", "s") if s.prop.inverse else ("s", "o")
                own = f"{w}.p = {sql_text(s.prop.predicate)} AND {w}.{node} = {s.node.text}" + (f" AND {w}.{value} = {s.value.text}" if s.value else "")
            fits.append(f"({w} IS NULL OR {own})")
        if fits:
            need(f"{x} IS NULL OR {a.bare} OR ({' AND '.join(fits)})", "witness does not fit", a.id)
    return f"array_compact(array({', '.join(found)}))"


def _without(rows: DataFrame, source, ends: list[tuple[str, str, str]], facts: DataFrame) -> list[DataFrame]:
    """``rows`` but those whose ends are in ``facts``, dealt to all tasks as they are set.

    Ends that are no keys of their space are in no fact, and all would meet in one task of a join.
    """
    met = {}
    for k, (c, side, space) in enumerate(ends):
        key = source.unrender(rows[c], space)
        met[f"_k{k}"] = (rows[c], source.render(facts[side], space)) if key is None else (key, facts[side])
    none = reduce(Column.__or__, (mine.isNull() for mine, _ in met.values()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.filter(~none).withColumns({n: mine for n, (mine, _) in met.items()}).repartition(parts, *met)
    other = facts.select(*(theirs.alias(n) for n, (_, theirs) in met.items()))
    return [rows.filter(none), held.join(other, list(met), "left_anti").select(*rows.columns)]


def not_in_data(witnesses: DataFrame, source, predicates: set[str], classes: set[str]) -> DataFrame:
    """Of rows with s, p, o, those that are no facts of the source: in one anti-join over a table of tokens, else in one for each predicate and class."""
    if isinstance(source, FactsTable):
        needed = sorted(f"<{p}>" for p in predicates | ({TYPE} if classes else set()))
        facts = source.facts.filter(F.col("p").isin(needed)).select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
        return witnesses.join(facts, (F.col("s") == F.col("_s")) & (F.concat(F.lit("<"), "p", F.lit(">")) == F.col("_p")) & (F.col("o") == F.col("_o")), "left_anti")
    known = [f"<{c}>" for c in sorted(classes)]
    is_type = F.col("p") == TYPE
    parts = [witnesses.filter(~(F.col("p").isin(*sorted(predicates)) & ~is_type) & ~(is_type & F.col("o").isin(*known)) | F.col("s").isNull() | F.col("o").isNull())]
    whole = witnesses.filter(F.col("s").isNotNull() & F.col("o").isNotNull())
    for p in sorted(predicates - {TYPE}):
        own, r = whole.filter(F.col("p") == p), source.relation(p)
        facts = r.rows.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        parts += _without(own, source, [("s", "_a", r.src), ("o", "_b", r.dst)], facts)
    for c in sorted(classes):
        own = whole.filter(is_type & (F.col("o") == f"<{c}>"))
        nodes, space = source.members(c)
        parts += _without(own, source, [("s", "_a", space)], nodes.select(F.col("node").alias("_a")))
    return reduce(DataFrame.unionByName, parts)


def faults(rows: DataFrame, certificates: DataFrame, source, compiled: Compiled, catalog: Catalog, execution: str) -> DataFrame:
    """row_key, atom, fault: everything in which rows and certificates do not hold (once for each witness); nothing if they do.

    ``rows`` has the token columns of the result and row_key, ``certificates`` row_key,
    certificate and supports; either may be any table. Each is checked by itself and
    against the other, and every witness is looked up in the data.
    """
    atoms = plan_atoms(compiled, catalog)
    names = [*compiled.public, *compiled.entities]
    own = spelled(rows.select(*names, "row_key"), names).selectExpr(*(f"`{n}`" for n in names), "row_key", f"{_row_key_sql(compiled)} AS _own_key")
    held = certificates.select("row_key", "certificate", F.col("supports").cast(f"array<{_SUPPORT}>").alias("supports"))
    # How often a key is on either side.
    both = own.selectExpr("row_key", "1 AS _r", "0 AS _c").unionByName(held.selectExpr("row_key", "0 AS _r", "1 AS _c"))
    met = both.groupBy("row_key").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    told = "array_compact(array(if(_c = 0, 'no certificate', NULL), if(_r = 0, 'no row', NULL), if(_r > 1, 'row twice', NULL), if(_c > 1, 'certificate twice', NULL)))"
    uneven = met.selectExpr("row_key", "CAST(NULL AS string) AS atom", f"explode({told}) AS fault")
    beside = own.join(held.selectExpr("*", f"{_certificate_id_sql(execution, compiled)} AS _own_id"), "row_key")
    beside = beside.selectExpr("*", *(f"get(filter(supports, x -> x.atom = '{a.id}'), 0) AS `_of_{a.id}`" for a in atoms))
    wrong = beside.selectExpr("row_key", f"inline({_row_faults_sql(atoms)}) AS (atom, fault)")
    facts = held.selectExpr("row_key", "explode(supports) AS x").selectExpr("row_key", "x.atom", "explode(x.witnesses) AS w").selectExpr("row_key", "atom", "w.id", "w.s", "w.p", "w.o")
    named = facts.filter(f"NOT coalesce(id = {_witness_id_sql(execution, *map(json_sql, ('atom', 's', 'p', 'o')))}, false)").selectExpr("row_key", "atom", "'witness id' AS fault")
    predicates = {s.prop.predicate for a in atoms for s in a.steps if s.prop is not None}
    classes = {c for a in atoms for s in a.steps for c in s.classes}
    missing = not_in_data(facts, source, predicates, classes).selectExpr("row_key", "atom", "'witness is no fact' AS fault")
    return reduce(DataFrame.unionByName, [uneven, wrong, named, missing])


def _certificate(execution: str, compiled: Compiled, row: ResultRow, supports: tuple[Support, ...]) -> Certificate:
    body = {"execution": execution, "plan": compiled.plan.digest, "query": compiled.query_digest, "row": row.key, "supports": [asdict(s) for s in supports]}
    return Certificate(digest("certificate", body), execution, compiled.plan.digest, compiled.query_digest, row.key, row.bindings, supports)


def certify(rows: DataFrame, source, compiled: Compiled, catalog: Catalog, execution: str) -> tuple[tuple[ResultRow, ...], tuple[Certificate, ...], tuple[Witness, ...]]:
    """Rows, certificates and witnesses of a bounded result in its order; EvidenceError where a support is missing."""
    whole = certified(rows.withColumn("_at", F.monotonically_increasing_id()), source, compiled, catalog, execution)
    out, certificates, witnesses = [], [], {}
    for r in sorted(whole.collect(), key=lambda r: r["_at"]):  # bounded: the policy's result rows
        row = make_row([r[n] for n in compiled.public], [(e, r[e]) for e in compiled.entities])
        supports = []
        for x in r.supports:
            for w in x.witnesses:
                if w.s is None or w.o is None:
                    raise EvidenceError(f"no witness for {x.atom}")
                witnesses[w.id] = Witness(w.id, execution, x.atom, Term.parse(w.s), w.p, Term.parse(w.o))
            supports.append(Support(x.kind, x.atom, x.status, tuple(w.id for w in x.witnesses), tuple(x.entities)))
        out.append(row)
        certificates.append(Certificate(r.certificate, execution, compiled.plan.digest, compiled.query_digest, r.row_key, row.bindings, tuple(supports)))
    return tuple(out), tuple(certificates), tuple(witnesses.values())


def facts_exist(spark: SparkSession, source, witnesses: tuple[Witness, ...]) -> bool:
    """Whether every witness is a fact of the source."""
    rows = spark.createDataFrame([(w.subject.token, w.predicate, w.object.token) for w in witnesses], "s string, p string, o string")
    classes = {w.object.value for w in witnesses if w.predicate == TYPE}
    return not not_in_data(rows, source, {w.predicate for w in witnesses}, classes).take(1)


def check_packet(spark: SparkSession, source, catalog: Catalog, compiled: Compiled, packet: Packet, rows: tuple[ResultRow, ...], expected: dict) -> None:
    """Re-verify a packet against plan, rows and data; EvidenceError on the first thing that does not hold.

    ``expected`` has the digests and revisions that the packet must carry. Rows and
    certificates are checked by faults().
    """

    def need(ok, what: str) -> None:
        if not ok:
            raise EvidenceError(what)

    need(packet.id == packet.own_id(), "packet id")
    for name, value in expected.items():
        need(getattr(packet, name) == value, name)
    need(packet.plan_digest == compiled.plan.digest and packet.query_digest == compiled.query_digest, "plan or query digest")
    need(packet.completed and packet.row_count == len(rows), "row count")
    need(packet.completeness == ("incomplete" if packet.more else "complete"), "completeness")
    need(packet.result_kind == compiled.plan.kind, "result kind")
    need((packet.boolean is not None) == (packet.result_kind == "ask"), "boolean value")
    need([c.row_key for c in packet.certificates] == [r.key for r in rows], "certificates match rows")
    for row in rows:
        need([e for e, _ in row.bindings] == list(compiled.entities) and len(row.values) == len(compiled.public), "row shape")
    by_id = {w.id: w for w in packet.witnesses}
    need(len(by_id) == len(packet.witnesses), "witness ids are distinct")
    need(all(w.execution_id == packet.execution_id and w.assertion == "unknown" for w in packet.witnesses), "witness status")
    for row, c in zip(rows, packet.certificates):
        need((c.execution_id, c.plan_digest, c.query_digest, c.bindings) == (packet.execution_id, compiled.plan.digest, compiled.query_digest, row.bindings), "certificate identity")
        need(all(i in by_id and by_id[i].atom == s.atom for s in c.supports for i in s.witnesses), "support witnesses")
    need({i for c in packet.certificates for s in c.supports for i in s.witnesses} == set(by_id), "every witness supports something")
    if not rows:
        return
    fact = lambda w: (w.id, w.subject.token, w.predicate, w.object.token)
    supports = lambda c: [(s.kind, s.atom, s.status, [fact(by_id[i]) for i in s.witnesses], list(s.entities)) for s in c.supports]
    names = [*compiled.public, *compiled.entities, "row_key"]
    tokens = [(*(v and v.token for v in r.values), *(t.token for _, t in r.bindings), r.key) for r in rows]
    whole = spark.createDataFrame(tokens, ", ".join(f"`{n}` string" for n in names))
    held = spark.createDataFrame([(c.row_key, c.id, supports(c)) for c in packet.certificates], f"row_key string, certificate string, supports array<{_SUPPORT}>")
    wrong = faults(whole.coalesce(1), held.coalesce(1), source, compiled, catalog, packet.execution_id).limit(1).collect()
    need(not wrong, wrong and f"{wrong[0].fault}{' of ' + wrong[0].atom if wrong[0].atom else ''}")
