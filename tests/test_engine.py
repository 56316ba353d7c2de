from dataclasses import replace

import pytest
from graphs import DATA, EVERYONE, EX, SHAPES, Builder, catalog, facts, source

from factgraph.engine import Engine, render_result
from factgraph.errors import CatalogError, EvidenceError, PlanError, PolicyError
from factgraph.functions.terms import XSD, Term
from factgraph.operators.evidence import Support
from factgraph.plans.catalog import Catalog, CatalogLimits, Overlay, Qualification, property_signature
from factgraph.plans.query import AuthorizationScope, DatasetScope, ExecutionRequest, QueryPolicy
from factgraph.sources.facts import FactsTable
from factgraph.sources.turtle import parse_turtle

G = "http://graphs.test/a"
LOOSE = QueryPolicy(timeout_seconds=120)


@pytest.fixture(scope="module", params=["graph", "dataset"])
def engine(spark, request):
    named = request.param == "dataset"
    df = facts(spark, graph=f"<{G}>" if named else None).cache()
    return Engine(spark, FactsTable(df, (G,) if named else ()), catalog(), EVERYONE, DatasetScope(graphs=(G,) if named else ()), LOOSE)


def names(outcome):
    """Rows of short names, sorted."""
    assert outcome.kind == "selected", outcome
    return sorted((tuple(None if v is None else v.value.removeprefix(EX) for v in r.values) for r in outcome.rows), key=str)


def star(cat):
    b = Builder(cat)
    who, job, skill = b.entity(), b.entity("red"), b.entity("weld")
    b.select(who, "WorkShape")
    w, n = b.lens(who, "WorkShape"), b.lens(who, "NameShape")
    return b.edge(w, "on", job).edge(w, "can", skill).node(who).field(n, "name")


def test_star_join_with_bound_targets(engine):
    out = engine.execute_plan(star(engine.catalog).raw)
    assert names(out) == [("Ann", "ann"), ('Bob "B"', "bob")]  # fields come before nodes
    assert out.packet.completeness == "complete" and len(out.packet.certificates) == 2
    assert render_result(out).splitlines()[0] == f'"Ann"\t<{EX}ann>'


def test_inverse_chain_and_classes(engine):
    b = Builder(engine.catalog)
    job, who = b.entity(), b.entity()
    b.select(job, "JobShape").edge(b.lens(job, "JobShape"), "on", who, inverse=True).node(job).node(who)
    assert names(engine.execute_plan(b.raw)) == [("blue", "ann"), ("blue", "cy"), ("red", "ann"), ("red", "bob")]
    b = Builder(engine.catalog)
    who, job = b.entity(), b.entity()  # dee works on something that is no job
    b.select(who, "WorkShape").edge(b.lens(who, "WorkShape"), "on", job).node(who)
    assert names(engine.execute_plan(b.raw)) == [("ann",), ("ann",), ("bob",), ("cy",)]  # hidden entities keep rows apart


def test_filters_are_exact(engine):
    def code(text):
        b = Builder(engine.catalog)
        who = b.entity()
        b.select(who, "NameShape")
        return engine.execute_plan(b.eq(b.lens(who, "NameShape"), "code", Term.literal(text, XSD + "integer")).node(who).raw)

    assert names(code("01")) == [("ann",)] and names(code("1")) == [("bob",)]
    assert code("001").kind == "no_match"
    b = Builder(engine.catalog)
    who = b.entity()
    b.select(who, "NameShape").exists(b.lens(who, "NameShape"), "nick").node(who)
    assert names(engine.execute_plan(b.raw)) == [("bob",)]
    b = Builder(engine.catalog)
    who = b.entity()
    b.select(who, "NameShape").eq(b.lens(who, "NameShape"), "nick", Term.literal("bo", language="En")).node(who)
    assert names(engine.execute_plan(b.raw)) == [("bob",)]
    b = Builder(engine.catalog)
    who = b.entity()
    b.select(who, "NameShape").eq(b.lens(who, "NameShape"), "code", Term.literal("1")).node(who)
    assert engine.execute_plan(b.raw).kind == "unsupported"  # no integer
    b = Builder(engine.catalog)
    who = b.entity()
    b.select(who, "WorkShape").eq(b.lens(who, "WorkShape"), "can", Term.iri(EX + "weld")).node(who)
    assert names(engine.execute_plan(b.raw)) == [("ann",), ("bob",)]


def test_enumerations_and_optional_fields(engine):
    b = Builder(engine.catalog)
    who, grade = b.entity(), b.entity()
    b.select(who, "WorkShape").edge(b.lens(who, "WorkShape"), "grade", grade).node(who).node(grade)
    assert names(engine.execute_plan(b.raw)) == [("ann", "Low"), ("cy", "High")]
    b = Builder(engine.catalog)
    who, skill = b.entity(), b.entity("paint")
    b.select(who, "WorkShape")
    w = b.lens(who, "WorkShape")
    out = engine.execute_plan(b.edge(w, "can", skill).node(who).field(w, "grade", required=False).raw)
    assert names(out) == [("High", "cy"), (None, "bob")]
    assert {s.status for c in out.packet.certificates for s in c.supports} == {"witnessed", "derived", "optional_unbound"}


def test_selectors(engine):
    def focus(shape):
        b = Builder(engine.catalog)
        x = b.entity()
        return engine.execute_plan(b.select(x, shape).node(x).raw)

    assert names(focus("FocusShape")) == [("gone",), ("red",)]  # targets need not exist
    assert names(focus("BothShape")) == [("ann",), ("cy",)]
    b = Builder(engine.catalog)
    who, job = b.entity(), b.entity()
    b.select(who, "BothShape").select(job, "FocusShape").edge(b.lens(who, "WorkShape"), "on", job).node(who).node(job)
    assert names(engine.execute_plan(b.raw)) == [("ann", "red")]


def test_branches_cycles_and_ask(engine):
    for branch, expected in ((0, "red"), (1, "blue")):
        b = Builder(engine.catalog)
        job = b.entity()
        j = b.select(job, "JobShape").lens(job, "JobShape")
        value = Term.literal("10", XSD + "integer") if branch == 0 else Term.literal("big")
        assert names(engine.execute_plan(b.eq(j, "size", value, branch).node(job).raw)) == [(expected,)]
    b = Builder(engine.catalog)
    a = b.entity()
    b.select(a, "WorkShape").edge(b.lens(a, "WorkShape"), "boss", a).node(a)
    assert names(engine.execute_plan(b.raw)) == [("cy",)]
    b = Builder(engine.catalog)
    a, c, job = b.entity(), b.entity(), b.entity()
    b.select(a, "WorkShape").select(c, "WorkShape")
    b.edge(b.lens(a, "WorkShape"), "on", job).edge(b.lens(c, "WorkShape"), "on", job).node(a).node(c)
    assert len(engine.execute_plan(b.raw).rows) == 8
    for target, kind in (("red", "boolean"), ("old", "no_match")):
        b = Builder(engine.catalog, "boolean")
        a, job = b.entity("ann"), b.entity(target)
        out = engine.execute_plan(b.edge(b.lens(a, "WorkShape"), "on", job).raw)
        assert out.kind == kind and out.packet.boolean is (kind == "boolean") and not out.packet.certificates


def test_runs_that_fail(engine):
    b = Builder(engine.catalog)  # ann's boss is a literal
    a, c = b.entity(), b.entity()
    b.select(a, "WorkShape").edge(b.lens(a, "WorkShape"), "boss", c).node(c)
    assert engine.execute_plan(b.raw).kind == "failed"
    b = Builder(engine.catalog)  # dee has two names
    a = b.entity()
    b.select(a, "NameShape").field(b.lens(a, "NameShape"), "name")
    out = engine.execute_plan(b.raw)
    assert out.kind == "failed" and "several values" in out.reason and not out.packet.completed
    b = Builder(engine.catalog)  # one size is no integer
    j = b.entity()
    b.select(j, "JobShape").field(b.lens(j, "JobShape"), "size", branch=0)
    assert engine.execute_plan(b.raw).kind == "failed"
    assert engine.execute_plan(star(engine.catalog).raw, ExecutionRequest(cancelled=True)).reason == "cancelled"


def test_limits_and_requests(engine):
    b = Builder(engine.catalog)
    who = b.entity()
    raw = b.select(who, "WorkShape").node(who).raw
    out = engine.execute_plan(raw, ExecutionRequest.examples(2))
    assert names(out) == [("ann",), ("bob",)] and out.packet.more and out.packet.completeness == "incomplete"
    assert render_result(out).endswith("more rows exist")
    small = Engine(engine.spark, engine.source, engine.catalog, EVERYONE, engine.dataset, replace(LOOSE, max_result_rows=3))
    assert small.execute_plan(raw).kind == "policy_limited"
    assert small.execute_plan(raw, ExecutionRequest.examples(4)).kind == "policy_limited"
    assert Engine(engine.spark, engine.source, engine.catalog, EVERYONE, engine.dataset, replace(LOOSE, max_nodes=1)).execute_plan(raw).kind == "policy_limited"
    assert Engine(engine.spark, engine.source, engine.catalog, EVERYONE, engine.dataset, replace(LOOSE, max_result_bytes=10)).execute_plan(raw).reason == "result_byte_limit"
    assert Engine(engine.spark, engine.source, engine.catalog, EVERYONE, engine.dataset, replace(LOOSE, max_entities=1)).execute_plan(star(engine.catalog).raw).kind == "policy_limited"
    for bad in ({"max_retries": 1}, {"timeout_seconds": float("inf")}, {"max_result_rows": True}):
        with pytest.raises(PolicyError):
            replace(LOOSE, **bad)


def test_plans_that_are_rejected(engine):
    def kind(change):
        raw = star(engine.catalog).raw
        change(raw)
        return engine.execute_plan(raw).kind

    assert kind(lambda r: r.update(extra=1)) == "unsupported"
    assert kind(lambda r: r.update(kind="update")) == "unsupported"
    assert kind(lambda r: r.update(catalog_revision="old")) == "unsupported"
    assert kind(lambda r: r["projections"][1].update(required=1)) == "unsupported"
    assert kind(lambda r: r["projections"].clear()) == "unsupported"
    assert kind(lambda r: r["lenses"].append({**r["lenses"][0], "id": "again"})) == "unsupported"
    assert kind(lambda r: r["edges"].append({**r["edges"][0], "id": "again"})) == "unsupported"
    assert kind(lambda r: r["edges"].pop(0)) == "unsupported"  # an entity hangs loose
    assert kind(lambda r: r["selectors"].clear()) == "unsupported"
    assert kind(lambda r: r["entities"].append({"id": "x", "binding": {"kind": "iri", "value": EX + "a b"}})) == "unsupported"
    assert engine.execute_plan("text").kind == "unsupported"
    with pytest.raises(PolicyError):
        engine.compile(star(engine.catalog).raw, limit=-1)


def test_canonical_plans(engine):
    raw = star(engine.catalog).raw
    other = {k: list(reversed(v)) if isinstance(v, list) else v for k, v in raw.items()}
    text = repr(other)
    for part in ("entities", "lenses"):
        for k in range(3):
            text = text.replace(f"'{part}{k}'", f"'{part}_renamed{7 - k}'")
    other = eval(text)  # noqa: S307
    assert engine.prepare(raw).digest == engine.prepare(other).digest
    assert engine.explain_plan(raw).query_digest == engine.explain_plan(other).query_digest
    digests = set()
    for swapped in (False, True):  # alike but for their neighbours' neighbours, and wholly alike
        b = Builder(engine.catalog)
        one, two, three, job, other = (b.entity(x) for x in (None, None, None, None, "red"))
        first, second = (two, one) if swapped else (one, two)
        edges = [(first, job), (second, job), (three, job), (first, other)]
        for who in (one, two, three):
            b.select(who, "WorkShape")
        lens = {who: b.lens(who, "WorkShape") for who in (three, second, first)}
        for who, to in reversed(edges) if swapped else edges:
            b.edge(lens[who], "on", to)
        b.node(three).node(two).node(one)
        digests.add(engine.prepare(b.raw).digest)
    assert len(digests) == 1
    near = star(engine.catalog)
    near.raw["filters"] = [{"id": "f", "kind": "exists", "lens": "lenses1", "property_key": near.prop("lenses1", "code").key}]
    assert engine.prepare(near.raw).digest != engine.prepare(raw).digest


def test_evidence_mutations(engine):
    raw = star(engine.catalog).raw
    out = engine.execute_plan(raw)
    c, p, rows = engine.compile(raw), out.packet, out.rows
    engine.verify(c, p, rows)
    cert, w = p.certificates[0], p.witnesses[0]
    swap = lambda cs: replace(p, certificates=(cs, *p.certificates[1:])).sealed()
    bad = [
        swap(replace(cert, supports=cert.supports[:-1])),
        swap(replace(cert, supports=(replace(cert.supports[0], status="derived"), *cert.supports[1:]))),
        swap(replace(cert, supports=tuple(Support("projection", s.atom, "optional_unbound") if s.atom == "shown0" else s for s in cert.supports))),
        replace(p, certificates=p.certificates + p.certificates[:1]).sealed(),
        replace(p, row_count=7).sealed(),
        replace(p, more=True).sealed(),
        replace(p, plan_digest="x").sealed(),
        replace(p, catalog_revision="x").sealed(),
        replace(p, authorization_digest="x").sealed(),
        replace(p, dataset_digest="x").sealed(),
        replace(p, completed=False).sealed(),
        replace(p, id="x"),
        replace(p, witnesses=p.witnesses[1:]).sealed(),
        replace(p, witnesses=(replace(w, object=Term.iri(EX + "none")), *p.witnesses[1:])).sealed(),
        replace(p, witnesses=(replace(w, assertion="asserted"), *p.witnesses[1:])).sealed(),
        replace(p, boolean=True).sealed(),
    ]
    for packet in bad:
        with pytest.raises(EvidenceError):
            engine.verify(c, packet, rows)
    for broken in (rows[:1], (replace(rows[0], key="x"), *rows[1:]), (replace(rows[0], bindings=()), *rows[1:])):
        with pytest.raises(EvidenceError):
            engine.verify(c, p, broken)


def test_trust_review_and_authorization(spark):
    table = FactsTable(facts(spark))

    def kind(src, scope=EVERYONE, dataset=None):
        cat = catalog(src)
        return Engine(spark, table, cat, scope, dataset, LOOSE).execute_plan(star(cat).raw).kind

    assert kind(source()) == "selected"
    assert kind(source(trust="untrusted")) == kind(source(closure=("trusted", "untrusted"))) == "unsupported"
    assert kind(source(records=lambda r: r[1] != "property")) == kind(source(records=lambda r: r[1] != "selector")) == "unsupported"
    assert kind(source(records=lambda r: r[1] != "scalar_projection")) == "unsupported"
    assert kind(source(), AuthorizationScope("none", properties=frozenset())) == "policy_limited"
    assert kind(source(), AuthorizationScope("g", graphs=frozenset({G}))) == "policy_limited"
    assert catalog(source(), source(trust="quarantined", source_id="q")).lenses == catalog(source(), source(trust="quarantined", source_id="q")).lenses
    assert len(catalog(source(), source(trust="quarantined", source_id="q")).lenses) == len(catalog().lenses)


def test_overlays_make_fields_scalar(spark):
    text = SHAPES.replace("[ sh:path e:nick ; sh:maxCount 1 ]", "[ sh:path e:nick ]")
    shape = f"<{EX}NameShape>"
    sign = property_signature(parse_turtle(text), EX + "NameShape", EX + "nick")
    q = Qualification("tests", "r1", ((shape, "scalar_projection", sign),), ("f1",))
    grant = Overlay("o", "executable", "tests", True, ((shape, EX + "nick"),), q)
    scalar = lambda *o: Catalog.build([source(text)], o, "b1").find(EX + "NameShape", EX + "nick").scalar
    assert scalar(grant) and not scalar() and not scalar(replace(grant, trusted=False)) and not scalar(replace(grant, qualification=None))
    with pytest.raises(CatalogError):
        replace(grant, kind="policy")


def test_catalog_artifacts_and_limits():
    cat = catalog()
    assert Catalog.reload(cat.dump()) == cat
    raw = cat.dump()
    raw["properties"][0]["scalar"] = not raw["properties"][0]["scalar"]
    for bad in (raw, {**cat.dump(), "more": 1}, {**cat.dump(), "revision": ""}):
        with pytest.raises(CatalogError):
            Catalog.reload(bad)
    assert {d.code for d in cat.diagnostics} == {"target_class_non_iri", "path_unsupported"}
    assert {d.code for d in catalog(limits=CatalogLimits(path=1)).diagnostics} >= {"path_depth_exceeded"}
    for limits in (CatalogLimits(triples=3), CatalogLimits(bytes=10), CatalogLimits(card_bytes=10), CatalogLimits(recursion=1)):
        with pytest.raises(CatalogError):
            catalog(limits=limits)
    head = "@prefix e: <http://shop.test/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . e:S a sh:NodeShape ; sh:property [ sh:path e:p ; "
    for bad in ("sh:in _:l ] . _:l r:first 1 ; r:rest _:l .", "sh:or () ] .", "sh:nodeKind sh:BlankNode ] .", "sh:in (1) , (2) ] .", "sh:node e:S ] ."):
        with pytest.raises(CatalogError):
            catalog(source(head + bad))


def test_named_graphs_and_blank_nodes(spark):
    df = facts(spark, graph=f"<{G}>").unionByName(facts(spark, DATA, f"<{G}2>")).unionByName(facts(spark, "@prefix e: <http://shop.test/> . e:eve a e:Worker . [] a e:Worker .", f"<{G}3>"))
    b = Builder(catalog())
    who = b.entity()
    raw = b.select(who, "WorkShape").node(who).raw

    def run(*graphs, scope=EVERYONE):
        return Engine(spark, FactsTable(df, graphs), b.cat, scope, DatasetScope(graphs=graphs), LOOSE).execute_plan(raw)

    assert len(run(G).rows) == len(run(G, G + "2").rows) == 4  # merged graphs are a set
    assert run(G + "3").kind == "failed"  # a blank node is no result
    assert run().kind == "no_match"  # the default graph is empty
    assert run(G, scope=AuthorizationScope("s", graphs=frozenset({G + "2"}))).kind == "policy_limited"
    with pytest.raises(PolicyError):
        FactsTable(df.drop("g"), (G,))


def test_broken_and_slow_sources(spark, engine):
    class Broken(FactsTable):
        def relation(self, predicate):
            raise RuntimeError("store is gone")

    raw = star(engine.catalog).raw
    assert Engine(spark, Broken(facts(spark)), engine.catalog, EVERYONE, policy=LOOSE).execute_plan(raw).kind == "failed"
    slow = Engine(spark, engine.source, engine.catalog, EVERYONE, engine.dataset, QueryPolicy(timeout_seconds=0.001)).execute_plan(raw)
    assert slow.kind == "failed" and slow.reason == "deadline_exceeded"


def test_terms():
    for t in (Term.iri("urn:a:b"), Term.literal('a"\\\n\t\b\f\r'), Term.literal("01", XSD + "integer"), Term.literal("x", language="EN-us")):
        assert Term.parse(t.token) == t and Term.load(t.json()) == t
    for bad in ({"kind": "iri", "value": "relative"}, {"kind": "iri", "value": "urn:a\nb"}, {"kind": "literal", "value": "x", "datatype": "urn:d", "language": "en"}, {"kind": "literal", "value": 1}, {"kind": "blank", "value": "x"}, {"kind": "iri", "value": "urn:x", "more": 1}):
        with pytest.raises(PlanError):
            Term.load(bad)
    assert Term.literal("a") != Term.literal("a", XSD + "string")
    assert Term.literal("a").effective_datatype == Term.literal("a", XSD + "string").effective_datatype


def test_query_text_names_graphs_and_limit(engine):
    from factgraph.plans.text import query_text, read_query

    raw, graphs = star(engine.catalog).raw, engine.dataset.graphs
    text = engine.explain_plan(raw, 7).text
    assert text.endswith(" LIMIT 7") and (f"FROM <{G}> WHERE" in text) == bool(graphs)
    kind, names_, found, patterns, limit = read_query(text)
    assert (kind, found, limit) == ("select", graphs, 7) and names_[0] == "?shown0" and len(patterns) >= 6
    b = Builder(engine.catalog, "ask")
    a, job = b.entity("ann"), b.entity("red")
    ask = engine.prepare(b.edge(b.lens(a, "WorkShape"), "on", job).raw)
    assert query_text(ask, engine.catalog).startswith("ASK { ") and query_text(ask, engine.catalog, ("urn:a", "urn:b"), 9).startswith("ASK FROM <urn:a> FROM <urn:b> WHERE { ")
    for broken in (text.replace("LIMIT 7", "LIMIT 0"), text.replace("LIMIT 7", "LIMIT"), text + " }", text.replace("DISTINCT", ""), text.replace("WHERE", "")):
        with pytest.raises(PlanError):
            read_query(broken)
