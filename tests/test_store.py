"""The dictionary-encoded store against the same facts as tokens, and the order of joins that its counts give."""

import pytest
from graphs import EVERYONE, EX, Builder, catalog, facts, source

from factgraph.engine import Engine
from factgraph.functions.terms import TYPE, Term
from factgraph.plans.builder import PlanBuilder
from factgraph.plans.catalog import Catalog
from factgraph.plans.query import DatasetScope, QueryPolicy
from factgraph.sources.facts import FactsTable
from factgraph.sources.shared import shared_folder
from factgraph.sources.store import StoredFacts, build_store

LOOSE = QueryPolicy(timeout_seconds=120)


@pytest.fixture(scope="module")
def folder(spark):
    path = shared_folder(spark, "store-test")
    whole = facts(spark).unionByName(facts(spark, "@prefix e: <http://shop.test/> . e:eve a e:Worker ; e:on e:red .", "<urn:other>"))
    build_store(whole.unionByName(whole), path)  # facts are a set
    return path


def plans(cat):
    """Raw plans with constants in and out of the store, classes, enumerations, targets, optional fields and both directions."""
    b = Builder(cat)
    who, job, skill = b.entity(), b.entity("red"), b.entity("weld")
    b.select(who, "WorkShape")
    w = b.lens(who, "WorkShape")
    yield b.edge(w, "on", job).edge(w, "can", skill).node(who).field(b.lens(who, "NameShape"), "name").raw
    b = Builder(cat)
    job, who = b.entity(), b.entity()
    yield b.select(job, "JobShape").edge(b.lens(job, "JobShape"), "on", who, inverse=True).node(job).node(who).raw
    for shape in ("FocusShape", "BothShape"):  # a target that the store does not know
        b = Builder(cat)
        yield b.select(b.entity(), shape).node("entities0").raw
    b = Builder(cat)
    who = b.entity()
    w = b.lens(who, "WorkShape")
    b.select(who, "WorkShape").exists(w, "can")
    yield b.field(b.lens(who, "NameShape"), "nick", required=False).field(w, "grade", required=False).node(who).raw
    for code in ("01", "1", "7"):
        b = Builder(cat)
        who = b.entity()
        yield b.select(who, "NameShape").eq(b.lens(who, "NameShape"), "code", Term.literal(code, "http://www.w3.org/2001/XMLSchema#integer")).node(who).raw
    b = Builder(cat)  # dee has two names
    yield b.field(b.lens(b.entity("dee"), "NameShape"), "name").raw


def test_same_rows_as_over_tokens(spark, folder):
    cat, table = catalog(), FactsTable(facts(spark))
    for raw in plans(cat):
        want = Engine(spark, table, cat, EVERYONE, DatasetScope(), LOOSE).compile(raw)
        got = Engine(spark, StoredFacts(spark, folder), cat, EVERYONE, DatasetScope(), LOOSE).compile(raw)
        assert sorted(map(repr, got.rows.collect())) == sorted(map(repr, want.rows.collect()))


def test_executions_and_named_graphs(spark, folder):
    cat = catalog()
    raw = next(plans(cat))
    out = Engine(spark, StoredFacts(spark, folder), cat, EVERYONE, DatasetScope(), LOOSE).execute_plan(raw)
    assert out.kind == "selected" and len(out.rows) == 2 and len(out.packet.certificates) == 2
    other = StoredFacts(spark, folder, ("urn:other",))
    assert [tuple(r) for r in other.tokens(other.relation(EX + "on").rows, {"src": ("a", "id"), "dst": ("b", "id")}).select("a", "b").collect()] == [(f"<{EX}eve>", f"<{EX}red>")]
    assert other.relation(EX + "name").rows.count() == 0 and other.relation("urn:unknown").rows.count() == 0


def test_terms_are_numbered_in_order(spark, folder):
    rows = spark.read.parquet(f"{folder}/terms").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows))) and [r.token.encode() for r in rows] == sorted({r.token.encode() for r in rows})


def test_no_join_compares_strings(spark, folder):
    cat = catalog()
    b = Builder(cat)
    who, job = b.entity(), b.entity()
    w = b.lens(who, "WorkShape")
    raw = b.select(who, "WorkShape").edge(w, "on", job).exists(w, "can").node(who).node(job).raw
    plan = Engine(spark, StoredFacts(spark, folder), cat, EVERYONE, DatasetScope(), LOOSE).compile(raw).rows._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert len(joins) >= 4 and not any("token" in x for x in joins), plan


def test_hot_terms_and_statistics(spark):
    path = shared_folder(spark, "store-hot")
    rows = [(f"<urn:s/{k}>", f"<{TYPE}>", "<urn:C>") for k in range(3000)] + [("<urn:hub>", "<urn:p>", f'"{k}"') for k in range(3000)] + [(f"<urn:s/{k}>", "<urn:p>", '"x"') for k in range(100)]
    build_store(spark.createDataFrame(rows, "s string, p string, o string").repartition(3), path, buckets=4)
    store = StoredFacts(spark, path)
    assert store.relation("urn:p").rows.count() == 3100 and store.members("urn:C")[0].count() == 3000
    assert (store.counts("urn:p").facts, store.counts("urn:p").subjects, store.counts("urn:p").objects) == (3100, 101, 3001)
    assert store.class_size("urn:C") == 3000 and store.class_size("urn:none") == 0 and store.counts("urn:none").facts == 0
    assert store.star(["urn:p"]) == (101, 3100.0) and store.star(["urn:p", TYPE]) == (100, 100.0)
    files = [r.f for r in store.orders["subjects"].filter(f"s = {store.ids(['<urn:hub>'])[0]}").selectExpr("input_file_name() AS f").distinct().collect()]
    assert len(files) > 1  # the hub's facts were dealt to several tasks


CHAIN = """
@prefix e: <urn:c:> . @prefix sh: <http://www.w3.org/ns/shacl#> .
e:AShape a sh:NodeShape ; sh:targetClass e:A ; sh:property [ sh:path e:ab ] , [ sh:path e:mark ; sh:maxCount 1 ] .
e:BShape a sh:NodeShape ; sh:targetClass e:B ; sh:property [ sh:path e:bc ] .
e:CShape a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path e:cd ] , [ sh:path e:mark ; sh:maxCount 1 ] .
"""


def test_chains_start_at_their_selective_end(spark):
    rows = [(f"<urn:a/{k}>", "<urn:c:ab>", f"<urn:b/{k % 50}>") for k in range(500)] + [(f"<urn:b/{k}>", "<urn:c:bc>", f"<urn:n/{k % 20}>") for k in range(50)]
    rows += [(f"<urn:n/{k}>", "<urn:c:cd>", f"<urn:d/{k}>") for k in range(20)] + [(f"<urn:{t}/{k}>", "<urn:c:mark>", f'"{t}{k}"') for t, n in (("n", 20), ("a", 500)) for k in range(n)]
    rows += [(f"<urn:a/{k}>", f"<{TYPE}>", "<urn:c:A>") for k in range(500)]
    path = shared_folder(spark, "store-chain")
    build_store(spark.createDataFrame(rows, "s string, p string, o string"), path)
    cat = Catalog.build([source(CHAIN)], build_id="c")
    table = FactsTable(spark.createDataFrame([(None, *r) for r in rows], "g string, s string, p string, o string"))
    ab, bc, cd = "urn:c:ab", "urn:c:bc", "urn:c:cd"
    for marked, value, order in ((0, "a7", (ab, bc, cd)), (2, "n7", (cd, bc, ab))):
        b = PlanBuilder(cat)
        made = [b.entity("urn:c:AShape"), b.entity(), b.entity(), b.entity()]
        b.edge(b.lens(made[0], "urn:c:AShape"), ab, made[1]).edge(b.lens(made[1], "urn:c:BShape"), bc, made[2]).edge(b.lens(made[2], "urn:c:CShape"), cd, made[3])
        b.eq(b.lens(made[marked], "urn:c:CShape" if marked else "urn:c:AShape"), "urn:c:mark", Term.literal(value)).node(made[0], "one").node(made[3], "four")
        compiled = Engine(spark, StoredFacts(spark, path), cat, EVERYONE, DatasetScope(), LOOSE).compile(b.raw)
        assert compiled.order == order
        want = Engine(spark, table, cat, EVERYONE, DatasetScope(), LOOSE).compile(b.raw)
        assert sorted(map(tuple, compiled.rows.collect())) == sorted(map(tuple, want.rows.collect()))
