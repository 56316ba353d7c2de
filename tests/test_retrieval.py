import pytest
from graphs import EVERYONE, EX, Builder, catalog, facts
from pyspark.sql import functions as F

from factgraph.engine import Engine
from factgraph.errors import CatalogError, PlanError
from factgraph.functions.terms import Term
from factgraph.operators import metrics, profile, retrieval
from factgraph.plans.builder import PlanBuilder
from factgraph.plans.query import QueryPolicy
from factgraph.sources.facts import FactsTable


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, FactsTable(facts(spark).cache()), catalog(), EVERYONE, policy=QueryPolicy(timeout_seconds=120))


def test_cards_and_ranking(spark, engine):
    note = "kind string, shape string, predicate string, inverse boolean, label string, aliases array<string>, description string, provider_allowed boolean"
    rows = [("lens", EX + "WorkShape", None, None, "Worker", ["staff"], "people at work", True), ("property", EX + "WorkShape", EX + "on", False, "works on", [], "jobs of a worker", True), ("property", EX + "JobShape", EX + "on", True, "worked by", [], "workers", True), ("property", EX + "WorkShape", EX + "can", False, "skills", [], "hidden", False)]
    cards = retrieval.approved_cards(engine.catalog, spark.createDataFrame(rows, note)).collect()
    assert {(c.kind, c.label) for c in cards} == {("lens", "Worker"), ("property", "works on"), ("property", "worked by")}
    df = spark.createDataFrame([("g1", "a", "red paint"), ("g1", "b", "red red car"), ("g2", "c", "the red paint shop"), ("g2", "d", "nothing"), ("g3", "e", "zero")], "lens string, key string, text string")
    got = retrieval.rank_cards(df, F.lit("Where is the RED paint?"), 3).orderBy("position").collect()
    assert [(r.key, r.score, r.group_score) for r in got] == [("a", 2, 3), ("b", 1, 3), ("c", 2, 2)]


def test_entities(spark):
    labels = spark.createDataFrame([("urn:a", ["Priya", "P. Rao"]), ("urn:b", ["priya!"]), ("urn:c", ["Team-One"])], "iri string, names array<string>")
    asked = spark.createDataFrame([("PRIYA",), ("team one",), ("p rao",), ("who",), ("",)], "mention string")
    got = {r.mention: (r.status, r.iri) for r in retrieval.resolve_entities(asked, labels).collect()}
    assert got == {"PRIYA": ("ambiguous", None), "team one": ("resolved", "urn:c"), "p rao": ("resolved", "urn:a"), "who": ("unsupported", None), "": ("unsupported", None)}


def proposal(engine, bound=None, key=None):
    b = Builder(engine.catalog)
    who, job = b.entity(), b.entity(bound)
    b.select(who, "WorkShape").edge(b.lens(who, "WorkShape"), "on", job).node(who)
    if key:
        b.raw["edges"][0]["property_key"] = key
    atoms = ["selectors0", "edges0", "projections0"]
    return {"intents": [{"atom": a} for a in atoms], "mentions": {job: "red one"}, "plan": b.raw}


def test_asking_with_a_planner(engine):
    cards = [{"key": k} for k in engine.catalog.by_key]
    names = {"red one": ("resolved", EX + "red"), "two": ("ambiguous", None)}
    resolve = lambda m: names.get(m, ("unsupported", None))
    calls = []

    def run(*proposals, cards=cards):
        calls.clear()

        def planner(question, given):
            calls.append(question)
            return proposals[min(len(calls), len(proposals)) - 1]

        return retrieval.ask(engine, planner, "who is on the red one?", cards, resolve)

    done = run(proposal(engine))
    assert done.status == "completed" and len(done.outcome.rows) == 2 and len(calls) == 1
    assert run({"plan": 1}, proposal(engine)).status == "completed" and len(calls) == 2
    assert run("nonsense").status == "unsupported" and len(calls) == 2
    assert run(proposal(engine, bound="red")).status == "unsupported"
    assert run(proposal(engine), cards=cards[:1]).reason == "plan leaves its cards"
    less = proposal(engine)
    less["intents"].pop()
    assert run(less).status == "unsupported"
    other = proposal(engine)
    other["mentions"] = {k: "two" for k in other["mentions"]}
    assert run(other).status == "ambiguous"


def test_templates_and_handles(engine):
    raw = proposal(engine, bound="red")["plan"]
    slot = retrieval.Slot("job", "entity", ("entities", 1, "binding"))
    filled = retrieval.instantiate(raw, [slot], {"job": EX + "blue"})
    assert engine.execute_plan(filled).rows[0].values[0] == Term.iri(EX + "ann") and raw["entities"][1]["binding"]["value"] == EX + "red"
    enum = retrieval.Slot("job", "enum", ("entities", 1, "binding"), {"the red one": Term.iri(EX + "red")})
    assert engine.prepare(retrieval.instantiate(raw, [enum], {"job": "the red one"})).digest == engine.prepare(raw).digest
    for slots, values in (([slot], {}), ([enum], {"job": "x"}), ([slot], {"job": "no iri"}), ([retrieval.Slot("job", "entity", ("entities", 7))], {"job": EX + "x"})):
        with pytest.raises(PlanError):
            retrieval.instantiate(raw, slots, values)
    short, back = retrieval.handles([("lens", "k1"), ("property", "k2"), ("lens", "k3")])
    assert short == {"k1": "L0", "k2": "P0", "k3": "L1"} and all(back[v] == k for k, v in short.items())
    assert retrieval.connecting_path(engine.catalog, EX + "NameShape", EX + "JobShape") == []
    assert retrieval.connecting_path(engine.catalog, EX + "JobShape", EX + "WorkShape")[0] == EX + "JobShape"


def test_builder(engine):
    b = PlanBuilder(engine.catalog)
    w = b.entity(EX + "WorkShape")
    lens = b.lens(w, EX + "NameShape")
    b.exists(lens, EX + "nick").field(lens, EX + "code", "code", required=False).node(w, "who")
    assert [tuple(r) for r in b.frame(engine).collect()] == [(Term.literal("1", "http://www.w3.org/2001/XMLSchema#integer").token, f"<{EX}bob>")]
    for bad in (lambda: b.entity(EX + "None"), lambda: b.field(lens, EX + "none", "x"), lambda: b.entity(EX + "OddShape")):
        with pytest.raises(CatalogError):
            bad()


def test_metrics_and_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 10)], "g string, v int")
    assert metrics.summary(df, "v", ["g"], [["g"], []]).filter("g IS NULL").first().total == 13
    row = metrics.gates(df, {"low": F.col("v") < 5, "all": F.col("v") > 0}).first()
    assert (row.low, row.all, row.all_gates) == (False, True, False)
    assert metrics.gates(df.limit(0), {"x": F.col("v") > 0}).first().all_gates is True
    assert df.agg(metrics.ratio(F.col("v") > 1).alias("r")).first().r == 2 / 3 and df.limit(0).agg(metrics.ratio(F.col("v") > 1).alias("r")).first().r is None
    assert df.agg(metrics.nearest_rank("v", 0.95).alias("p")).first().p == 10
    assert metrics.multiset_difference(df, df).count() == 0 and metrics.multiset_difference(df, df.limit(1)).count() == 2
    at = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("q", 3, True)], "q string, position int, relevant boolean")
    assert tuple(metrics.at_k(at, 2, "q", [F.col("position")], F.col("relevant")).first())[1:] == (0.5, 0.5)
    got = metrics.percentiles(spark.createDataFrame([("a", v) for v in (4, 1, 2, 2)] + [("b", None)], "g string, v int"), "g", "v", {"p25": 0.25, "p50": 0.5, "p95": 0.95})
    assert {tuple(r) for r in got.collect()} == {("a", 4, 1, 2, 4, 2.0, 4), ("b", 1, None, None, None, None, None)}
    assert {tuple(r) for r in metrics.dedup_by(df, F.col("g"), F.col("v")).collect()} == {("a", 1, 2), ("b", 10, 1)}
    assert metrics.multiset_intersection(df, df.limit(1)).count() == 1
    pairs = spark.createDataFrame([("k", 1, 2), ("k", 2, 3)], "k string, a int, b int")
    assert tuple(metrics.set_overlap(pairs, "k", "a", "b").first()) == ("k", 1, 1)
    bands = spark.createDataFrame([(n,) for n in (0, 1, 2, 10, 11, 100, 101)], "n int").select(profile.band(F.col("n")).alias("b"))
    assert [r.b for r in bands.collect()] == ["0", "1", "2-10", "2-10", "11-100", "11-100", ">100"]
    own = facts(spark)
    assert {(r.cls.split("/")[-1][:-1], r.n_nodes) for r in profile.type_counts(own).collect()} == {("Worker", 4), ("Boss", 1), ("Job", 2), ("Skill", 2)}
    assert profile.observed(own).filter("o_kind = 'literal' AND datatype IS NULL").count() == 0
