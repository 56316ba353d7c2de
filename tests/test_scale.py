"""What keeps work in step with the input: orders of joins, sizes of what is shuffled."""

import os
from functools import reduce

import pytest
from pyspark.sql import functions as F

from factgraph import queries, table_queries
from factgraph.functions.terms import TYPE
from factgraph.operators import evidence, profile
from factgraph.plans.builder import PlanBuilder
from factgraph.sources import store as store_source
from factgraph.sources.facts import MappedTables, Template
from factgraph.sources.shared import stored
from factgraph.sources.store import StoredFacts, build_store
from factgraph.tables import TD, as_facts, mapped, store_engine, table_engine

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def test_a_cycle_is_not_entered_through_its_hub(spark):
    engine = table_engine(spark, TABLES)
    b = PlanBuilder(engine.catalog)
    queries.cycle_join.fill(b)
    # All pairs of customers and suppliers of a nation would come of the other order.
    assert engine.compile(b.raw).order == tuple(TD + n for n in ("order-customer", "customer-nation", "order-supplier", "supplier-nation"))


def _over_store(spark, query):
    engine = store_engine(spark, TABLES)
    b = PlanBuilder(engine.catalog)
    query.fill(b)
    return engine.compile(b.raw)


def test_a_cycle_over_the_store_starts_where_fewest_rows_come_of_it(spark, monkeypatch):
    counts, size = StoredFacts.counts, StoredFacts.class_size

    def more(self, predicate):  # a thousand times the tables, but no more nations
        c = counts(self, predicate)
        return store_source.Counts(1000 * c.facts, 1000 * c.subjects, c.objects if predicate.endswith("-nation") else 1000 * c.objects)

    monkeypatch.setattr(StoredFacts, "counts", more)
    monkeypatch.setattr(StoredFacts, "class_size", lambda *a: 1000 * size(*a))
    # From the suppliers, the smallest edge, all facts of orders would be dealt out twice.
    assert _over_store(spark, queries.cycle_join).order == tuple(TD + n for n in ("customer-nation", "order-customer", "order-supplier", "supplier-nation"))


def test_facts_met_by_few_rows_lie_as_they_are(spark, monkeypatch):
    """Neither classes nor facts are dealt out, however large: every scan of facts is one of buckets."""
    monkeypatch.setattr(store_source, "SMALL", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(_over_store(spark, queries.self_join).rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [x for x in plan.splitlines() if "FileScan" in x and "facts_" in x]
    assert len(scans) == 5 and all("Bucketed: true" in x for x in scans), plan


def test_a_store_writes_its_facts_once_in_each_order(spark, tmp_path):
    """Beside both orders, only terms and counts are written; a third copy of the facts would be shuffled three times more."""
    rows = [(f"<urn:s/{k // 3}>", f"<urn:p/{k % 3}>", f"<urn:o/{k * 7919 % 1009}>") for k in range(6000)]
    facts = spark.createDataFrame(rows, "s string, p string, o string")
    folder = f"file://{tmp_path}/store"
    build_store(facts.unionByName(facts), folder)
    assert {x.name for x in (tmp_path / "store").iterdir()} == {"ranges", "terms", "objects", "subjects", "layout", "characteristics", "predicates", "classes"}
    store = StoredFacts(spark, folder)
    held = store.tokens(store.orders["subjects"], {c: (f"_{c}", "id") for c in "spo"}).select("_s", "_p", "_o").collect()
    assert sorted(map(tuple, held)) == sorted(rows)


def test_facts_of_a_hot_term_get_their_ids_in_several_tasks(spark):
    """Dealt by a constant beside the term, they all went to one."""
    facts = spark.range(400).selectExpr("id AS s", "0L AS p", "7L AS o")
    codes = spark.createDataFrame([(7, 1, 0, 0, 400, 0), (8, 2, 1, 0, 1, 0)], "h long, id long, n_s long, n_p long, n_o long, n_g long")
    out = store_source._coded(facts, "o", "s", "n_o", codes, 400, 4)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(tuple, out.select("s", "p", "o").collect())) == [(k, 0, 1) for k in range(400)]


def test_a_store_of_keys_is_the_store_of_their_tokens(spark, tmp_path):
    """Repeated facts, numbers too large for a code of their own, negative ones, no numbers at all."""
    rows = [(1, 2, "x"), (1, 2, "x"), (-5, 2**60, 'a "quoted" one'), (2**60, 2, "x"), (2**60, None, None), (None, 2, "y"), (9, 9, "<urn:n/9>")]
    spark.createDataFrame(rows, "a long, b long, c string").write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    pairs = lambda x, y: lambda _: table.selectExpr(f"{x} AS src", f"{y} AS dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    members = lambda _: table.selectExpr("a AS node").filter("node IS NOT NULL")
    source = MappedTables(spark, {"n": Template("urn:n/"), "m": Template("urn:m/"), "t": Template("urn:t/", "string")}, {"urn:C": (members, "n"), "urn:none": (lambda _: members(_).filter("node = 0"), "n")}, {"urn:ab": (pairs("a", "b"), "n", "m"), "urn:ac": (pairs("a", "c"), "n", "lit"), "urn:cb": (pairs("c", "b"), "t", "m"), "urn:no": (lambda _: pairs("a", "b")(_).filter("src = 0"), "n", "m")})
    names, classes = ["urn:ab", "urn:ac", "urn:cb", "urn:no"], ["urn:C", "urn:none"]
    tokens = [source.relation(n) for n in names]
    tokens = [r.rows.select(source.render(F.col("src"), r.src).alias("s"), F.lit(f"<{n}>").alias("p"), source.render(F.col("dst"), r.dst).alias("o")) for n, r in zip(names, tokens, strict=True)]
    tokens += [source.members(c)[0].select(source.render(F.col("node"), "n").alias("s"), F.lit(f"<{TYPE}>").alias("p"), F.lit(f"<{c}>").alias("o")) for c in classes]
    facts = reduce(lambda x, y: x.unionByName(y), tokens)
    held = []
    for name, given in (("keys", store_source.KeyedFacts(source, names, classes)), ("tokens", facts)):
        build_store(given, f"file://{tmp_path}/{name}")
        own = [sorted(map(repr, spark.read.parquet(f"file://{tmp_path}/{name}/{x}").select(*c).collect())) for x, c in (("terms", ["id", "token"]), ("subjects", "spo"), ("objects", "spo"), ("characteristics", ["ps", "n_subjects", "facts"]), ("predicates", ["p", "n_facts", "n_subjects", "n_objects"]), ("classes", ["o", "n"]))]
        held.append(own)
    assert held[0] == held[1] and len(held[0][1]) == facts.distinct().count()


def test_sets_of_more_predicates_than_a_long_has_bits(spark, tmp_path):
    rows = [(f"<urn:s/{k}>", f"<urn:p/{j:03}>", "<urn:o>") for k in range(3) for j in range(0, 130, k + 1)]
    build_store(spark.createDataFrame(rows, "s string, p string, o string"), f"file://{tmp_path}/store")
    store = StoredFacts(spark, f"file://{tmp_path}/store")
    assert store.star([f"urn:p/{j:03}" for j in (0, 64, 126)]) == (2, 2.0) and store.star(["urn:p/006", "urn:p/066"]) == (3, 3.0) and store.star(["urn:p/003"]) == (2, 2.0)


def test_terms_with_equal_hashes_stay_apart(spark, tmp_path, monkeypatch):
    """The first hash puts all terms together; another one is taken."""
    monkeypatch.setattr(store_source, "_hashed", lambda token, seed: F.xxhash64(F.lit(seed), token) if seed else F.length(token).cast("long"))
    rows = [(f"<urn:s/{k % 9}>", "<urn:p>", f'"{k % 5}"') for k in range(45)]
    build_store(spark.createDataFrame(rows, "s string, p string, o string"), f"file://{tmp_path}/store")
    store = StoredFacts(spark, f"file://{tmp_path}/store")
    held = store.tokens(store.orders["objects"], {c: (f"_{c}", "id") for c in "spo"}).select("_s", "_p", "_o").collect()
    assert sorted(map(tuple, held)) == sorted(set(rows))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["source_budget", "profile_fanout", "profile_cardinality_bands"])
def test_facts_of_tables_are_made_a_set_by_their_keys(spark, name):
    plan = _plan({**queries.QUERIES, **table_queries.QUERIES}[name](spark, TABLES))
    assert "hashpartitioning(src#" in plan and "hashpartitioning(s#" not in plan and "hashpartitioning(p#, s#" not in plan


@pytest.mark.parametrize("name", ["self_join", "scalar_observed", "ranked_fusion", "hybrid_retrieval", "fact_probe"])
def test_rows_are_dealt_out_before_they_are_grouped(spark, name):
    assert "REPARTITION_BY_NUM" in _plan({**queries.QUERIES, **table_queries.QUERIES}[name](spark, TABLES))


def test_nodes_that_are_no_keys_of_a_class_do_not_meet_in_one_task(spark):
    asked = spark.range(0, 400, 1, 4).select(F.format_string("<urn:td:order/%d>", "id").alias("s"), F.lit(TYPE).alias("p"), F.lit(f"<{TD}Customer>").alias("o"))
    out = evidence.not_in_data(asked, mapped(spark, TABLES), set(), {TD + "Customer"})
    assert out.count() == 400 and out.select(F.spark_partition_id()).distinct().count() > 1


def test_repeated_pairs_are_one_value(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 2)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    source = mapped(spark, str(tmp_path), sets=False)
    assert sorted((r.n, r.n_nodes) for r in profile.degrees(source, [TD + "order-part"]).collect()) == [(1, 1), (2, 1)]
    size = profile.source_size(as_facts(source, ["order-part"], once=True), once=True).first()
    assert size == profile.source_size(as_facts(source, ["order-part"])).first() and size.n_facts == 3


def test_nquads_are_written_by_more_tasks_where_there_is_more_to_read(spark, tmp_path):
    spark.read.parquet(f"{TABLES}/lineitem.parquet").repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{TABLES}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    assert len(table_queries.source_nquads(spark, str(tmp_path)).inputFiles()) > 4


def test_no_batch_of_a_stream_is_written_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda *a: pytest.fail("one task for a batch"))
    assert queries.live_certificates(spark, TABLES).count() > 0


def test_rounds_and_paths_are_written_small(spark):
    files = stored(spark.range(1000).selectExpr("concat('<urn:td:order/', id, '>') AS node"), "small").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
