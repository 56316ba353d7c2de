"""Queries of sources, catalogs, outcomes, packets and reports over the tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph import queries as own
from factgraph.engine import render_result
from factgraph.functions.terms import TYPE, XSD, literal_token, token_datatype, token_kind, token_value
from factgraph.operators import evidence, harness, profile
from factgraph.plans.builder import PlanBuilder
from factgraph.plans.query import ExecutionRequest
from factgraph.sources.facts import FactsTable
from factgraph.sources.shared import shared_folder
from factgraph.sources.turtle import read_nquads, write_nquads
from factgraph.tables import EDGES, FIELDS, STORED, STORED_CLASSES, TD, as_facts, mapped, store_engine, table_engine

QUERIES: dict = {}
SQL: dict[str, str] = {}
S, _tok, _lit = own.S, own._tok, own._lit


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


# Sources


@query("""WITH f AS (SELECT DISTINCT CASE WHEN year(l_shipdate) > 1992 THEN year(l_shipdate) END AS g, l_orderkey AS s, l_partkey AS o FROM lineitem)
SELECT 'default' AS scope, count(*) AS n_facts FROM (SELECT DISTINCT s, o FROM f WHERE g IS NULL) a UNION ALL SELECT 'one graph', count(*) FROM (SELECT DISTINCT s, o FROM f WHERE g = 1995) b
UNION ALL SELECT 'two graphs', count(*) FROM (SELECT DISTINCT s, o FROM f WHERE g IN (1995, 1996)) c UNION ALL SELECT 'no such graph', 0""")
def source_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the default graph and of named ones; a fact of two graphs is one fact of both."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("y", F.year("l_shipdate"))
    tok = lambda kind, c: F.concat(F.lit(f"<{TD}{kind}/"), F.col(c).cast("string"), F.lit(">"))
    facts = rows.select(F.when(F.col("y") > 1992, tok("year", "y")).alias("g"), tok("order", "l_orderkey").alias("s"), F.lit(f"<{TD}order-part>").alias("p"), tok("part", "l_partkey").alias("o")).distinct()
    scopes = {"default": (), "one graph": (1995,), "two graphs": (1995, 1996), "no such graph": (1,)}
    count = lambda ys: FactsTable(facts, tuple(f"{TD}year/{y}" for y in ys)).relation(TD + "order-part").rows.agg(F.count("*").alias("n_facts"))
    return reduce(DataFrame.unionByName, [count(ys).select(F.lit(n).alias("scope"), "n_facts") for n, ys in scopes.items()])


@query(f"""SELECT DISTINCT CASE WHEN year(l_shipdate) > 1992 THEN '<urn:td:year/' || year(l_shipdate) || '>' END AS g, {_tok('order', 'l_orderkey')} AS s, '<urn:td:order-part>' AS p, {_tok('part', 'l_partkey')} AS o FROM lineitem
UNION ALL SELECT NULL, {_tok('part', 'p_partkey')}, '<urn:td:part-name>', '"' || p_name || '"@en' FROM part""")
def source_nquads(spark, sf_dir):
    """Facts of several graphs written as N-Quads and read back by several tasks."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("y", F.year("l_shipdate"))
    tok = lambda kind, c: F.concat(F.lit(f"<{TD}{kind}/"), F.col(c).cast("string"), F.lit(">"))
    facts = rows.select(F.when(F.col("y") > 1992, tok("year", "y")).alias("g"), tok("order", "l_orderkey").alias("s"), F.lit(f"<{TD}order-part>").alias("p"), tok("part", "l_partkey").alias("o"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(None).cast("string").alias("g"), tok("part", "p_partkey").alias("s"), F.lit(f"<{TD}part-name>").alias("p"), F.concat(literal_token(F.col("p_name")), F.lit("@EN")).alias("o"))
    folder = shared_folder(spark, "nquads")
    write_nquads(facts.unionByName(parts), folder)
    return read_nquads(spark, folder)


@query(f"SELECT count(*) AS n_facts, CAST(sum(strlen(s || ' ' || p || ' ' || o) + 3) AS BIGINT) AS n_bytes FROM ({own._STORED_SQL}) f")
def source_budget(spark, sf_dir):
    """What a source's facts take as N-Triples, to be held against a budget."""
    return profile.source_size(as_facts(mapped(spark, sf_dir, sets=False), STORED, STORED_CLASSES, once=True), once=True)


@query(f"SELECT 'order' AS what, {_tok('order', 'o_orderkey')} AS s, CASE WHEN o_orderkey % 10 = 3 THEN '<urn:td:customer/none>' ELSE {_tok('customer', 'o_custkey')} END AS o FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT 'class', {_tok('order', 'o_orderkey')}, '<urn:td:Customer>' FROM orders WHERE o_orderkey % 10 = 4")
def fact_probe(spark, sf_dir):
    """Single facts looked up in their physical direction: those that are not there."""
    src = mapped(spark, sf_dir)
    rows = as_facts(src, ["order-customer"]).withColumn("d", F.regexp_extract("s", r"(\d)>$", 1).cast("int"))
    asked = rows.select(F.lit("order").alias("what"), "s", F.lit(TD + "order-customer").alias("p"), F.when(F.col("d") == 3, F.lit("<urn:td:customer/none>")).otherwise(F.col("o")).alias("o"))
    asked = asked.unionByName(rows.filter("d IN (4, 5)").select(F.lit("class").alias("what"), "s", F.lit(TYPE).alias("p"), F.when(F.col("d") == 4, f"<{TD}Customer>").otherwise(f"<{TD}Order>").alias("o")))
    return evidence.not_in_data(asked, src, {TD + "order-customer"}, {TD + "Customer", TD + "Order"}).select("what", "s", "o")


@query(f"SELECT token, kind, value, dt AS datatype FROM (SELECT DISTINCT {_lit('p_size', 'integer')} AS token, 'literal' AS kind, CAST(p_size AS VARCHAR) AS value, '{XSD}integer' AS dt FROM part UNION SELECT {_lit('p_brand')}, 'literal', p_brand, NULL FROM part UNION SELECT {own._N}, 'iri', 'urn:td:nation/' || n_nationkey, NULL FROM nation) u")
def fn_term_parts(spark, sf_dir):
    """Tokens taken apart."""
    src = mapped(spark, sf_dir)
    tokens = as_facts(src, ["part-size", "part-brand"]).select(F.col("o").alias("token")).unionByName(as_facts(src, ["nation-region"]).select(F.col("s").alias("token"))).distinct()
    return tokens.select("token", token_kind(F.col("token")).alias("kind"), token_value(F.col("token")).alias("value"), token_datatype(F.col("token")).alias("datatype"))


# Catalogs and reports


def _report_sql() -> str:
    """Counts of each property of each shape, forwards ones; shapes that look at the same facts differently included."""
    one = lambda shape, name, scalar, t, k, v, odd="0": f"SELECT '{TD}{shape}Shape' AS shape, '{TD}{name}' AS predicate, {scalar} AS scalar, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_facts, count(*) AS n_nodes, count(*) FILTER (WHERE n > 1) AS n_several, CAST(coalesce(sum(odd), 0) AS BIGINT) AS n_outside FROM (SELECT {k}, count(DISTINCT {v}) AS n, {odd} AS odd FROM {t} WHERE {k} IS NOT NULL AND {v} IS NOT NULL GROUP BY {k}) x"
    parts = []
    for n, (c, t, k, x, _) in FIELDS.items():
        value = "date_trunc('second', ts)" if "date_format(ts" in x else "o_orderdate" if "date_format" in x else x.replace("string", "VARCHAR")
        parts.append(one(c, n, "TRUE", t, k, value))
    parts += [one(s, n, "FALSE", t, a, b) for n, (s, _, t, a, b, _) in EDGES.items()]
    parts.append(one("Segment", "customer-segment-node", "FALSE", "customer", "c_custkey", "c_mktsegment", "max(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END)"))
    parts.append(one("RichOrder", "order-customer", "FALSE", "orders", "o_orderkey", "o_custkey"))
    parts.append(one("SinglePart", "order-part", "TRUE", "lineitem", "l_orderkey", "l_partkey"))
    parts.append(one("Toxic", "document-toxic", "TRUE", "labels", "doc_id", "toxic", "max(CASE WHEN toxic = 1 THEN 0 ELSE 1 END)"))
    return " UNION ALL ".join(parts)


@query(_report_sql())
def catalog_report(spark, sf_dir):
    """Every contract of the catalog beside the data: facts, nodes, nodes with several values, values that are not accepted."""
    engine = table_engine(spark, sf_dir)
    return profile.contract_report(engine.source, engine.catalog)


@query("SELECT unnest(['sel_union', 'edge_inverse', 'edge_bound', 'chain_join', 'self_join', 'cycle_join']) AS fixture, unnest([0, 0, 0, 0, 0, 0]) AS missing, unnest([0, 0, 0, 0, 0, 0]) AS unexpected, unnest([TRUE, TRUE, TRUE, TRUE, TRUE, TRUE]) AS ok")
def conformance_tables(spark, sf_dir):
    """Plans over the tables and over the store, their rows as multisets."""

    def rows(engine) -> DataFrame:
        out = None
        for run in (own.sel_union, own.edge_inverse, own.edge_bound, own.chain_join, own.self_join, own.cycle_join):
            b = PlanBuilder(engine.catalog)
            run.fill(b)
            df = b.frame(engine)
            part = df.select(F.lit(run.__name__).alias("fixture"), F.array(*sorted(df.columns)).alias("values"))
            out = part if out is None else out.unionByName(part)
        return out

    return harness.fixture_matrix(rows(table_engine(spark, sf_dir)), rows(store_engine(spark, sf_dir)))


@query("SELECT median(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END) AS median_ratio, median(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END) <= 1 AS ok FROM lineitem")
def paired_ratio(spark, sf_dir):
    """Pairs without a number to divide by count for nothing."""
    return harness.paired_ratio(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_discount", "l_tax")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def failure_counts(spark, sf_dir):
    return harness.failure_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


# Executions


def _customers_of(b, nation: str) -> None:
    c, n = b.entity(S("Customer")), b.entity(bound=TD + nation)
    b.edge(b.lens(c, S("Customer")), TD + "customer-nation", n).node(c, "customer")


def _parts_of(b) -> None:
    o = b.entity(bound=TD + "order/3")
    b.field(b.lens(o, S("SinglePart")), TD + "order-part", "part").node(o, "ord")


def _raw(engine, fill, kind: str = "select") -> dict:
    b = PlanBuilder(engine.catalog, kind)
    fill(b)
    return b.raw


_OF3 = "SELECT count(*) AS n FROM customer WHERE c_nationkey = 3"
_FEW = "CASE WHEN n = 0 THEN 'no_match' WHEN n > 1000 THEN 'policy_limited' ELSE 'selected' END"


@query(f"""SELECT 'customers of a nation' AS run, {_FEW} AS kind, CASE WHEN n <= 1000 THEN n END AS n_rows, CASE WHEN n <= 1000 THEN FALSE END AS more, CASE WHEN n <= 1000 THEN 'complete' END AS completeness FROM ({_OF3}) a
UNION ALL SELECT 'five of them', CASE WHEN n = 0 THEN 'no_match' ELSE 'selected' END, least(n, 5), n > 5, CASE WHEN n > 5 THEN 'incomplete' ELSE 'complete' END FROM ({_OF3}) b
UNION ALL SELECT 'of no nation', 'no_match', 0, FALSE, 'complete' UNION ALL SELECT 'all orders', {_FEW}, CASE WHEN n <= 1000 THEN n END, CASE WHEN n <= 1000 THEN FALSE END, CASE WHEN n <= 1000 THEN 'complete' END FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders) c
UNION ALL SELECT 'is there one', CASE WHEN n > 0 THEN 'boolean' ELSE 'no_match' END, 0, FALSE, 'complete' FROM ({_OF3}) d
UNION ALL SELECT 'one part an order', CASE n WHEN 0 THEN 'no_match' WHEN 1 THEN 'selected' ELSE 'failed' END, CASE WHEN n < 2 THEN n ELSE 0 END, FALSE, CASE WHEN n < 2 THEN 'complete' ELSE 'unknown' END FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_orderkey = 3) e
UNION ALL SELECT 'cancelled', 'failed', NULL, NULL, NULL""")
def table_outcomes(spark, sf_dir):
    """Executions over the tables: what they return, and what they say of it."""
    engine = table_engine(spark, sf_dir)
    some = lambda b: _customers_of(b, "nation/3")
    runs = {
        "customers of a nation": (_raw(engine, some), None),
        "five of them": (_raw(engine, some), ExecutionRequest.examples(5)),
        "of no nation": (_raw(engine, lambda b: _customers_of(b, "nation/999")), None),
        "all orders": (_raw(engine, lambda b: b.node(b.entity(S("Order")), "ord")), None),
        "is there one": (_raw(engine, lambda b: b.edge(b.lens(b.entity(S("Customer")), S("Customer")), TD + "customer-nation", b.entity(bound=TD + "nation/3")), "ask"), None),
        "one part an order": (_raw(engine, _parts_of), None),
        "cancelled": (_raw(engine, some), ExecutionRequest(cancelled=True)),
    }
    out = []
    for name, (raw, request) in runs.items():
        got = engine.execute_plan(raw, request)
        p = getattr(got, "packet", None)
        out.append((name, got.kind, *((p.row_count, p.more, p.completeness) if p else (None,) * 3)))
    return spark.createDataFrame(out, "run string, kind string, n_rows long, more boolean, completeness string")


_FIRST = f"SELECT {_lit('c_name')} AS name, {_tok('customer', 'c_custkey')} AS customer FROM customer WHERE c_nationkey = 3 ORDER BY c_name, customer LIMIT 10"


@query(f"SELECT row_number() OVER (ORDER BY name, customer) AS line, name || chr(9) || customer AS text FROM ({_FIRST}) f UNION ALL SELECT 11, '... more rows exist' WHERE ({_OF3}) > 10")
def table_text(spark, sf_dir):
    """An outcome as text, rows in the canonical order."""
    engine = table_engine(spark, sf_dir)

    def fill(b):
        c, n = b.entity(S("Customer")), b.entity(bound=TD + "nation/3")
        lens = b.lens(c, S("Customer"))
        b.edge(lens, TD + "customer-nation", n).field(lens, TD + "customer-name", "name").node(c, "customer")

    text = render_result(engine.execute_plan(_raw(engine, fill), ExecutionRequest.examples(10)))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line long, text string")


_TEN = f"SELECT {_tok('customer', 'c_custkey')} AS customer, '<urn:td:nation/3>' AS nation FROM customer WHERE c_nationkey = 3 ORDER BY 1 LIMIT 10"


@query(f"""SELECT 'selector0' AS atom, 'selector' AS kind, 'witnessed' AS status, {own._witness('selector0', 'customer', TYPE, f"'<{TD}Customer>'").replace(' AS id', ' AS witness')} FROM ({_TEN}) a
UNION ALL SELECT 'edge0', 'edge', 'witnessed', {own._witness('edge0', 'customer', TD + 'customer-nation', 'nation')} FROM ({_TEN}) b
UNION ALL SELECT 'edge0', 'edge', 'witnessed', {own._witness('edge0', 'nation', TYPE, f"'<{TD}Nation>'")} FROM ({_TEN}) c
UNION ALL SELECT 'shown0', 'projection', 'derived', NULL, NULL, NULL, NULL FROM ({_TEN}) d""")
def table_packet(spark, sf_dir):
    """The packet of an execution as a table of supports."""
    engine = table_engine(spark, sf_dir)
    got = engine.execute_plan(_raw(engine, lambda b: _customers_of(b, "nation/3")), ExecutionRequest.examples(10), execution_id=own.RUN)
    return evidence.packet_supports(spark, got.packet).select("atom", "kind", "status", "witness", "s", "p", "o")
