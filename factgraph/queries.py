"""The queries of the library's own operators over the tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.functions.terms import TYPE, XSD, Term, effective_datatype, normal_label, sort_fields
from factgraph.operators import closed, metrics, paths, profile, retrieval, search, witness
from factgraph.plans.builder import PlanBuilder
from factgraph.sources.facts import FactsTable
from factgraph.sources.shared import stored
from factgraph.tables import TD, as_facts, mapped, store_engine, table_engine

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _tok(kind: str, column: str) -> str:
    return f"'<urn:td:{kind}/' || {column} || '>'"


def _lit(column: str, datatype: str = "") -> str:
    tail = f"'\"^^<{XSD}{datatype}>'" if datatype else "'\"'"
    return f"'\"' || {column} || {tail}"


def plan(sql: str, limit: int | None = None):
    """Register a query whose body is a plan."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = table_engine(spark, sf_dir)
            b = PlanBuilder(engine.catalog)
            f(b)
            return b.frame(engine, limit)

        run.__name__, run.fill = f.__name__, f
        return query(sql)(run)

    return put


def over_store(run) -> None:
    """Register the same plan over the dictionary-encoded store, with the same SQL."""

    def on_store(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = store_engine(spark, sf_dir)
        b = PlanBuilder(engine.catalog)
        run.fill(b)
        return b.frame(engine)

    on_store.__name__ = f"store_{run.__name__}"
    query(SQL[run.__name__])(on_store)


S = lambda name: f"{TD}{name}Shape"
_N = _tok("nation", "n_nationkey")


@plan(f"SELECT DISTINCT {_tok('customer', 'c_custkey')} AS customer FROM customer")
def sel_type(b):
    b.node(b.entity(S("Customer")), "customer")


@plan(f"SELECT DISTINCT {_tok('nation', 's_nationkey')} AS nation, {_tok('supplier', 's_suppkey')} AS supplier FROM supplier WHERE s_nationkey IN (1, 7, 999)")
def sel_target_nodes(b):
    n, s = b.entity(S("Focus")), b.entity()
    b.edge(b.lens(n, S("Nation")), TD + "supplier-nation", s, inverse=True).node(n, "nation").node(s, "supplier")


@plan(f"SELECT {_tok('region', 'r_regionkey')} AS region FROM region UNION SELECT '<urn:td:region/' || k || '>' FROM (VALUES (2), (77)) v(k)")
def sel_union(b):
    b.node(b.entity(S("Regions")), "region")


@plan(f"SELECT {_tok('customer', 'c_custkey')} AS party FROM customer UNION SELECT {_tok('supplier', 's_suppkey')} FROM supplier")
def sel_multi_class(b):
    b.node(b.entity(S("Party")), "party")


@plan(f"SELECT DISTINCT {_tok('customer', 'c_custkey')} AS customer, {_tok('nation', 'c_nationkey')} AS nation FROM customer WHERE c_nationkey IN (1, 7, 999) AND c_nationkey IN (SELECT n_nationkey FROM nation)")
def sel_on_joined(b):
    c, n = b.entity(S("Customer")), b.entity(S("Focus"))
    b.edge(b.lens(c, S("Customer")), TD + "customer-nation", n).node(c, "customer").node(n, "nation")


@plan(f"SELECT DISTINCT {_tok('customer', 'c_custkey')} AS customer, {_N} AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def edge_direct(b):
    c, n = b.entity(S("Customer")), b.entity()
    b.edge(b.lens(c, S("Customer")), TD + "customer-nation", n).node(c, "customer").node(n, "nation")


@plan(f"SELECT DISTINCT {_N} AS nation, {_tok('supplier', 's_suppkey')} AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def edge_inverse(b):
    n, s = b.entity(S("Nation")), b.entity()
    b.edge(b.lens(n, S("Nation")), TD + "supplier-nation", s, inverse=True).node(n, "nation").node(s, "supplier")


@plan(f"SELECT DISTINCT {_tok('order', 'o_orderkey')} AS ord, {_tok('customer', 'o_custkey')} AS customer FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def edge_class(b):
    o, c = b.entity(S("Order")), b.entity()
    b.edge(b.lens(o, S("RichOrder")), TD + "order-customer", c).node(o, "ord").node(c, "customer")


@plan("SELECT DISTINCT '<urn:td:customer/' || c_custkey || '>' AS customer, '<urn:td:segment/' || c_mktsegment || '>' AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def edge_enum(b):
    c, s = b.entity(S("Customer")), b.entity()
    b.edge(b.lens(c, S("Segment")), TD + "customer-segment-node", s).node(c, "customer").node(s, "segment")


@plan(f"SELECT DISTINCT {_tok('customer', 'c_custkey')} AS customer FROM customer WHERE c_nationkey = 3")
def edge_bound(b):
    c, n = b.entity(S("Customer")), b.entity(bound=TD + "nation/3")
    b.edge(b.lens(c, S("Customer")), TD + "customer-nation", n).node(c, "customer")


STAR_SQL = f"""SELECT DISTINCT {_tok('order', 'o_orderkey')} AS ord, {_lit('o_orderpriority')} AS priority, {_tok('customer', 'c_custkey')} AS customer, {_tok('part', 'l_partkey')} AS part
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_nationkey = 5 AND p_brand = (SELECT min(p_brand) FROM part WHERE p_brand LIKE 'Brand#%')"""


def _brand(spark, sf_dir) -> str:
    return spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_brand LIKE 'Brand#%'").agg(F.min("p_brand")).first()[0] or "none"


def _star(engine, brand: str) -> DataFrame:
    b = PlanBuilder(engine.catalog)
    o, c, n, p = b.entity(S("Order")), b.entity(), b.entity(bound=TD + "nation/5"), b.entity()
    order = b.lens(o, S("Order"))
    b.edge(order, TD + "order-customer", c).edge(b.lens(c, S("Customer")), TD + "customer-nation", n).edge(order, TD + "order-part", p)
    b.eq(b.lens(p, S("Part")), TD + "part-brand", Term.literal(brand))
    return b.node(o, "ord").field(order, TD + "order-priority", "priority").node(c, "customer").node(p, "part").frame(engine)


@query(STAR_SQL)
def star_join(spark, sf_dir):
    return _star(table_engine(spark, sf_dir), _brand(spark, sf_dir))


@query(STAR_SQL)
def store_star_join(spark, sf_dir):
    """The star over longs, in the order that counts of facts suggest."""
    return _star(store_engine(spark, sf_dir), _brand(spark, sf_dir))


@plan(f"SELECT DISTINCT {_tok('order', 'o_orderkey')} AS ord, {_N} AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def chain_join(b):
    o, c, n, r = b.entity(S("Order")), b.entity(), b.entity(), b.entity(bound=TD + "region/2")
    b.edge(b.lens(o, S("Order")), TD + "order-customer", c).edge(b.lens(c, S("Customer")), TD + "customer-nation", n)
    b.edge(b.lens(n, S("Nation")), TD + "nation-region", r).node(o, "ord").node(n, "nation")


@plan(f"SELECT DISTINCT {_tok('order', 'a.l_orderkey')} AS ord, {_tok('part', 'b.l_partkey')} AS part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey = 10")
def self_join(b):
    o, p, q = b.entity(S("Order")), b.entity(bound=TD + "part/10"), b.entity()
    order = b.lens(o, S("Order"))
    b.edge(order, TD + "order-part", p).edge(order, TD + "order-part", q).node(o, "ord").node(q, "part")


@plan(f"SELECT DISTINCT {_tok('customer', 'c_custkey')} AS customer, {_lit('c_name')} AS name FROM customer WHERE c_nationkey = 4 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def multi_lens(b):
    c, s = b.entity(S("Customer")), b.entity()
    main = b.lens(c, S("Customer"))
    b.eq(main, TD + "customer-nation", Term.iri(TD + "nation/4")).field(main, TD + "customer-name", "name")
    b.edge(b.lens(c, S("Segment")), TD + "customer-segment-node", s).node(c, "customer")


@plan(f"SELECT DISTINCT {_tok('order', 'o_orderkey')} AS ord, {_tok('supplier', 's_suppkey')} AS supplier, {_tok('nation', 'c_nationkey')} AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey")
def cycle_join(b):
    o, c, s, n = b.entity(S("Order")), b.entity(), b.entity(), b.entity()
    order = b.lens(o, S("Order"))
    b.edge(order, TD + "order-customer", c).edge(order, TD + "order-supplier", s)
    b.edge(b.lens(c, S("Customer")), TD + "customer-nation", n).edge(b.lens(s, S("Supplier")), TD + "supplier-nation", n)
    b.node(o, "ord").node(s, "supplier").node(n, "nation")


@plan(f"SELECT DISTINCT {_tok('supplier', 's_suppkey')} AS supplier FROM supplier WHERE s_nationkey = 6")
def eq_iri(b):
    s = b.entity(S("Supplier"))
    b.eq(b.lens(s, S("Supplier")), TD + "supplier-nation", Term.iri(TD + "nation/6")).node(s, "supplier")


@plan(f"SELECT DISTINCT {_tok('customer', 'c_custkey')} AS customer FROM customer WHERE c_mktsegment = 'BUILDING'")
def eq_literal(b):
    c = b.entity(S("Customer"))
    b.eq(b.lens(c, S("Customer")), TD + "customer-segment", Term.literal("BUILDING")).node(c, "customer")


@plan(f"SELECT DISTINCT {_tok('part', 'p_partkey')} AS part FROM part WHERE CAST(p_size AS VARCHAR) = '7'")
def eq_typed_lexical(b):
    p = b.entity(S("Part"))
    b.eq(b.lens(p, S("Part")), TD + "part-size", Term.literal("7", XSD + "integer")).node(p, "part")


@plan(f"SELECT {_tok('part', 'p_partkey')} AS part FROM part WHERE CAST(p_size AS VARCHAR) = '07'")
def eq_other_lexical(b):
    p = b.entity(S("Part"))
    b.eq(b.lens(p, S("Part")), TD + "part-size", Term.literal("07", XSD + "integer")).node(p, "part")


@plan(f"SELECT DISTINCT {_tok('order', 'o_orderkey')} AS ord FROM orders WHERE o_custkey = 7 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7 AND c_acctbal > 5000)")
def eq_class(b):
    o = b.entity(S("Order"))
    b.eq(b.lens(o, S("RichOrder")), TD + "order-customer", Term.iri(TD + "customer/7")).node(o, "ord")


@plan(f"SELECT DISTINCT {_tok('document', 'doc_id')} AS document FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exists_filter(b):
    d = b.entity(S("Document"))
    b.exists(b.lens(d, S("Document")), TD + "document-quality").node(d, "document")


@plan(f"SELECT DISTINCT {_tok('customer', 'c_custkey')} AS customer, {_lit('CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)', 'decimal')} AS acctbal FROM customer")
def field_required(b):
    c = b.entity(S("Customer"))
    b.node(c, "customer").field(b.lens(c, S("Customer")), TD + "customer-acctbal", "acctbal")


@plan(f"SELECT DISTINCT {_tok('document', 'd.doc_id')} AS document, {_lit('lang')} AS lang, {_lit('quality', 'integer')} AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def field_optional(b):
    d = b.entity(S("Document"))
    doc = b.lens(d, S("Document"))
    b.node(d, "document").field(doc, TD + "document-lang", "lang").field(doc, TD + "document-quality", "quality", required=False)


@plan(f"SELECT DISTINCT {_tok('document', 'd.doc_id')} AS document, {_lit('toxic', 'integer')} AS toxic FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id")
def field_optional_enum(b):
    d = b.entity(S("Document"))
    b.node(d, "document").field(b.lens(d, S("Toxic")), TD + "document-toxic", "toxic", required=False)


@plan(f"SELECT DISTINCT {_lit('strftime(o_orderdate, ' + chr(39) + '%Y-%m-%dT%H:%M:%S' + chr(39) + ')', 'dateTime')} AS date, {_tok('order', 'o_orderkey')} AS ord FROM orders WHERE o_custkey = 11")
def field_timestamp(b):
    o, c = b.entity(S("Order")), b.entity(bound=TD + "customer/11")
    order = b.lens(o, S("Order"))
    b.edge(order, TD + "order-customer", c).field(order, TD + "order-date", "date").node(o, "ord")


for _run in (sel_type, sel_union, edge_inverse, edge_bound, chain_join, self_join, cycle_join, eq_iri, eq_literal):
    over_store(_run)


_STORED_SQL = " UNION ALL ".join(
    [f"SELECT DISTINCT {_tok(a, k)} AS s, '<{TD}{n}>' AS p, {o} AS o FROM {t}" for n, a, k, o, t in (
        ("nation-region", "nation", "n_nationkey", _tok("region", "n_regionkey"), "nation"), ("customer-nation", "customer", "c_custkey", _tok("nation", "c_nationkey"), "customer"),
        ("supplier-nation", "supplier", "s_suppkey", _tok("nation", "s_nationkey"), "supplier"), ("order-customer", "order", "o_orderkey", _tok("customer", "o_custkey"), "orders"),
        ("order-part", "order", "l_orderkey", _tok("part", "l_partkey"), "lineitem"), ("order-supplier", "order", "l_orderkey", _tok("supplier", "l_suppkey"), "lineitem"),
        ("order-priority", "order", "o_orderkey", _lit("o_orderpriority"), "orders"), ("part-brand", "part", "p_partkey", _lit("p_brand"), "part"),
        ("customer-name", "customer", "c_custkey", _lit("c_name"), "customer"), ("customer-segment", "customer", "c_custkey", _lit("c_mktsegment"), "customer"),
    )]
    + [f"SELECT DISTINCT {_tok(c.lower(), k)}, '<{TYPE}>', '<{TD}{c}>' FROM {t}" for c, k, t in (("Region", "r_regionkey", "region"), ("Nation", "n_nationkey", "nation"), ("Customer", "c_custkey", "customer"), ("Supplier", "s_suppkey", "supplier"), ("Part", "p_partkey", "part"), ("Order", "o_orderkey", "orders"))]
)


@query(f"WITH f AS ({_STORED_SQL}), t AS (SELECT s AS token FROM f UNION SELECT p FROM f UNION SELECT o FROM f) SELECT token, row_number() OVER (ORDER BY encode(token)) - 1 AS id FROM t")
def store_terms(spark, sf_dir):
    """The dictionary: every term once, numbered in the order of the tokens."""
    return store_engine(spark, sf_dir).source.terms.select("token", "id")


@query(f"SELECT p, count(*) AS n_facts, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM ({_STORED_SQL}) f GROUP BY p")
def store_predicates(spark, sf_dir):
    source = store_engine(spark, sf_dir).source
    rows = spark.read.parquet(f"{source.folder}/predicates").withColumnRenamed("p", "_p")
    return source.tokens(rows, {"_p": ("p", "id")}).drop("_p")


@query(f"SELECT ps, count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_facts FROM (SELECT s, string_agg(DISTINCT p, ' ' ORDER BY p) AS ps, count(*) AS n FROM ({_STORED_SQL}) f GROUP BY s) x GROUP BY ps")
def store_characteristics(spark, sf_dir):
    """Which predicates occur together on a subject, and how often."""
    source = store_engine(spark, sf_dir).source
    rows = spark.read.parquet(f"{source.folder}/characteristics").withColumn("_n", F.aggregate("facts", F.lit(0).cast("long"), lambda a, x: a + x))
    named = source.tokens(rows.select(F.col("ps").alias("_set"), "n_subjects", "_n", F.explode("ps").alias("_p")), {"_p": ("p", "id")})
    return named.groupBy("_set", "n_subjects", F.col("_n").alias("n_facts")).agg(F.array_join(F.array_sort(F.collect_list("p")), " ").alias("ps")).drop("_set")


def _ask(spark, sf_dir, nation: str) -> DataFrame:
    engine = table_engine(spark, sf_dir)
    b = PlanBuilder(engine.catalog, "ask")
    c, n = b.entity(S("Customer")), b.entity(bound=TD + nation)
    b.edge(b.lens(c, S("Customer")), TD + "customer-nation", n)
    return engine.compile(b.raw).rows.limit(1).agg((F.count("*") > 0).alias("answer"))


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 2) AS answer")
def ask_true(spark, sf_dir):
    return _ask(spark, sf_dir, "nation/2")


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 400) AS answer")
def ask_false(spark, sf_dir):
    return _ask(spark, sf_dir, "nation/400")


@plan(f"SELECT region FROM (SELECT DISTINCT {_tok('region', 'n_regionkey')} AS region, n_nationkey FROM nation) d")
def distinct_hidden(b):
    n, r = b.entity(S("Nation")), b.entity()
    b.edge(b.lens(n, S("Nation")), TD + "nation-region", r).node(r, "region")


@plan(f"SELECT {_lit('c_name')} AS name, {_tok('customer', 'c_custkey')} AS customer FROM customer ORDER BY c_name, {_tok('customer', 'c_custkey')} LIMIT 20", limit=20)
def topk_examples(b):
    c = b.entity(S("Customer"))
    b.field(b.lens(c, S("Customer")), TD + "customer-name", "name").node(c, "customer")


@query(f"""SELECT token, row_number() OVER (ORDER BY kind, value, dt, lang) AS position FROM (
SELECT {_lit('c_mktsegment')} AS token, 'literal' AS kind, c_mktsegment AS value, '' AS dt, '' AS lang FROM (SELECT DISTINCT c_mktsegment FROM customer) a
UNION ALL SELECT {_lit('p_size', 'integer')}, 'literal', CAST(p_size AS VARCHAR), '{XSD}integer', '' FROM (SELECT DISTINCT p_size FROM part) b
UNION ALL SELECT {_N}, 'iri', 'urn:td:nation/' || n_nationkey, '', '' FROM nation) u""")
def canonical_sort(spark, sf_dir):
    src = mapped(spark, sf_dir)
    facts = as_facts(src, ["customer-segment", "part-size", "customer-nation", "supplier-nation"]).select(F.col("o").alias("token"))
    tokens = facts.unionByName(as_facts(src, ["nation-region"]).select(F.col("s").alias("token"))).distinct()
    # The distinct values of three small domains, not of rows.
    return tokens.withColumn("position", F.row_number().over(Window.orderBy(*sort_fields(F.col("token")))).cast("long"))


@query(f"SELECT DISTINCT {_tok('order', 'l_orderkey')} AS s, {_tok('part', 'l_partkey')} AS o FROM lineitem WHERE year(l_shipdate) IN (1995, 1996)")
def named_graph_scope(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tok = lambda kind, c: F.concat(F.lit(f"<{TD}{kind}/"), F.col(c).cast("string"), F.lit(">"))
    facts = rows.withColumn("y", F.year("l_shipdate")).select(tok("year", "y").alias("g"), tok("order", "l_orderkey").alias("s"), F.lit(f"<{TD}order-part>").alias("p"), tok("part", "l_partkey").alias("o"))
    table = FactsTable(facts, (TD + "year/1995", TD + "year/1996"))
    return table.relation(TD + "order-part").rows.select(F.col("src").alias("s"), F.col("dst").alias("o"))


def _customers(b):
    c, n = b.entity(S("Customer")), b.entity()
    b.edge(b.lens(c, S("Customer")), TD + "customer-nation", n).field(b.lens(c, S("Customer")), TD + "customer-name", "name").node(c, "customer").node(n, "nation")


def _by_nation(b):
    n, c = b.entity(S("Nation")), b.entity()
    b.edge(b.lens(n, S("Nation")), TD + "customer-nation", c, inverse=True).node(n, "nation").node(c, "customer")


def _buyers(b):
    c = b.entity(S("Customer"))
    b.exists(b.lens(c, S("Customer")), TD + "order-customer", inverse=True).node(c, "customer")


def _parties(b):
    b.node(b.entity(S("Party")), "party")


RUN = "run-1"


def _certified(spark, sf_dir, fill) -> tuple:
    """The engine, the raw plan, and the plan's whole result with its certificates under the builder's names."""
    engine = table_engine(spark, sf_dir)
    b = PlanBuilder(engine.catalog)
    fill(b)
    return engine, b.raw, engine.certify(b.raw, RUN), b.columns(engine)


def _supports(spark, sf_dir, fill, atom: str) -> DataFrame:
    """A row for each witness of an atom's supports, beside the row's nodes."""
    _, _, rows, names = _certified(spark, sf_dir, fill)
    held = rows.select(*(F.col(k).alias(n) for k, n in names.items()), F.explode(F.filter("supports", lambda x: x.atom == atom)).alias("x"))
    each = held.select(*names.values(), "x.kind", "x.status", F.explode_outer("x.witnesses").alias("w"))
    return each.select(*names.values(), "kind", "status", "w.id", "w.s", "w.p", "w.o")


def _iri_json(token: str) -> str:
    return f"""'{{"datatype":null,"kind":"iri","language":null,"value":"' || {token}[2:-2] || '"}}'"""


def _witness(atom: str, s: str, p: str, o: str) -> str:
    """SQL of a witness's id, s, p, o."""
    quote = lambda x: f"""replace({x}, '"', '\\"')"""
    return f"""'sha256:' || sha256('7:witness:["{RUN}","{atom}","' || {quote(s)} || '","{p}","' || {quote(o)} || '"]') AS id, {s} AS s, '{p}' AS p, {o} AS o"""


_BASE = f"SELECT {_tok('customer', 'c_custkey')} AS customer, {_N} AS nation, {_lit('c_name')} AS name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"
_NAME_JSON = """'{"datatype":null,"kind":"literal","language":null,"value":"' || name[2:-2] || '"}'"""
_KEY = f"""'sha256:' || sha256('3:row:[[' || {_NAME_JSON} || ',' || {_iri_json('customer')} || ',' || {_iri_json('nation')} || '],[["entity0",' || {_iri_json('customer')} || '],["entity1",' || {_iri_json('nation')} || ']]]')"""


@query(f"SELECT customer, nation, {_KEY} AS row_key FROM ({_BASE}) b")
def row_keys(spark, sf_dir):
    """The keys that executions give their rows, for a whole result."""
    _, _, rows, names = _certified(spark, sf_dir, _customers)
    at = {n: k for k, n in names.items()}
    return rows.select(F.col(at["customer"]).alias("customer"), F.col(at["nation"]).alias("nation"), "row_key")


@query(f"SELECT name, customer, nation, 'edge' AS kind, 'witnessed' AS status, {_witness('edge0', 'customer', TD + 'customer-nation', 'nation')} FROM ({_BASE}) b UNION ALL SELECT name, customer, nation, 'edge', 'witnessed', {_witness('edge0', 'nation', TYPE, f"'<{TD}Nation>'")} FROM ({_BASE}) b")
def evidence_edge(spark, sf_dir):
    """An edge is witnessed by its fact and by the class of its value."""
    return _supports(spark, sf_dir, _customers, "edge0")


@query(f"SELECT customer, nation, 'edge' AS kind, 'witnessed' AS status, {_witness('edge0', 'customer', TD + 'customer-nation', 'nation')} FROM ({_BASE}) b UNION ALL SELECT customer, nation, 'edge', 'witnessed', {_witness('edge0', 'customer', TYPE, f"'<{TD}Customer>'")} FROM ({_BASE}) b")
def evidence_inverse(spark, sf_dir):
    """Facts keep their direction, whichever way the plan reads them."""
    return _supports(spark, sf_dir, _by_nation, "edge0")


@query(f"SELECT party, 'selector' AS kind, 'witnessed' AS status, {_witness('selector0', 'party', TYPE, 'cls')} FROM (SELECT DISTINCT {_tok('customer', 'c_custkey')} AS party, '<{TD}Customer>' AS cls FROM customer UNION ALL SELECT DISTINCT {_tok('supplier', 's_suppkey')}, '<{TD}Supplier>' FROM supplier) b")
def evidence_selector(spark, sf_dir):
    """Of a selector's classes, the smallest that a node has."""
    return _supports(spark, sf_dir, _parties, "selector0")


@query(f"SELECT customer, 'filter' AS kind, 'derived' AS status, {_witness('filter0', 'ord', TD + 'order-customer', 'customer')} FROM (SELECT {_tok('customer', 'c_custkey')} AS customer, min({_tok('order', 'o_orderkey')}) AS ord FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) b")
def evidence_filter(spark, sf_dir):
    """Of the values that must exist, the smallest."""
    return _supports(spark, sf_dir, _buyers, "filter0")


@query(f"SELECT name, customer, nation, 'projection' AS kind, 'witnessed' AS status, {_witness('shown0', 'customer', TD + 'customer-name', 'name')} FROM ({_BASE}) b")
def evidence_field(spark, sf_dir):
    return _supports(spark, sf_dir, _customers, "shown0")


@query(f"SELECT {_KEY} AS row_key, 5 AS n_supports, 'selector0,edge0,shown0,shown1,shown2' AS atoms, 4 AS n_witnesses FROM ({_BASE}) b")
def certificate_coverage(spark, sf_dir):
    """Each row's certificate covers every atom of the plan once, in the plan's order."""
    _, _, rows, _ = _certified(spark, sf_dir, _customers)
    n = F.aggregate("supports", F.lit(0), lambda a, s: a + F.size(s.witnesses))
    return rows.select("row_key", F.size("supports").cast("long").alias("n_supports"), F.array_join(F.transform("supports", lambda s: s.atom), ",").alias("atoms"), n.cast("long").alias("n_witnesses"))


@query(f"SELECT unnest(['rows', 'certificates', 'witnesses', 'faults', 'broken']) AS metric, unnest([count(*), count(DISTINCT customer), 3 * count(*) + count(DISTINCT nation), 0, 0]) AS n FROM ({_BASE}) b")
def evidence_valid(spark, sf_dir):
    """All customers certified, and rows and certificates checked against plan and data: nothing is wrong."""
    from factgraph.operators.evidence import witness_table

    engine, raw, rows, _ = _certified(spark, sf_dir, _customers)
    rows = stored(rows, "certified")
    count = lambda df, name, what: df.agg(what.cast("long").alias("n")).select(F.lit(name).alias("metric"), "n")
    whole = F.count("*")
    parts = [count(rows, "rows", whole), count(rows, "certificates", F.count_distinct("certificate")), count(rows, "broken", F.count_if(F.size("broken") > 0))]
    return reduce(DataFrame.unionByName, [*parts, count(witness_table(rows), "witnesses", whole), count(engine.faults(raw, RUN, rows, rows), "faults", whole)])


def _tampered(rows: DataFrame, customer: str) -> tuple[DataFrame, DataFrame]:
    """Rows and certificates with a fault in seven of ten customers, by the last digit of the key."""
    digit = F.regexp_extract(customer, r"(\d)>$", 1).cast("int")
    held = rows.withColumn("_d", digit)
    support = lambda f: F.transform("supports", f)
    wrong = lambda w: F.transform(w, lambda x, i: F.when(i == 0, x.withField("o", F.lit("<urn:td:nation/999>"))).otherwise(x))
    made = (
        F.when(F.col("_d") == 1, support(lambda x: F.when(x.atom == "selector0", x.withField("status", F.lit("derived"))).otherwise(x)))
        .when(F.col("_d") == 2, support(lambda x: F.when(x.atom == "edge0", x.withField("witnesses", wrong(x.witnesses))).otherwise(x)))
        .when(F.col("_d") == 3, F.slice("supports", 1, 4))
        .otherwise(F.col("supports"))
    )
    certificates = held.filter("_d <> 0").withColumn("supports", made)
    certificates = certificates.unionByName(certificates.filter("_d = 4"))
    claimed = held.filter("_d <> 5").withColumn("row_key", F.when(F.col("_d") == 6, F.concat(F.lit("x"), "row_key")).otherwise(F.col("row_key")))
    return claimed.drop("_d"), certificates.drop("_d")


@query(f"""WITH d AS (SELECT c_custkey % 10 AS d, count(*) AS n FROM ({_BASE}) b GROUP BY 1), f(d, atom, fault) AS (VALUES
(0, NULL, 'no certificate'), (1, NULL, 'certificate id'), (1, 'selector0', 'support status'), (2, 'edge0', 'witness id'), (2, 'edge0', 'witness does not fit'), (2, 'edge0', 'witness is no fact'),
(3, NULL, 'certificate id'), (3, NULL, 'atoms'), (4, NULL, 'certificate twice'), (5, NULL, 'no row'), (6, NULL, 'no row'), (6, NULL, 'no certificate'))
SELECT atom, fault, CAST(sum(n) AS BIGINT) AS n FROM d JOIN f USING (d) GROUP BY atom, fault""")
def evidence_faults(spark, sf_dir):
    """Whole results that were tampered with in several ways: every fault of every row is found."""
    engine, raw, rows, names = _certified(spark, sf_dir, _customers)
    rows = stored(rows, "certified")
    found = engine.faults(raw, RUN, *_tampered(rows, next(k for k, n in names.items() if n == "customer")))
    return found.groupBy("atom", "fault").agg(F.count("*").alias("n"))


_SHARED = f"SELECT {_tok('order', 'l_orderkey')} AS ord, {_tok('part', 'l_partkey')} AS part, l_orderkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) li"


@query(f"SELECT ord, part, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN 'a scalar field has several values' END AS broken FROM ({_SHARED}) s")
def scalar_observed(spark, sf_dir):
    """A contract of one part an order, which the data do not keep, observed in the scan that returns the parts."""
    def fill(b):
        o = b.entity(S("Order"))
        b.field(b.lens(o, S("SinglePart")), TD + "order-part", "part").node(o, "ord")

    _, _, rows, names = _certified(spark, sf_dir, fill)
    return rows.select(*(F.col(k).alias(n) for k, n in names.items()), F.substring_index(F.get("broken", F.lit(0)), ": ", -1).alias("broken"))


@plan(f"SELECT {_tok('order', 'l_orderkey')} AS ord, {_tok('part', 'l_partkey')} AS part FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey = 3) li")
def field_bound(b):
    """All values of a bound entity's field, though its contract says one."""
    o = b.entity(bound=TD + "order/3")
    b.field(b.lens(o, S("SinglePart")), TD + "order-part", "part").node(o, "ord")


@query("SELECT '<urn:td:slot/' || l_orderkey || '-' || l_linenumber || '>' AS subject, count(DISTINCT l_quantity) AS n_values FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_quantity) > 1")
def scalar_violation(spark, sf_dir):
    from factgraph.plans.catalog import Branch, Property

    prop = Property("k", "l", TD + "slot-quantity", False, (Branch("b"),), True, True, True)
    return witness.scalar_violations(mapped(spark, sf_dir), prop)


@query(f"SELECT token, n, dt AS datatype FROM (SELECT {_lit('p_size', 'integer')} AS token, '{XSD}integer' AS dt, count(*) AS n FROM part GROUP BY p_size UNION ALL SELECT {_lit('p_brand')}, '{XSD}string', count(*) FROM part GROUP BY p_brand) u WHERE dt <> '{XSD}integer'")
def contract_violation(spark, sf_dir):
    values = as_facts(mapped(spark, sf_dir), ["part-size", "part-brand"]).groupBy(F.col("o").alias("token")).agg(F.count("*").alias("n"))
    return values.withColumn("datatype", effective_datatype(F.col("token"))).filter(F.col("datatype") != XSD + "integer")


@query("SELECT count(*) AS n_fetched, count(*) > 100 AS more FROM (SELECT c_custkey FROM customer LIMIT 101) l")
def completeness_sentinel(spark, sf_dir):
    engine = table_engine(spark, sf_dir)
    b = PlanBuilder(engine.catalog)
    b.node(b.entity(S("Customer")), "customer")
    return b.frame(engine).limit(101).agg(F.count("*").alias("n_fetched")).withColumn("more", F.col("n_fetched") > 100)


def _nations(spark, sf_dir):
    src = mapped(spark, sf_dir)
    return (as_facts(src, [n]).select(F.col("o").alias("nation")) for n in ("customer-nation", "supplier-nation"))


_NA, _NB = f"SELECT {_tok('nation', 'c_nationkey')} AS nation FROM customer", f"SELECT {_tok('nation', 's_nationkey')} AS nation FROM supplier"


@query(f"SELECT nation, 'left' AS side FROM (({_NA}) EXCEPT ALL ({_NB})) a UNION ALL SELECT nation, 'right' FROM (({_NB}) EXCEPT ALL ({_NA})) b")
def multiset_diff(spark, sf_dir):
    return metrics.multiset_difference(*_nations(spark, sf_dir))


@query(f"({_NA}) INTERSECT ALL ({_NB})")
def multiset_intersect(spark, sf_dir):
    return metrics.multiset_intersection(*_nations(spark, sf_dir))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem)
SELECT o.k AS orderkey, (SELECT count(*) FROM a WHERE a.k = o.k AND a.v IN (SELECT v FROM b WHERE b.k = o.k)) AS n_both,
(SELECT count(*) FROM a WHERE a.k = o.k AND a.v NOT IN (SELECT v FROM b WHERE b.k = o.k)) AS n_left FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o""")
def array_overlap(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "orderkey")
    return metrics.set_overlap(rows, "orderkey", "l_partkey", "l_suppkey")


MENTIONS = ("brand#11", "customer#000000005", " Building ", "nothing like it", "machinery", "region 1", "")


@query("""WITH m(mention) AS (VALUES ('brand#11'), ('customer#000000005'), (' Building '), ('nothing like it'), ('machinery'), ('region 1'), ('')),
l AS (SELECT '<urn:td:customer/' || c_custkey || '>' AS iri, c_name AS name FROM customer UNION ALL SELECT '<urn:td:customer/' || c_custkey || '>', c_mktsegment FROM customer
  UNION ALL SELECT '<urn:td:part/' || p_partkey || '>', p_brand FROM part UNION ALL SELECT '<urn:td:region/' || r_regionkey || '>', r_name FROM region),
n AS (SELECT DISTINCT iri, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS k FROM l),
f AS (SELECT mention, count(iri) AS n, min(iri) AS one FROM m LEFT JOIN n ON k = trim(regexp_replace(lower(mention), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AND k <> '' GROUP BY mention)
SELECT mention, CASE WHEN n = 0 THEN 'unsupported' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS iri FROM f""")
def entity_resolution(spark, sf_dir):
    src = mapped(spark, sf_dir)
    facts = None
    for name in ("customer-name", "customer-segment", "part-brand", "region-name"):
        r = src.relation(TD + name)
        part = r.rows.select(src.render(F.col("src"), r.src).alias("iri"), F.array("dst").alias("names"))
        facts = part if facts is None else facts.unionByName(part)
    return retrieval.resolve_entities(spark.createDataFrame([(m,) for m in MENTIONS], "mention string"), facts)


QUESTION = "large polished brass part and steel"


@query("""WITH q AS (SELECT ['large', 'polished', 'brass', 'part', 'steel'] AS w),
c AS (SELECT DISTINCT p_brand AS brand, p_type AS type FROM part),
s AS (SELECT brand, type, len(list_intersect(list_distinct(list_filter(string_split(trim(regexp_replace(lower(type), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: len(x) > 2)), (SELECT w FROM q))) AS score FROM c),
g AS (SELECT *, CAST(sum(score) OVER (PARTITION BY brand) AS BIGINT) AS group_score FROM s)
SELECT brand, type, CAST(score AS BIGINT) AS score, group_score, row_number() OVER (ORDER BY group_score DESC, brand, score DESC, type) AS position FROM g
ORDER BY group_score DESC, brand, score DESC, type LIMIT 24""")
def card_ranking(spark, sf_dir):
    cards = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).distinct()
    return retrieval.rank_cards(cards, F.lit(QUESTION), 24, group="brand", text="type", key="type")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, median(value) AS med, max(value) AS most, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return metrics.percentiles(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("""SELECT event_type, h AS hour, CAST(grouping(event_type) * 2 + grouping(h) AS BIGINT) AS level, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total, max(user_id) AS most, quantile_disc(user_id, 0.95) AS p95
FROM (SELECT event_type, user_id, CAST(hour(ts) AS INTEGER) AS h FROM events) e GROUP BY GROUPING SETS ((event_type, h), (event_type), (h), ())""")
def grouped_report(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", F.hour("ts").alias("hour"))
    return metrics.summary(rows, "user_id", ["event_type", "hour"], [["event_type", "hour"], ["event_type"], ["hour"], []])


@query("SELECT coalesce(bool_and(o_totalprice >= 0), TRUE) AS prices, coalesce(bool_and(o_orderstatus IN ('O', 'F', 'P')), TRUE) AS states, coalesce(bool_and(o_custkey < 10), TRUE) AS few, coalesce(bool_and(o_totalprice >= 0), TRUE) AND coalesce(bool_and(o_orderstatus IN ('O', 'F', 'P')), TRUE) AND coalesce(bool_and(o_custkey < 10), TRUE) AS all_gates FROM orders")
def gates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return metrics.gates(rows, {"prices": F.col("o_totalprice") >= 0, "states": F.col("o_orderstatus").isin("O", "F", "P"), "few": F.col("o_custkey") < 10})


@query("SELECT lang, count(*) AS n, CAST(count(*) FILTER (WHERE n_chars > 1000) AS DOUBLE) / count(*) AS long_share FROM documents GROUP BY lang")
def group_ratio(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"), metrics.ratio(F.col("n_chars") > 1000).alias("long_share"))


_PROFILE = ["nation-region", "customer-nation", "supplier-nation", "order-customer", "order-part", "customer-segment"]
_PF = " UNION ALL ".join(
    f"SELECT {_tok(s, a)} AS s, '<urn:td:{n}>' AS p, {o} AS o FROM {t}"
    for n, s, a, o, t in (
        ("nation-region", "nation", "n_nationkey", _tok("region", "n_regionkey"), "nation"),
        ("customer-nation", "customer", "c_custkey", _tok("nation", "c_nationkey"), "customer"),
        ("supplier-nation", "supplier", "s_suppkey", _tok("nation", "s_nationkey"), "supplier"),
        ("order-customer", "order", "o_orderkey", _tok("customer", "o_custkey"), "orders"),
        ("order-part", "order", "l_orderkey", _tok("part", "l_partkey"), "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) li"),
        ("customer-segment", "customer", "c_custkey", _lit("c_mktsegment"), "customer"),
    )
)
_BAND = "CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 10 THEN '2-10' WHEN n <= 100 THEN '11-100' ELSE '>100' END"


def _facts(spark, sf_dir, classes=()):
    return as_facts(mapped(spark, sf_dir), _PROFILE, classes)


@query(f"SELECT '<urn:td:Customer>' AS cls, count(DISTINCT c_custkey) AS n_nodes FROM customer UNION ALL SELECT '<urn:td:Nation>', count(DISTINCT n_nationkey) FROM nation")
def profile_types(spark, sf_dir):
    return profile.type_counts(_facts(spark, sf_dir, ["Customer", "Nation"]))


@query(f"SELECT p, n_nodes, n AS n_values, {_BAND} AS value_band FROM (SELECT p, count(DISTINCT s) AS n_nodes, count(DISTINCT o) AS n FROM (SELECT s, p, o FROM ({_PF}) f WHERE s IN (SELECT {_tok('customer', 'c_custkey')} FROM customer) UNION ALL SELECT {_tok('customer', 'c_custkey')}, '<{TYPE}>', '<urn:td:Customer>' FROM customer) x GROUP BY p) y")
def profile_coverage(spark, sf_dir):
    return profile.coverage(_facts(spark, sf_dir, ["Customer"]), TD + "Customer")


@query(f"SELECT p, {_BAND} AS band, count(*) AS n_nodes FROM (SELECT p, s, count(DISTINCT o) AS n FROM ({_PF}) f GROUP BY p, s) g GROUP BY p, {_BAND}")
def profile_cardinality_bands(spark, sf_dir):
    by = profile.degrees(mapped(spark, sf_dir, sets=False), [TD + n for n in _PROFILE])
    return by.groupBy("p", profile.band(F.col("n")).alias("band")).agg(F.sum("n_nodes").alias("n_nodes"))


@query(f"SELECT x.p AS a, y.p AS b, count(*) AS n_nodes FROM (SELECT DISTINCT s, p FROM ({_PF}) f) x JOIN (SELECT DISTINCT s, p FROM ({_PF}) f) y ON x.s = y.s AND x.p < y.p GROUP BY x.p, y.p")
def profile_cooccurrence(spark, sf_dir):
    return profile.cooccurrence(_facts(spark, sf_dir), [f"<{TD}{n}>" for n in _PROFILE])


@query(f"SELECT p, degree, count(*) AS n_nodes FROM (SELECT p, s, count(DISTINCT o) AS degree FROM ({_PF}) f GROUP BY p, s) g GROUP BY p, degree")
def profile_fanout(spark, sf_dir):
    return profile.degrees(mapped(spark, sf_dir, sets=False), [TD + n for n in _PROFILE]).withColumnRenamed("n", "degree")


@query(f"SELECT p, 'iri' AS s_kind, CASE WHEN o LIKE '<%' THEN 'iri' ELSE 'literal' END AS o_kind, CASE WHEN o LIKE '<%' THEN NULL ELSE '{XSD}string' END AS datatype, count(*) AS n_facts FROM ({_PF}) f GROUP BY ALL")
def profile_observed(spark, sf_dir):
    return profile.observed(_facts(spark, sf_dir))


@query("SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def baseline_absence(spark, sf_dir):
    """Outside the algebra: absence is never asked by a plan."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("custkey"))


@query("SELECT c_nationkey AS nationkey, count(DISTINCT l_partkey) AS n_parts FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_nationkey")
def baseline_group_distinct(spark, sf_dir):
    """Outside the algebra: plans do not aggregate."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    pairs = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return pairs.select(F.col("c_nationkey").alias("nationkey"), "l_partkey").distinct().groupBy("nationkey").agg(F.count("*").alias("n_parts"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND contains(text, 'License')")
def late_fusion(spark, sf_dir):
    """Documents that a plan returned, searched for a word."""
    engine = table_engine(spark, sf_dir)
    b = PlanBuilder(engine.catalog)
    d = b.entity(S("Document"))
    b.eq(b.lens(d, S("Document")), TD + "document-quality", Term.literal("1", XSD + "integer")).node(d, "document")
    ids = b.frame(engine).select(F.regexp_extract("document", r"/(\d+)>$", 1).cast("long").alias("doc_id"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.contains("text", F.lit("License")))
    return docs.join(ids, "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT o_orderpriority AS grp, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_totalprice DESC, o_orderdate, o_orderkey) AS position FROM orders QUALIFY position <= 5")
def lexicographic_ranking(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("grp", F.col("o_orderpriority"))
    order = [F.col("o_orderstatus"), F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey")]
    return metrics.first_of(rows, "grp", order, 5).select("grp", F.col("o_orderkey").alias("orderkey"), "position")


@query("""WITH r AS (SELECT o_orderpriority AS grp, o_orderstatus = 'F' AS rel, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders)
SELECT grp, CAST(count(*) FILTER (WHERE rel AND position <= 100) AS DOUBLE) / least(100, count(*)) AS precision,
CAST(count(*) FILTER (WHERE rel AND position <= 100) AS DOUBLE) / nullif(count(*) FILTER (WHERE rel), 0) AS recall FROM r GROUP BY grp""")
def recall_at_k(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("grp", F.col("o_orderpriority"))
    return metrics.at_k(rows, 100, "grp", [F.col("o_totalprice").desc(), F.col("o_orderkey")], F.col("o_orderstatus") == "F")


@query("SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS label, min(p_partkey) OVER (PARTITION BY trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS first_part FROM part")
def candidate_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return metrics.dedup_by(rows, normal_label(F.col("p_name")), F.col("p_partkey"), "label").select("label", F.col("first").alias("first_part"))


# Evidence beyond plans


_CHAIN = ["order-customer", "customer-nation", "nation-region"]
_CHAIN_SQL = " UNION ALL ".join(f"SELECT DISTINCT {_tok(a, k)} AS s, '<{TD}{n}>' AS p, {_tok(b, v)} AS o FROM {t}" for n, a, k, b, v, t in (("order-customer", "order", "o_orderkey", "customer", "o_custkey", "orders"), ("customer-nation", "customer", "c_custkey", "nation", "c_nationkey", "customer"), ("nation-region", "nation", "n_nationkey", "region", "n_regionkey", "nation")))
_REACH_SQL = f"""WITH RECURSIVE f AS ({_CHAIN_SQL}), r AS (SELECT DISTINCT s AS start, s AS node, 0 AS steps, '' AS path FROM f WHERE p = '<{TD}order-customer>'
UNION ALL SELECT start, o, steps + 1, path || s || ' ' || p || ' ' || o || ' . ' FROM r JOIN f ON node = f.s WHERE steps < 3)"""


def _reached(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    src = mapped(spark, sf_dir)
    facts = as_facts(src, _CHAIN)
    starts = as_facts(src, _CHAIN[:1]).select(F.col("s").alias("node"))
    return paths.reachable(facts, starts, 3), facts


@query(f"{_REACH_SQL} SELECT start, node, steps FROM r")
def path_reach(spark, sf_dir):
    """Everything an order leads to, by customer, nation and region."""
    return _reached(spark, sf_dir)[0].select("start", "node", "steps")


@query(f"{_REACH_SQL} SELECT start, node, path FROM r")
def path_witness(spark, sf_dir):
    """The facts that lead from an order to each node."""
    text = F.array_join(F.transform("path", lambda x: F.concat(x.s, F.lit(" "), x.p, F.lit(" "), x.o, F.lit(" . "))), "")
    return paths.witness_paths(_reached(spark, sf_dir)[0]).select("start", "node", text.alias("path"))


@query(f"{_REACH_SQL} SELECT CASE steps WHEN 1 THEN 'ends' ELSE 'chain' END AS fault, count(*) AS n FROM r WHERE steps > 0 AND start LIKE '%1>' GROUP BY 1 UNION ALL SELECT 'no fact', count(*) FROM r WHERE steps > 0 AND start LIKE '%1>' HAVING count(*) > 0 UNION ALL SELECT 'length', count(*) FROM r WHERE start LIKE '%2>' HAVING count(*) > 0")
def path_faults(spark, sf_dir):
    """Witness paths with another customer in them, or a wrong length, are found."""
    reached, facts = _reached(spark, sf_dir)
    own = paths.witness_paths(reached)
    other = F.transform("path", lambda x, i: F.when(i == 0, x.withField("o", F.lit("<urn:td:customer/none>"))).otherwise(x))
    own = own.withColumn("path", F.when(F.col("start").endswith("1>"), other).otherwise(F.col("path"))).withColumn("steps", F.when(F.col("start").endswith("2>"), F.col("steps") + 1).otherwise(F.col("steps")))
    return paths.path_faults(stored(own, "paths"), facts).groupBy("fault").agg(F.count("*").alias("n"))


def _hash_sql(x: str) -> str:
    return f"CAST('0x' || substr(md5(coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')), 1, 15) AS BIGINT)"


def _statement_sql(orders: str) -> str:
    one = lambda what, rows: f"SELECT '{what}' AS what, count(*) AS n, CAST(coalesce(sum({_hash_sql('k')}), 0) AS VARCHAR) AS total FROM (SELECT DISTINCT k FROM ({rows}) x) d"
    own, facts = "SELECT c_custkey AS k FROM customer", f"SELECT o_custkey AS k FROM {orders}"
    parts = {"population": own, "facts": facts, "present": f"{own} WHERE c_custkey IN ({facts})", "absent": f"{own} WHERE c_custkey NOT IN ({facts})"}
    return " UNION ALL ".join(one(k, v) for k, v in parts.items())


def _buyers_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return t("customer").select(F.col("c_custkey").alias("custkey")), t("orders").select(F.col("o_custkey").alias("custkey"))


@query(_statement_sql("orders"))
def absence_evidence(spark, sf_dir):
    """Which customers have no order, as digests of the tables this is said of and of both parts."""
    return closed.absence_statement(*_buyers_tables(spark, sf_dir), "custkey").withColumn("total", F.col("total").cast("string"))


@query(f"WITH a AS ({_statement_sql('orders')}), b AS ({_statement_sql('(SELECT * FROM orders WHERE o_custkey % 7 <> 0) o')}) SELECT what, a.n AS stated, b.n AS found FROM a JOIN b USING (what) WHERE a.n <> b.n OR a.total <> b.total")
def absence_broken(spark, sf_dir):
    """The statement no longer holds when orders go."""
    customers, orders = _buyers_tables(spark, sf_dir)
    statement = stored(closed.absence_statement(customers, orders, "custkey"), "statement")
    return closed.statement_faults(statement, customers, orders.filter("custkey % 7 <> 0"), "custkey")


_BOUGHT_SQL = "SELECT DISTINCT c_nationkey AS nationkey, l_partkey AS k FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


def _bought(spark, sf_dir) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_nationkey").alias("nationkey"), F.col("l_partkey").alias("partkey"))


@query(f"SELECT nationkey, CAST({_hash_sql('k')} % 16 AS INTEGER) AS part, count(*) AS n, CAST(sum({_hash_sql('k')}) AS VARCHAR) AS total FROM ({_BOUGHT_SQL}) b GROUP BY ALL")
def aggregate_evidence(spark, sf_dir):
    """Distinct parts of each nation in counts that can be added up again."""
    return closed.counted(_bought(spark, sf_dir), "nationkey", "partkey").withColumn("total", F.col("total").cast("string"))


@query(f"SELECT nationkey, CAST({_hash_sql('k')} % 16 AS INTEGER) AS part, 'changed' AS fault FROM ({_BOUGHT_SQL}) b WHERE k = 10 UNION ALL SELECT DISTINCT nationkey, NULL, 'count' FROM ({_BOUGHT_SQL}) b WHERE nationkey = 3")
def aggregate_broken(spark, sf_dir):
    """A part that is gone, and a claim that is one too high, are found where they are."""
    rows = _bought(spark, sf_dir)
    evidence = stored(closed.counted(rows, "nationkey", "partkey"), "counts")
    claims = evidence.groupBy("nationkey").agg((F.sum("n") + F.when(F.col("nationkey") == 3, 1).otherwise(0)).alias("n"))
    return closed.count_faults(claims, evidence, rows.filter("partkey <> 10"), "nationkey", "partkey")


def _confirmed(spark, sf_dir) -> DataFrame:
    """Documents that a plan returned: those of good quality."""
    engine = table_engine(spark, sf_dir)
    b = PlanBuilder(engine.catalog)
    d = b.entity(S("Document"))
    b.eq(b.lens(d, S("Document")), TD + "document-quality", Term.literal("1", XSD + "integer")).node(d, "document")
    return b.frame(engine).select(F.regexp_extract("document", r"/(\d+)>$", 1).cast("long").alias("doc_id"))


_WORD_LIST = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_BM25_SQL = f"""ok AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)), d AS (SELECT doc_id AS id, {_WORD_LIST} AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM ok)),
p AS (SELECT id, len(w) AS length, unnest(w) AS word FROM d), t AS (SELECT id, length, word, count(*) AS tf FROM p GROUP BY ALL),
a AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT id, length FROM t) x), q AS (SELECT item_id AS question, unnest(list_distinct({_WORD_LIST})) AS word FROM benchmark),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
b AS (SELECT question, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))), 6) AS score FROM q JOIN t USING (word) JOIN f USING (word) CROSS JOIN a GROUP BY question, id),
lex AS (SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INTEGER) AS position, id, score FROM b)"""


def _questions(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question"), "text")


@query(f"WITH {_BM25_SQL} SELECT * FROM lex WHERE position <= 10")
def ranked_fusion(spark, sf_dir):
    """Every question's best ten of the documents that a plan confirmed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search.bm25(search.postings(docs, "doc_id", "text", _confirmed(spark, sf_dir)), _questions(spark, sf_dir), 10)


@query(f"""WITH {_BM25_SQL}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT item_id AS question, c.vec_id AS id, round(list_inner_product(x.v, c.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(c.v, c.v))), 6) AS score FROM benchmark JOIN e x ON x.vec_id = item_id CROSS JOIN e c WHERE c.vec_id IN (SELECT doc_id FROM ok)),
vec AS (SELECT question, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS position, id FROM s),
u AS (SELECT question, id, 1.0::DOUBLE / (60 + position) AS s FROM lex WHERE position <= 20 UNION ALL SELECT question, id, 1.0::DOUBLE / (60 + position) FROM vec WHERE position <= 20),
z AS (SELECT question, id, round(sum(s), 10) AS score FROM u GROUP BY question, id)
SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INTEGER) AS position, id, score FROM z QUALIFY position <= 10""")
def hybrid_retrieval(spark, sf_dir):
    """Lexical and vector ranks of all questions, fused."""
    ok = _confirmed(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = _questions(spark, sf_dir)
    near = search.nearest(vectors.join(ok.distinct(), F.col("id") == F.col("doc_id"), "left_semi"), asked.join(vectors, F.col("question") == F.col("id")).select("question", "v"), 20)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search.fused([search.bm25(search.postings(docs, "doc_id", "text", ok), asked, 20), near], 10)


@query(f"SELECT party, witness FROM (SELECT {_tok('customer', 'c_custkey')} AS party, min({_tok('order', 'o_orderkey')}) AS witness FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) x")
def live_certificates(spark, sf_dir):
    """Certificates of buying customers after three micro-batches of facts, the second one with a replay: witnesses are the smallest of all batches."""
    from factgraph.engine import Engine
    from factgraph.sources.shared import shared_folder
    from factgraph.streaming.certificates import LiveCertificates

    own = table_engine(spark, sf_dir)
    b = PlanBuilder(own.catalog)
    _buyers(b)
    facts = as_facts(mapped(spark, sf_dir), ["order-customer"], ["Customer", "Order"]).select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    engine = Engine(spark, FactsTable(facts), own.catalog, own.authorization, own.dataset, own.policy)
    folder = shared_folder(spark, "live")
    files = spark.sparkContext.defaultParallelism
    for k in range(3):  # so many files for each batch
        facts.filter(F.pmod(F.xxhash64("s", "o"), F.lit(3)) == k).repartition(files).write.mode("append").parquet(f"{folder}/arriving")
    live = LiveCertificates(engine, b.raw, f"{folder}/state", RUN)
    live.run(spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/arriving"), f"{folder}/checkpoint").awaitTermination()
    live.apply(facts.filter(F.pmod(F.xxhash64("s", "o"), F.lit(3)) == 1), 9)  # facts that are known add nothing
    found = F.get(F.filter("supports", lambda x: x.atom == "filter0"), F.lit(0)).witnesses
    return live.current(spark).select(F.col("entity0").alias("party"), F.get(found, F.lit(0)).s.alias("witness"))
