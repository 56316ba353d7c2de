"""Relational tables as a mapped fact source, with their shapes and catalog."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.engine import Engine
from factgraph.functions.terms import XSD
from factgraph.plans.catalog import Catalog, Qualification, ShapeSource
from factgraph.plans.query import AuthorizationScope, DatasetScope, QueryPolicy
from factgraph.sources.facts import MappedTables, Template
from factgraph.sources.shared import shared_folder, spread
from factgraph.sources.store import KeyedFacts, StoredFacts, build_store
from factgraph.sources.turtle import parse_turtle

TD = "urn:td:"
#: Class: table and key column; the template is the class's name in lower case.
CLASSES = {
    "Region": ("region", "r_regionkey"),
    "Nation": ("nation", "n_nationkey"),
    "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"),
    "Order": ("orders", "o_orderkey"),
    "Document": ("documents", "doc_id"),
    "Event": ("events", "event_id"),
}
_MONEY, _TIME = "cast(cast({} as decimal(18,2)) as string)", "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"
_INT, _DEC, _DT = XSD + "integer", XSD + "decimal", XSD + "dateTime"
#: Field: class, table, key, lexical form, datatype.
FIELDS = {
    "region-name": ("Region", "region", "r_regionkey", "r_name", None),
    "nation-name": ("Nation", "nation", "n_nationkey", "n_name", None),
    "customer-name": ("Customer", "customer", "c_custkey", "c_name", None),
    "customer-acctbal": ("Customer", "customer", "c_custkey", _MONEY.format("c_acctbal"), _DEC),
    "customer-segment": ("Customer", "customer", "c_custkey", "c_mktsegment", None),
    "supplier-name": ("Supplier", "supplier", "s_suppkey", "s_name", None),
    "supplier-acctbal": ("Supplier", "supplier", "s_suppkey", _MONEY.format("s_acctbal"), _DEC),
    "part-name": ("Part", "part", "p_partkey", "p_name", None),
    "part-brand": ("Part", "part", "p_partkey", "p_brand", None),
    "part-type": ("Part", "part", "p_partkey", "p_type", None),
    "part-size": ("Part", "part", "p_partkey", "cast(p_size as string)", _INT),
    "order-status": ("Order", "orders", "o_orderkey", "o_orderstatus", None),
    "order-priority": ("Order", "orders", "o_orderkey", "o_orderpriority", None),
    "order-date": ("Order", "orders", "o_orderkey", _TIME.format("o_orderdate"), _DT),
    "order-totalprice": ("Order", "orders", "o_orderkey", _MONEY.format("o_totalprice"), _DEC),
    "document-lang": ("Document", "documents", "doc_id", "lang", None),
    "document-source": ("Document", "documents", "doc_id", "source", None),
    "document-chars": ("Document", "documents", "doc_id", "cast(n_chars as string)", _INT),
    "document-quality": ("Document", "labels", "doc_id", "cast(quality as string)", _INT),
    "document-toxic": ("Document", "labels", "doc_id", "cast(toxic as string)", _INT),
    "event-type": ("Event", "events", "event_id", "event_type", None),
    "event-user": ("Event", "events", "event_id", "cast(user_id as string)", _INT),
    "event-time": ("Event", "events", "event_id", _TIME.format("ts"), _DT),
    "event-value": ("Event", "events", "event_id", _MONEY.format("value"), _DEC),
}
#: Edge: source class, target class, table, source key, target key, whether pairs repeat.
EDGES = {
    "nation-region": ("Nation", "Region", "nation", "n_nationkey", "n_regionkey", False),
    "customer-nation": ("Customer", "Nation", "customer", "c_custkey", "c_nationkey", False),
    "supplier-nation": ("Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey", False),
    "order-customer": ("Order", "Customer", "orders", "o_orderkey", "o_custkey", False),
    "order-part": ("Order", "Part", "lineitem", "l_orderkey", "l_partkey", True),
    "order-supplier": ("Order", "Supplier", "lineitem", "l_orderkey", "l_suppkey", True),
}
SEGMENTS = ("BUILDING", "MACHINERY")


def shapes() -> str:
    """The shapes of all classes, and some that look at them differently."""
    out = [f"@prefix t: <{TD}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix x: <{XSD}> ."]
    for c in CLASSES:
        props = [f"[ sh:path t:{n} ; sh:datatype <{f[4] or XSD + 'string'}> ; sh:maxCount 1 ]" for n, f in FIELDS.items() if f[0] == c]
        props += [f"[ sh:path t:{n} ; sh:class t:{e[1]} ]" for n, e in EDGES.items() if e[0] == c]
        props += [f"[ sh:path [ sh:inversePath t:{n} ] ; sh:class t:{e[0]} ]" for n, e in EDGES.items() if e[1] == c]
        out.append(f"t:{c}Shape a sh:NodeShape ; sh:targetClass t:{c} ; sh:property {', '.join(props)} .")
    few = " ".join(f"<{TD}segment/{s}>" for s in SEGMENTS)
    out += [
        f"t:SegmentShape a sh:NodeShape ; sh:targetClass t:Customer ; sh:property [ sh:path t:customer-segment-node ; sh:in ( {few} ) ] .",
        "t:RichOrderShape a sh:NodeShape ; sh:targetClass t:Order ; sh:property [ sh:path t:order-customer ; sh:class t:RichCustomer ] .",
        "t:SinglePartShape a sh:NodeShape ; sh:targetClass t:Order ; sh:property [ sh:path t:order-part ; sh:class t:Part ; sh:maxCount 1 ] .",
        "t:FocusShape a sh:NodeShape ; sh:targetNode <urn:td:nation/1>, <urn:td:nation/7>, <urn:td:nation/999> .",
        "t:RegionsShape a sh:NodeShape ; sh:targetClass t:Region ; sh:targetNode <urn:td:region/2>, <urn:td:region/77> .",
        "t:PartyShape a sh:NodeShape ; sh:targetClass t:Customer, t:Supplier .",
        f"t:ToxicShape a sh:NodeShape ; sh:targetClass t:Document ; sh:property [ sh:path t:document-toxic ; sh:maxCount 1 ; sh:in ( 1 ) ] .",
    ]
    return "\n".join(out)


@lru_cache(maxsize=1)
def catalog() -> Catalog:
    triples = tuple(parse_turtle(shapes()))
    reviewed = Qualification.reviewed(triples, "tables", "1", ["queries"])
    return Catalog.build([ShapeSource(triples, "tables", "tables", "trusted", reviewed)], build_id="tables-1")


def mapped(spark: SparkSession, sf_dir: str, sets: bool = True) -> MappedTables:
    """The tables below ``sf_dir`` as facts; every definition is lazy.

    Without ``sets``, facts may be repeated: for those who make a set of all of them.
    """
    once = lambda df: spread(df, *df.columns).distinct() if sets else df
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    key = lambda c: F.col(c).cast("long")
    node = lambda t, k: lambda _: once(table(t).select(key(k).alias("node")).filter("node IS NOT NULL"))
    classes = {TD + c: (node(t, k), c.lower()) for c, (t, k) in CLASSES.items()}
    classes[TD + "RichCustomer"] = (lambda _: table("customer").filter("c_acctbal > 5000").select(key("c_custkey").alias("node")), "customer")

    def pairs(t, src, dst, repeat=False):
        def make(_):
            rows = table(t).select(src.alias("src"), dst.alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
            return once(rows) if repeat else rows

        return make

    predicates = {TD + n: (pairs(t, key(k), F.expr(x)), c.lower(), "lit:" + (d or "") if d else "lit") for n, (c, t, k, x, d) in FIELDS.items()}
    predicates |= {TD + n: (pairs(t, key(a), key(b), r), s.lower(), o.lower()) for n, (s, o, t, a, b, r) in EDGES.items()}
    predicates[TD + "customer-segment-node"] = (pairs("customer", key("c_custkey"), F.col("c_mktsegment")), "customer", "segment")
    slot = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    predicates[TD + "slot-quantity"] = (pairs("lineitem", slot, F.expr(_MONEY.format("l_quantity"))), "slot", "lit:" + _DEC)
    templates = {c.lower(): Template(f"{TD}{c.lower()}/") for c in CLASSES}
    templates |= {"segment": Template(TD + "segment/", "string"), "slot": Template(TD + "slot/", "string")}
    return MappedTables(spark, templates, classes, predicates)


def table_engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, mapped(spark, sf_dir), catalog(), AuthorizationScope("tables"), DatasetScope("tables"), QueryPolicy(timeout_seconds=600))


#: What a store of the tables holds.
STORED = ["nation-region", "customer-nation", "supplier-nation", "order-customer", "order-part", "order-supplier", "order-priority", "part-brand", "customer-name", "customer-segment"]
STORED_CLASSES = ["Region", "Nation", "Customer", "Supplier", "Part", "Order"]
_stores: dict[tuple[str, str], str] = {}


def store_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The tables as a dictionary-encoded store, written once for each application."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _stores:
        folder = shared_folder(spark, "facts-store")
        build_store(KeyedFacts(mapped(spark, sf_dir, sets=False), [TD + n for n in STORED], [TD + c for c in STORED_CLASSES]), folder)
        _stores[at] = folder
    return Engine(spark, StoredFacts(spark, _stores[at]), catalog(), AuthorizationScope("tables"), DatasetScope("tables"), QueryPolicy(timeout_seconds=600))


def as_facts(source: MappedTables, predicates: list[str], classes: list[str] = (), once: bool = False) -> DataFrame:
    """Some relations written out as (s, p, o) tokens; ``once``: as a set, made of the keys (of a source without ``sets``)."""
    from factgraph.functions.terms import TYPE

    parts = []
    for n in predicates:
        r = source.relation(TD + n)
        rows = spread(r.rows, "src", "dst").distinct() if once else r.rows
        parts.append(rows.select(source.render(F.col("src"), r.src).alias("s"), F.lit(f"<{TD}{n}>").alias("p"), source.render(F.col("dst"), r.dst).alias("o")))
    for c in classes:
        nodes, space = source.members(TD + c)
        nodes = spread(nodes, "node").distinct() if once else nodes
        parts.append(nodes.select(source.render(F.col("node"), space).alias("s"), F.lit(f"<{TYPE}>").alias("p"), F.lit(f"<{TD}{c}>").alias("o")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
