"""A small graph, its reviewed shapes and plans over it: what the queries of checks.py run on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from factgraph.engine import Engine
from factgraph.plans.builder import PlanBuilder
from factgraph.plans.catalog import Catalog, CatalogLimits, Overlay, Qualification, ShapeSource
from factgraph.plans.query import AuthorizationScope, DatasetScope, QueryPolicy
from factgraph.sources.facts import FactsTable
from factgraph.sources.turtle import facts_frame, parse_turtle

EX = "http://depot.test/"
HEAD = "@prefix d: <http://depot.test/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix x: <http://www.w3.org/2001/XMLSchema#> .\n"
DATA = HEAD + """
d:north a d:Depot ; d:label "North" ; d:in d:oslo ; d:opened "2001"^^x:integer .
d:south a d:Depot ; d:label "South \\"S\\"" ; d:in d:rome ; d:opened "02001"^^x:integer ; d:motto "sempre"@IT .
d:west a d:Depot, d:Hub ; d:label "West" ; d:in d:oslo ; d:state d:Open ; d:feeds d:west .
d:twin a d:Depot ; d:label "Twin", "Second" ; d:in d:nowhere .
d:oslo a d:Town ; d:label "Oslo" ; d:size "7"^^x:integer . d:rome a d:Town ; d:label "Rome" ; d:size "vast" .
d:nowhere d:label "no town" .
d:north d:state d:Shut ; d:feeds d:west . d:south d:state d:Lost ; d:feeds "unknown" .
"""
SHAPES = HEAD + """
d:DepotShape a sh:NodeShape ; sh:targetClass d:Depot ;
  sh:property [ sh:path d:in ; sh:class d:Town ] , [ sh:path d:feeds ] , [ sh:path d:state ; sh:in ( d:Open d:Shut ) ; sh:maxCount 1 ] .
d:LabelShape a sh:NodeShape ; sh:targetClass d:Depot ;
  sh:property [ sh:path d:label ; sh:datatype x:string ; sh:maxCount 1 ] , [ sh:path d:opened ; sh:datatype x:integer ; sh:maxCount 1 ] , [ sh:path d:motto ; sh:maxCount 1 ] .
d:TownShape a sh:NodeShape ; sh:targetClass d:Town ;
  sh:property [ sh:path [ sh:inversePath d:in ] ; sh:class d:Depot ] , [ sh:path d:label ; sh:datatype x:string ; sh:maxCount 1 ] ,
    [ sh:path d:size ; sh:maxCount 1 ; sh:or ( [ sh:datatype x:integer ] [ sh:datatype x:string ] ) ] .
d:FewShape a sh:NodeShape ; sh:targetNode d:oslo, d:gone .
d:MixedShape a sh:NodeShape ; sh:targetClass d:Hub ; sh:targetNode d:north .
d:OddShape a sh:NodeShape ; sh:targetClass "text" ; sh:property [ sh:path ( d:in d:label ) ] .
"""
EVERYONE = AuthorizationScope("all")


def source(text: str = SHAPES, trust: str = "trusted", closure: tuple[str, ...] = (), behaviors: tuple[str, ...] = ("selector", "property", "scalar_projection"), source_id: str = "depot") -> ShapeSource:
    triples = tuple(parse_turtle(text))
    q = Qualification.reviewed(triples, "samples", "1", ["whole"])
    q = Qualification("samples", "1", tuple(r for r in q.records if r[1] in behaviors), q.fixture_ids)
    return ShapeSource(triples, source_id, "samples", trust, q, closure)


def catalog(*sources: ShapeSource, overlays: tuple[Overlay, ...] = (), limits: CatalogLimits | None = None) -> Catalog:
    return Catalog.build(list(sources) or [source()], overlays, "samples-1", limits)


def engine(spark: SparkSession, own: Catalog | None = None, **parts) -> Engine:
    """An engine over the sample graph; ``parts`` replace what it is made of."""
    parts = {"authorization": EVERYONE, "dataset": DatasetScope(), "policy": QueryPolicy(timeout_seconds=300), "source": None} | parts
    facts = parts.pop("source") or FactsTable(facts_frame(spark, parse_turtle(DATA)).coalesce(1))
    return Engine(spark, facts, own or catalog(), **parts)


def build(own: Catalog, fill, kind: str = "select") -> dict:
    """The raw plan that ``fill`` puts together."""
    b = PlanBuilder(own, kind)
    fill(b)
    return b.raw


def towns(b: PlanBuilder) -> None:
    """Depots in Oslo and their labels."""
    depot, town = b.entity(EX + "DepotShape"), b.entity(bound=EX + "oslo")
    b.edge(b.lens(depot, EX + "DepotShape"), EX + "in", town)
    b.field(b.lens(depot, EX + "LabelShape"), EX + "label", "label").node(depot, "depot")


def selected(shape: str):
    def fill(b: PlanBuilder) -> None:
        b.node(b.entity(EX + shape), "node")

    return fill


def with_field(shape: str, name: str, required: bool = True, branch: int = 0):
    def fill(b: PlanBuilder) -> None:
        e = b.entity(EX + shape)
        b.node(e, "node").field(b.lens(e, EX + shape), EX + name, "value", required, branch)

    return fill


def linked(shape: str, name: str, bound: str | None = None, inverse: bool = False, branch: int = 0):
    def fill(b: PlanBuilder) -> None:
        e, to = b.entity(EX + shape), b.entity(bound=bound and EX + bound)
        b.edge(b.lens(e, EX + shape), EX + name, to, inverse, branch)
        if b.raw["kind"] == "select":
            b.node(e, "node")

    return fill


def equal(shape: str, name: str, value, branch: int = 0):
    def fill(b: PlanBuilder) -> None:
        e = b.entity(EX + shape)
        b.eq(b.lens(e, EX + shape), EX + name, value, branch).node(e, "node")

    return fill


def existing(shape: str, name: str):
    def fill(b: PlanBuilder) -> None:
        e = b.entity(EX + shape)
        b.exists(b.lens(e, EX + shape), EX + name).node(e, "node")

    return fill
