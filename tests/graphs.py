"""Small graphs, their shapes and plan builders, written for these tests."""

from factgraph.functions.terms import Term
from factgraph.plans.catalog import Catalog, Qualification, ShapeSource
from factgraph.plans.query import AuthorizationScope
from factgraph.sources.turtle import facts_frame, parse_turtle

EX = "http://shop.test/"
DATA = """
@prefix e: <http://shop.test/> .
@prefix x: <http://www.w3.org/2001/XMLSchema#> .
e:ann a e:Worker ; e:name "Ann" ; e:on e:red, e:blue ; e:can e:weld ; e:code "01"^^x:integer .
e:bob a e:Worker ; e:name "Bob \\"B\\"" ; e:on e:red ; e:can e:weld, e:paint ; e:code "1"^^x:integer ; e:nick "bo"@EN .
e:cy a e:Worker, e:Boss ; e:name "Cy" ; e:on e:blue ; e:can e:paint ; e:grade e:High ; e:boss e:cy .
e:dee a e:Worker ; e:name "Dee", "D." ; e:on e:old .
e:red a e:Job ; e:title "Red job" ; e:size "10"^^x:integer . e:blue a e:Job ; e:title "Blue job" ; e:size "big" .
e:old e:title "not a job" .
e:weld a e:Skill . e:paint a e:Skill .
e:ann e:grade e:Low . e:bob e:grade e:Odd . e:bob e:boss e:cy . e:ann e:boss "nobody" .
"""
SHAPES = """
@prefix e: <http://shop.test/> .
@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix x: <http://www.w3.org/2001/XMLSchema#> .
e:WorkShape a sh:NodeShape ; sh:targetClass e:Worker ;
  sh:property [ sh:path e:on ; sh:class e:Job ] , [ sh:path e:can ; sh:class e:Skill ] ,
    [ sh:path e:grade ; sh:in ( e:High e:Low ) ; sh:maxCount 1 ] , [ sh:path e:boss ] .
e:NameShape a sh:NodeShape ; sh:targetClass e:Worker ;
  sh:property [ sh:path e:name ; sh:datatype x:string ; sh:maxCount 1 ] ,
    [ sh:path e:code ; sh:datatype x:integer ; sh:maxCount 1 ] , [ sh:path e:nick ; sh:maxCount 1 ] .
e:JobShape a sh:NodeShape ; sh:targetClass e:Job ;
  sh:property [ sh:path [ sh:inversePath e:on ] ; sh:class e:Worker ] , [ sh:path e:title ; sh:datatype x:string ; sh:maxCount 1 ] ,
    [ sh:path e:size ; sh:maxCount 1 ; sh:or ( [ sh:datatype x:integer ] [ sh:datatype x:string ] ) ] .
e:FocusShape a sh:NodeShape ; sh:targetNode e:red, e:gone ; sh:property [ sh:path e:title ; sh:maxCount 1 ] .
e:BothShape a sh:NodeShape ; sh:targetClass e:Boss ; sh:targetNode e:ann ; sh:property [ sh:path e:can ] .
e:OddShape a sh:NodeShape ; sh:targetClass "text" ; sh:property [ sh:path ( e:on e:title ) ] .
"""


def source(text=SHAPES, trust="trusted", closure=(), records=None, source_id="shop"):
    triples = tuple(parse_turtle(text))
    q = Qualification.reviewed(triples, "tests", "r1", ["f1"])
    if records is not None:
        q = Qualification("tests", "r1", tuple(r for r in q.records if records(r)), ("f1",))
    return ShapeSource(triples, source_id, "tests", trust, q, closure)


def catalog(*sources, **kw):
    return Catalog.build(list(sources) or [source()], build_id="b1", **kw)


def facts(spark, text=DATA, graph=None):
    return facts_frame(spark, parse_turtle(text), graph)


class Builder:
    """Raw plans by shape and predicate names."""

    def __init__(self, cat, kind="select"):
        self.cat = cat
        self.raw = {"kind": kind, "catalog_revision": cat.revision, "entities": [], "selectors": [], "lenses": [], "edges": [], "filters": [], "projections": []}

    def _add(self, part, **item):
        item["id"] = f"{part}{len(self.raw[part])}"
        self.raw[part].append(item)
        return item["id"]

    def entity(self, bound=None):
        return self._add("entities", binding=bound and {"kind": "iri", "value": EX + bound})

    def select(self, entity, shape):
        lens = self.cat.find(EX + shape)
        self._add("selectors", entity=entity, key=next(s.key for s in self.cat.selectors if s.lens == lens.key))
        return self

    def lens(self, entity, shape):
        return self._add("lenses", entity=entity, key=self.cat.find(EX + shape).key)

    def prop(self, lens, name, inverse=False):
        key = next(x["key"] for x in self.raw["lenses"] if x["id"] == lens)
        return next(p for p in self.cat.properties if p.lens == key and (p.predicate, p.inverse) == (EX + name, inverse))

    def edge(self, lens, name, target, inverse=False, branch=0):
        p = self.prop(lens, name, inverse)
        self._add("edges", source_lens=lens, property_key=p.key, branch_key=p.branches[branch].key, target_entity=target)
        return self

    def eq(self, lens, name, term: Term, branch=0):
        p = self.prop(lens, name)
        self._add("filters", kind="eq", lens=lens, property_key=p.key, branch_key=p.branches[branch].key, value=term.json())
        return self

    def exists(self, lens, name):
        self._add("filters", kind="exists", lens=lens, property_key=self.prop(lens, name).key)
        return self

    def node(self, entity):
        self._add("projections", kind="node", entity=entity)
        return self

    def field(self, lens, name, required=True, branch=0):
        p = self.prop(lens, name)
        self._add("projections", kind="field", lens=lens, property_key=p.key, branch_key=p.branches[branch].key, required=required)
        return self


EVERYONE = AuthorizationScope("all")
