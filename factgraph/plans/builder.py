"""Raw plans by the names of shapes and predicates instead of catalog keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.errors import CatalogError
from factgraph.functions.terms import Term
from factgraph.plans.catalog import Catalog
from factgraph.plans.query import canonical_names, normalize


class PlanBuilder:
    """Collects a raw plan; projections get column names for frame()."""

    def __init__(self, catalog: Catalog, kind: str = "select"):
        self.catalog, self.names, self.shape_of = catalog, {}, {}
        self.raw = {"kind": kind, "catalog_revision": catalog.revision, "entities": [], "selectors": [], "lenses": [], "edges": [], "filters": [], "projections": []}

    def _add(self, part: str, **item) -> str:
        item["id"] = f"{part}-{len(self.raw[part])}"
        self.raw[part].append(item)
        return item["id"]

    def entity(self, shape: str | None = None, bound: str | None = None) -> str:
        """A new entity: selected by a shape, bound to an IRI, or neither."""
        e = self._add("entities", binding=bound and Term.iri(bound).json())
        if shape:
            lens = self._lens(shape)
            s = next((s for s in self.catalog.selectors if s.lens == lens), None)
            if s is None:
                raise CatalogError(f"{shape} selects nothing")
            self._add("selectors", entity=e, key=s.key)
        return e

    def _lens(self, shape: str) -> str:
        lens = self.catalog.find(shape)
        if lens is None:
            raise CatalogError(f"no shape {shape}")
        return lens.key

    def lens(self, entity: str, shape: str) -> str:
        u = next((x["id"] for x in self.raw["lenses"] if x["entity"] == entity and x["key"] == self._lens(shape)), None)
        u = u or self._add("lenses", entity=entity, key=self._lens(shape))
        self.shape_of[u] = shape
        return u

    def _prop(self, lens: str, predicate: str, inverse: bool = False):
        p = self.catalog.find(self.shape_of[lens], predicate, inverse)
        if p is None:
            raise CatalogError(f"no property {predicate}")
        return p

    def edge(self, lens: str, predicate: str, target: str, inverse: bool = False, branch: int = 0) -> "PlanBuilder":
        p = self._prop(lens, predicate, inverse)
        self._add("edges", source_lens=lens, property_key=p.key, branch_key=p.branches[branch].key, target_entity=target)
        return self

    def eq(self, lens: str, predicate: str, value: Term, branch: int = 0) -> "PlanBuilder":
        p = self._prop(lens, predicate)
        self._add("filters", kind="eq", lens=lens, property_key=p.key, branch_key=p.branches[branch].key, value=value.json())
        return self

    def exists(self, lens: str, predicate: str, inverse: bool = False) -> "PlanBuilder":
        self._add("filters", kind="exists", lens=lens, property_key=self._prop(lens, predicate, inverse).key)
        return self

    def node(self, entity: str, name: str) -> "PlanBuilder":
        self.names[self._add("projections", kind="node", entity=entity)] = name
        return self

    def field(self, lens: str, predicate: str, name: str, required: bool = True, branch: int = 0) -> "PlanBuilder":
        p = self._prop(lens, predicate)
        self.names[self._add("projections", kind="field", lens=lens, property_key=p.key, branch_key=p.branches[branch].key, required=required)] = name
        return self

    def columns(self, engine) -> dict[str, str]:
        """Columns of the compiled result, and their names here."""
        ids = canonical_names(normalize(self.raw, engine.catalog, engine.policy))[1]
        return {ids[i]: n for i, n in self.names.items()}

    def frame(self, engine, limit: int | None = None) -> DataFrame:
        """The lazy result under the builder's column names."""
        compiled = engine.compile(self.raw, limit)
        return compiled.rows.select(*(F.col(k).alias(n) for k, n in self.columns(engine).items()))
