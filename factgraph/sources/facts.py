"""Where facts come from: a table of tokens, or ordinary tables seen as facts.

Both answer the same four questions, and the compiler asks nothing else:

* ``relation(predicate)``: its (src, dst) pairs, and the key space of either column,
* ``members(cls)``: the nodes of a class, and their key space,
* ``key(term, space)``: a term as a key of that space, None if it can be none,
* ``tokens(rows, columns)``: keys as tokens, here by ``render(column, space)``.

A table of tokens has one key space, "token". Mapped tables keep raw keys, one space
for each IRI template and literal type, so joins compare integers and filters reach
the Parquet scan; tokens are only written in the last projection. Keys of different
templates are never equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.errors import PolicyError
from factgraph.functions.terms import TYPE, Term, literal_token

TOKEN = "token"


@dataclass(frozen=True)
class Relation:
    rows: DataFrame
    src: str
    dst: str


class Rendered:
    """Sources whose keys become tokens by an expression."""

    def tokens(self, rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
        """``rows`` with more columns: for a column of keys, the name of its tokens, and its space."""
        return rows.withColumns({name: self.render(F.col(c), space) for c, (name, space) in columns.items()})

    def own_space(self) -> tuple[str, str]:
        """The space of constants that no relation gives, and its type."""
        return TOKEN, "string"

    def as_tokens(self):
        """A source of the same facts whose keys become tokens by an expression."""
        return self


class FactsTable(Rendered):
    """A table of (g, s, p, o) tokens; the default graph has a null g."""

    def __init__(self, facts: DataFrame, graphs: tuple[str, ...] = ()):
        if graphs and "g" not in facts.columns:
            raise PolicyError("named graphs need a fact table with graph names")
        self.graphs = graphs
        if "g" in facts.columns:
            facts = facts.filter(F.col("g").isin(*(f"<{g}>" for g in graphs)) if graphs else F.col("g").isNull())
        self.facts = facts.select("s", "p", "o")

    def scoped(self, graphs: tuple[str, ...], whole: DataFrame) -> "FactsTable":
        return FactsTable(whole, graphs)

    def relation(self, predicate: str) -> Relation:
        rows = self.facts.filter(F.col("p") == f"<{predicate}>").select(F.col("s").alias("src"), F.col("o").alias("dst"))
        return Relation(rows.distinct() if len(self.graphs) > 1 else rows, TOKEN, TOKEN)

    def members(self, cls: str) -> tuple[DataFrame, str]:
        rows = self.facts.filter((F.col("p") == f"<{TYPE}>") & (F.col("o") == f"<{cls}>"))
        return rows.select(F.col("s").alias("node")), TOKEN

    def key(self, term: Term, space: str):
        return term.token

    def render(self, column: Column, space: str) -> Column:
        return column

    def unrender(self, column: Column, space: str) -> Column:
        return column


@dataclass(frozen=True)
class Template:
    """IRIs made of a prefix and the text of a key."""

    prefix: str
    kind: str = "long"


class MappedTables(Rendered):
    """Tables as facts: classes and predicates defined by functions that return keys.

    ``classes``: IRI -> (function of (spark) giving column node, template name).
    ``predicates``: IRI -> (function giving src and dst, template of src, space of dst);
    the space of a literal is "lit" or "lit:" and a datatype, its key the lexical form.
    """

    def __init__(self, spark: SparkSession, templates: dict[str, Template], classes: dict[str, tuple[Callable, str]], predicates: dict[str, tuple[Callable, str, str]]):
        self.spark, self.templates, self.classes, self.predicates = spark, templates, classes, predicates

    def relation(self, predicate: str) -> Relation:
        if predicate not in self.predicates:
            return Relation(self.spark.createDataFrame([], "src string, dst string"), TOKEN, TOKEN)
        make, src, dst = self.predicates[predicate]
        return Relation(make(self.spark).select("src", "dst"), src, dst)

    def members(self, cls: str) -> tuple[DataFrame, str]:
        if cls not in self.classes:
            return self.spark.createDataFrame([], "node string"), TOKEN
        make, space = self.classes[cls]
        return make(self.spark).select("node"), space

    def key(self, term: Term, space: str):
        if space == TOKEN:
            return term.token
        if space.startswith("lit"):
            return term.value if term.kind == "literal" and not term.language and (term.datatype or "") == space[4:] else None
        t = self.templates[space]
        if term.kind != "iri" or not term.value.startswith(t.prefix):
            return None
        text = term.value[len(t.prefix) :]
        if t.kind == "string":
            return text or None
        return int(text) if re.fullmatch(r"0|-?[1-9]\d{0,17}", text) else None

    def render(self, column: Column, space: str) -> Column:
        if space == TOKEN:
            return column
        if space.startswith("lit"):
            return literal_token(column, space[4:] or None)
        return F.concat(F.lit(f"<{self.templates[space].prefix}"), column.cast("string"), F.lit(">"))

    def unrender(self, column: Column, space: str) -> Column | None:
        """Tokens as keys of a template's space, null for those it does not make; None for other spaces."""
        t = self.templates.get(space)
        if t is None:
            return column if space == TOKEN else None
        head = "^<" + re.escape(t.prefix)
        if t.kind == "string":
            return F.nullif(F.regexp_extract(column, head + "([^<>]+)>$", 1), F.lit(""))
        return F.nullif(F.regexp_extract(column, head + r"(0|-?[1-9]\d{0,17})>$", 1), F.lit("")).cast("long")
