"""Readers of facts: Turtle on the driver, N-Triples and JSON through Spark."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.errors import CatalogError, PlanError
from factgraph.functions.terms import RDF, TYPE, XSD, Term, check_iri

FACTS = "g string, s string, p string, o string"
_LEX = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|(?P<str>"(?:[^"\\\n\r]|\\.)*")
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w%-](?:[\w.%-]*[\w%-])?)?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_UNESCAPE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[2] or m[3], 16)) if m[2] or m[3] else _UNESCAPE[m[1]]

    return re.sub(r"\\(?:([tbnrf\"'\\])|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))", one, text)


class _Turtle:
    def __init__(self, text: str):
        self.items, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if m is None:
                raise CatalogError(f"cannot read Turtle at {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.blanks, self.named, self.out = 0, {}, "", 0, {}, []

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or text is not None and item[1] != text:
            raise CatalogError(f"Turtle: {text or 'more'} expected, {item[1]!r} found")
        self.at += 1
        return item

    def blank(self) -> str:
        # Zero-padded, so that their order as text is that of the document.
        self.blanks += 1
        return f"_:b{self.blanks:08d}"

    def iri(self, text: str) -> str:
        value = _unescape(text[1:-1])
        return f"<{value if re.match(r'[A-Za-z][A-Za-z0-9+.-]*:', value) else self.base + value}>"

    def run(self) -> list[tuple[str, str, str]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "lang" and text in ("@prefix", "@base") or kind == "word" and text.upper() in ("PREFIX", "BASE"):
                self.take()
                if text.lower().endswith("prefix"):
                    name = self.take()[1]
                    self.prefixes[name[:-1]] = self.iri(self.take()[1])[1:-1]
                else:
                    self.base = self.iri(self.take()[1])[1:-1]
                if text.startswith("@"):
                    self.take(".")
                continue
            alone = self.peek()[1] == "["
            subject = self.node()
            if not (alone and self.peek()[1] == "."):
                self.pairs(subject)
            self.take(".")
        return list(dict.fromkeys(self.out))

    def pairs(self, subject: str) -> None:
        while True:
            verb = self.take()
            predicate = f"<{TYPE}>" if verb == ("word", "a") else self.resource(*verb)
            while True:
                self.out.append((subject, predicate, self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", ""):
                return

    def resource(self, kind: str, text: str) -> str:
        if kind == "iri":
            return self.iri(text)
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise CatalogError(f"Turtle: prefix {prefix!r} is not declared")
            return f"<{self.prefixes[prefix]}{local}>"
        raise CatalogError(f"Turtle: {text!r} is no resource")

    def node(self) -> str:
        kind, text = self.take()
        if text == "[":
            me = self.blank()
            if self.peek()[1] != "]":
                self.pairs(me)
            self.take("]")
            return me
        if text == "(":
            values = []
            while self.peek()[1] != ")":
                values.append(self.node())
            self.take(")")
            cells = [self.blank() for _ in values] + [f"<{RDF}nil>"]
            for k, v in enumerate(values):
                self.out += [(cells[k], f"<{RDF}first>", v), (cells[k], f"<{RDF}rest>", cells[k + 1])]
            return cells[0]
        if kind == "blank":
            if text not in self.named:
                self.named[text] = self.blank()
            return self.named[text]
        if kind in ("str", "long"):
            value = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "type":
                self.take()
                return Term("literal", value, self.resource(*self.take())[1:-1]).token
            if self.peek()[0] == "lang":
                return Term("literal", value, None, self.take()[1][1:].lower()).token
            return Term("literal", value).token
        if kind == "num":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return Term("literal", text, XSD + name).token
        if kind == "word" and text in ("true", "false"):
            return Term("literal", text, XSD + "boolean").token
        return self.resource(kind, text)


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """Distinct (s, p, o) tokens in document order."""
    return _Turtle(text).run()


def facts_frame(spark: SparkSession, triples: list[tuple[str, str, str]], graph: str | None = None) -> DataFrame:
    """A fact table of tokens; ``graph`` names the graph they are in."""
    return spark.createDataFrame([(graph, *t) for t in triples], FACTS).distinct()


def read_turtle(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """A Turtle document of any store that Spark reads, as facts."""
    text = spark.read.text(path, wholetext=True).first()
    return facts_frame(spark, parse_turtle(text.value if text else ""), graph)


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """N-Triples files as facts, in parallel."""
    return ntriples_facts(spark.read.text(path), graph).distinct()


def ntriples_facts(lines: DataFrame, graph: str | None = None) -> DataFrame:
    """Rows of one line (value) as facts; language tags are lowered, what is no triple raises."""
    line = r'^\s*(<[^<>\s]*>|_:\S+)\s+(<[^<>\s]*>)\s+(<[^<>\s]*>|_:[^\s.]+(?:\.[^\s.]+)*|"(?:[^"\\]|\\.)*"(?:\^\^<[^<>\s]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", line, k)
    ok = F.when(F.col("value").rlike(line), F.lit(graph).cast("string")).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), "value")))
    tag = r'"@[A-Za-z0-9-]+$'
    lowered = F.when(part(3).rlike(tag), F.concat(F.regexp_extract(part(3), r"(?s)^(.*)@", 1), F.lit("@"), F.lower(F.regexp_extract(part(3), r"@([A-Za-z0-9-]+)$", 1)))).otherwise(part(3))
    return rows.select(ok.alias("g"), part(1).alias("s"), part(2).alias("p"), lowered.alias("o"))


_NODE = r"<[^<>\s]*>|_:[^\s.]+(?:\.[^\s.]+)*"
_QUAD = rf'^\s*({_NODE})\s+(<[^<>\s]*>)\s+({_NODE}|"(?:[^"\\]|\\.)*"(?:\^\^<[^<>\s]*>|@[A-Za-z0-9-]+)?)(?:\s+({_NODE}))?\s*\.\s*(?:#.*)?$'


def nquads_facts(lines: DataFrame) -> DataFrame:
    """Rows of one N-Quads line (value) and the file it is from (file) as facts; what is no quad raises.

    A blank node is one of its file: its label gets a digest of the file's name in front.
    Language tags are lowered; lines without a graph are of the default graph.
    """
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", _QUAD, k)
    scope = F.substr(F.md5(F.col("file").cast("binary")), F.lit(1), F.lit(12))
    node = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:f"), scope, F.lit("."), F.substr(c, F.lit(3)))).otherwise(c)
    ok = F.when(F.col("value").rlike(_QUAD), F.nullif(part(4), F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("not an N-Quads line: "), "value")))
    tagged = part(3).rlike(r'"@[A-Za-z0-9-]+$')
    lowered = F.when(tagged, F.concat(F.regexp_extract(part(3), r"(?s)^(.*)@", 1), F.lit("@"), F.lower(F.regexp_extract(part(3), r"@([A-Za-z0-9-]+)$", 1)))).otherwise(part(3))
    return rows.select(node(ok).alias("g"), node(part(1)).alias("s"), part(2).alias("p"), node(lowered).alias("o"))


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """N-Quads files as facts: Spark splits them at lines, so a file of any size is read by many tasks."""
    return nquads_facts(spark.read.text(path).select("value", F.input_file_name().alias("file"))).distinct()


def write_nquads(facts: DataFrame, path: str) -> None:
    """Facts as N-Quads, a line each; an existing folder is never overwritten."""
    facts.select(F.concat(F.concat_ws(" ", "s", "p", "o", "g"), F.lit(" .")).alias("value")).write.mode("errorifexists").text(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as Parquet by graph and predicate; an existing table is never overwritten."""
    facts.distinct().write.mode("errorifexists").partitionBy("g", "p").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(path).select("g", "s", "p", "o")


def strict_json(text: str) -> Any:
    """JSON without repeated keys or numbers that are none."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise PlanError("JSON object repeats a key")
        return out

    def never(name):
        raise PlanError(f"JSON must not hold {name}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=never)


def graph_name(value: str) -> str:
    return f"<{check_iri(value)}>"
