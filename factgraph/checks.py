"""Queries of functions, profiles and reports over tables, and cases over the sample graph with the rows they must give."""

from __future__ import annotations

import tempfile
from collections import Counter
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph import samples
from factgraph.engine import Engine, render_result
from factgraph.errors import AuthorizationError, GraphError, PlanError, PolicyError
from factgraph.functions import terms
from factgraph.functions.terms import XSD, Term
from factgraph.operators import evidence, harness, metrics, profile, retrieval
from factgraph.plans import text
from factgraph.plans.catalog import Branch, Catalog, CatalogLimits, Overlay, Qualification, ShapeGraph, property_signature
from factgraph.plans.query import AuthorizationScope, DatasetScope, ExecutionRequest, QueryPolicy
from factgraph.samples import EX, HEAD, SHAPES
from factgraph.sources.facts import FactsTable
from factgraph.sources.turtle import facts_frame, ntriples_facts, parse_turtle, strict_json

#: Queries that read tables, and with CASES those over the sample graph, which are tests only.
QUERIES: dict = {}
SQL: dict[str, str] = {}
CASES: dict = {}
CASES_SQL: dict[str, str] = {}
_RDF_TYPE = terms.TYPE
_SQL_TYPE = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(schema: str, rows: list[tuple]) -> str:
    """SQL for a table of given rows."""
    fields = [x.split() for x in schema.split(", ")]
    body = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {_SQL_TYPE[t]}) AS {n}' for n, t in fields)} FROM (VALUES {body}) v({', '.join(n for n, _ in fields)})"


def cases(schema: str, expected: list[tuple]):
    """Register a function of (spark) that gives rows, and the rows it must give."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame(f(spark), schema)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        CASES[f.__name__], CASES_SQL[f.__name__] = run, values(schema, expected)
        return f

    return put


def query(sql: str, queries: dict = QUERIES, texts: dict = SQL):
    def put(f):
        queries[f.__name__], texts[f.__name__] = f, sql
        return f

    return put


def case(sql: str):
    return query(sql, CASES, CASES_SQL)


def accepted(work) -> bool:
    try:
        work()
    except (GraphError, FileExistsError):
        return False
    return True


def short(text: str | None) -> str | None:
    return None if text is None else text.replace(EX, "").replace(XSD, "x:")


# Sources and terms


@cases("s string, p string, o string", [
    ("<urn:a>", "<urn:p>", '"1"^^<x:integer>'), ("<urn:a>", "<urn:p>", '"1.5"^^<x:decimal>'), ("<urn:a>", "<urn:p>", '"true"^^<x:boolean>'),
    ("<urn:a>", "<urn:p>", '"say \\"x\\""@en-us'), ("<urn:a>", "<urn:q>", "<urn:b>"), ("<urn:b>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<urn:T>"),
])
def source_turtle(spark):
    text = '@prefix u: <urn:> . u:a u:p 1, 1.5, true, "say \\"x\\""@EN-us ; u:q u:b . u:b a u:T . u:a u:p 1 .'
    return [(s, p, short(o)) for s, p, o in parse_turtle(text)]


@query("SELECT '<urn:td:nation/' || n_nationkey || '>' AS s, '<urn:td:nation-name>' AS p, '\"' || n_name || '\"' AS o FROM nation")
def source_ntriples(spark, sf_dir):
    """Facts written as N-Triples lines and read back."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.concat(F.lit("<urn:td:nation/"), F.col("n_nationkey"), F.lit("> <urn:td:nation-name> "), terms.literal_token(F.col("n_name")), F.lit(" ."))
    return ntriples_facts(rows.select(line.alias("value"))).select("s", "p", "o")


@cases("scope string, n_facts long", [("default", 1), ("a", 2), ("a and b", 3), ("no such graph", 0), ("no graph column", -1)])
def source_scopes(spark):
    """A fact in two graphs is one fact of both."""
    facts = spark.createDataFrame([(None, "<urn:x>", "<urn:p>", '"0"'), *((f"<urn:{g}>", "<urn:x>", "<urn:p>", f'"{o}"') for g, o in ("a1", "a2", "b2", "b3"))], "g string, s string, p string, o string")
    count = lambda *graphs: FactsTable(facts, graphs).relation("urn:p").rows.count()
    out = [("default", count()), ("a", count("urn:a")), ("a and b", count("urn:a", "urn:b")), ("no such graph", count("urn:c"))]
    try:
        FactsTable(facts.drop("g"), ("urn:a",))
    except PolicyError:
        out.append(("no graph column", -1))
    return out


@cases("text string, accepted boolean", [('{"a": [1, null]}', True), ('{"a": 1, "a": 1}', False), ("[NaN]", False), ("[-Infinity]", False), ('{"a": {"b": 1, "c": {"b": 2}}}', True), ('[{"a": 1}, {"a": 1}]', True)])
def source_strict_json(spark):
    texts = ['{"a": [1, null]}', '{"a": 1, "a": 1}', "[NaN]", "[-Infinity]", '{"a": {"b": 1, "c": {"b": 2}}}', '[{"a": 1}, {"a": 1}]']
    return [(t, accepted(lambda t=t: strict_json(t))) for t in texts]


@cases("attempt long, written boolean, content string", [(1, True, '{"n": 1}'), (2, False, '{"n": 1}')])
def sink_new_json(spark):
    """A file that is there is never written again."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own, for this call
        path, out = f"{folder}/x.json", []
        for n in (1, 2):
            written = accepted(lambda n=n: harness.write_new_json(path, {"n": n}))
            out.append((n, written, " ".join(Path(path).read_text().split()).replace("{ ", "{").replace(" }", "}")))
    return out


_IRI = r"[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|\\^`]+"


@query(f"""SELECT page_id, variant, regexp_full_match(text, '{_IRI}') AS ok FROM (
SELECT page_id, 'url' AS variant, url AS text FROM pages UNION ALL SELECT page_id, 'path', regexp_replace(url, '^[a-z]+://', '') FROM pages
UNION ALL SELECT page_id, 'blank', url || ' x' FROM pages UNION ALL SELECT page_id, 'line', url || chr(10) FROM pages UNION ALL SELECT page_id, 'angle', '<' || url || '>' FROM pages) u WHERE text IS NOT NULL""")
def fn_iri_valid(spark, sf_dir):
    url = F.col("url")
    made = {"url": url, "path": F.regexp_replace(url, "^[a-z]+://", ""), "blank": F.concat(url, F.lit(" x")), "line": F.concat(url, F.lit("\n")), "angle": F.concat(F.lit("<"), url, F.lit(">"))}
    pairs = F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("text")) for k, v in made.items()))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(pairs).alias("v")).select("page_id", "v.*").filter("text IS NOT NULL")
    return rows.select("page_id", "variant", terms.valid_iri(F.col("text")).alias("ok"))


@cases("text string, term string", [
    ("iri urn:a:b", "<urn:a:b>"), ("iri rel", None), ("iri urn:a b", None), ("iri urn:", None), ("literal x", '"x"'), ("literal", None),
    ("literal 01 of x:integer", '"01"^^<x:integer>'), ("literal x in EN-us", '"x"@en-us'), ("literal x in e_n", None), ("literal x of x:string in en", None),
    ("iri urn:a in en", None), ("blank b0", None), ("literal x with more", None), ('literal "\\', '"\\"\\\\"'),
])
def fn_term_load(spark):
    """Terms from their JSON form; null for what is none."""
    raw = {
        "iri urn:a:b": ("iri", "urn:a:b"), "iri rel": ("iri", "rel"), "iri urn:a b": ("iri", "urn:a b"), "iri urn:": ("iri", "urn:"), "literal x": ("literal", "x"), "literal": ("literal", None),
        "literal 01 of x:integer": ("literal", "01", XSD + "integer"), "literal x in EN-us": ("literal", "x", None, "EN-us"), "literal x in e_n": ("literal", "x", None, "e_n"),
        "literal x of x:string in en": ("literal", "x", XSD + "string", "en"), "iri urn:a in en": ("iri", "urn:a", None, "en"), "blank b0": ("blank", "b0"), 'literal "\\': ("literal", '"\\'),
    }
    forms = {k: dict(zip(("kind", "value", "datatype", "language"), v)) for k, v in raw.items()}
    forms["literal x with more"] = {"kind": "literal", "value": "x", "more": None}
    return [(k, short(Term.load(v).token) if accepted(lambda v=v: Term.load(v)) else None) for k, v in forms.items()]


@cases("token string, kind string, value string, datatype string", [
    ("<urn:a>", "iri", "urn:a", None), ('"a\\nb"', "literal", "a\nb", "x:string"), ('"1"^^<x:integer>', "literal", "1", "x:integer"), ('"x"@en', "literal", "x", "rdf:langString"), ("_:b0", None, None, None),
])
def fn_term_parse(spark):
    """Terms from what a source holds; a blank node is no result."""
    out = []
    for token in ("<urn:a>", '"a\\nb"', f'"1"^^<{XSD}integer>', '"x"@en', "_:b0"):
        t = Term.parse(token) if accepted(lambda token=token: Term.parse(token)) else None
        kind = t.effective_datatype if t else None
        out.append((short(token), t and t.kind, t and t.value, kind and short(kind).replace(terms.RDF, "rdf:")))
    return out


@query("""SELECT doc_id, md5('"' || replace(replace(replace(replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't'), chr(8), chr(92) || 'b'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(12), chr(92) || 'f') || '"') AS token_md5, TRUE AS returns
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d""")
def fn_escape(spark, sf_dir):
    """Whole texts as literals, and back."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    token = terms.literal_token(F.col("t"))
    return rows.select("doc_id", F.md5(token.cast("binary")).alias("token_md5"), (terms.token_value(token) == F.col("t")).alias("returns"))


@query("SELECT lang, tag, regexp_full_match(tag, '[A-Za-z]+(-[A-Za-z0-9]+)*') AS ok, lower(tag) AS lowered FROM (SELECT DISTINCT lang, unnest([lang, upper(lang) || '-x1', lang || '_', lang || '-', '1' || lang]) AS tag FROM documents WHERE lang IS NOT NULL) t")
def fn_language(spark, sf_dir):
    lang = F.col("lang")
    tags = F.array(lang, F.concat(F.upper(lang), F.lit("-x1")), F.concat(lang, F.lit("_")), F.concat(lang, F.lit("-")), F.concat(F.lit("1"), lang))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").filter("lang IS NOT NULL").distinct().select("lang", F.explode(tags).alias("tag"))
    return rows.select("lang", "tag", terms.valid_language(F.col("tag")).alias("ok"), F.lower("tag").alias("lowered"))


@query("SELECT c_custkey AS custkey, 'sha256:' || sha256('8:customer:{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}') AS id FROM customer")
def fn_digest(spark, sf_dir):
    json_text = F.concat(F.lit('{"key":'), F.col("c_custkey"), F.lit(',"name":"'), F.col("c_name"), F.lit('"}'))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("custkey"), terms.domain_digest("customer", json_text).alias("id"))


_JSON = [('{"a":null,"b":[true,1.5,"\\u00e9"]}', "d"), ('{"a":1}', "d"), ('{"a":1}', "dd"), ("[]", "")]


@case(" UNION ALL ".join(f"SELECT {_literal(d)} AS domain, {_literal(t)} AS text, 'sha256:' || sha256({_literal(f'{len(d)}:{d}:{t}')}) AS id" for t, d in _JSON))
def fn_canonical_json(spark, sf_dir):
    """Names in any order, one spelling, and a digest that depends on the domain."""
    rows = [({"b": [True, 1.5, "é"], "a": None}, "d"), ({"a": 1}, "d"), ({"a": 1}, "dd"), ([], "")]
    return spark.createDataFrame([(d, terms.canonical_json(v), terms.digest(d, v)) for v, d in rows], "domain string, text string, id string")


_KINDS = ("IRI", "Literal", "BlankNodeOrIRI", "IRIOrLiteral", "BlankNodeOrLiteral")


@cases("contract string, iri boolean, text boolean, number boolean, entity boolean", [
    ("any", True, True, True, True), ("IRI", True, False, False, True), ("Literal", False, True, True, False), ("BlankNodeOrIRI", True, False, False, True), ("IRIOrLiteral", True, True, True, True),
    ("BlankNodeOrLiteral", False, True, True, False), ("IRI and Literal", False, False, False, False), ("x:integer", False, False, True, False), ("class", True, False, False, True), ("<urn:a>", True, False, False, True), ('"x"', False, True, False, False),
])
def contract_terms(spark):
    """Which terms contracts accept, and whether an entity can be a value at all."""
    a, x, n = Term.iri("urn:a"), Term.literal("x"), Term.literal("1", XSD + "integer")
    own = {"any": {}} | {k: {"node_kinds": (k,)} for k in _KINDS} | {"IRI and Literal": {"node_kinds": ("IRI", "Literal")}, "x:integer": {"datatypes": (XSD + "integer",)}, "class": {"classes": ("urn:C",)}, "<urn:a>": {"allowed": (a,)}, '"x"': {"allowed": (x,)}}
    return [(k, *(Branch("b", **v).accepts(t) for t in (a, x, n)), Branch("b", **v).accepts_nodes()) for k, v in own.items()]


@query("SELECT kinds, token, ok FROM (VALUES ('IRI', '<urn:a>', TRUE), ('IRI', '\"x\"', FALSE), ('Literal', '<urn:a>', FALSE), ('Literal', '\"x\"', TRUE), ('BlankNodeOrIRI', '<urn:a>', TRUE), ('BlankNodeOrIRI', '\"x\"', FALSE), ('IRIOrLiteral', '<urn:a>', TRUE), ('IRIOrLiteral', '\"x\"', TRUE), ('BlankNodeOrLiteral', '<urn:a>', FALSE), ('BlankNodeOrLiteral', '\"x\"', TRUE)) v(kinds, token, ok)")
def fn_node_kinds(spark, sf_dir):
    rows = spark.createDataFrame([("<urn:a>",), ('"x"',)], "token string")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kinds"), terms.kind_allowed(F.col("token"), (k,)).alias("ok")) for k in _KINDS)))
    return rows.select("token", pairs.alias("k")).select("k.kinds", "token", "k.ok")


@cases("what string, result string", [
    ("strings mapped", '{"a":["X",1,{"b":"Y"}]}'), ("handles", "L0,P0,L1,S0,B0"), ("handles back", "k1,k2,k3,k4,k5"), ("list", '"1"^^<x:integer>,<b>'), ("list too long", None), ("list in a circle", None),
])
def driver_functions(spark):
    kinds = [("lens", "k1"), ("property", "k2"), ("lens", "k3"), ("selector", "k4"), ("branch", "k5")]
    names, back = retrieval.handles(kinds)
    graph = ShapeGraph(parse_turtle(HEAD + "d:s d:p ( 1 d:b ) . d:c <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> 1 ; <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> d:c ."))
    head = graph.forward[f"<{EX}s>", f"<{EX}p>"][0]
    members = lambda node, most: ",".join(map(short, graph.members(node, most)))
    maybe = lambda f: f() if accepted(f) else None
    return [
        ("strings mapped", terms.canonical_json(retrieval.map_strings({"a": ["x", 1, {"b": "y"}]}, str.upper))), ("handles", ",".join(names[k] for _, k in kinds)), ("handles back", ",".join(back[names[k]] for _, k in kinds)),
        ("list", members(head, 2)), ("list too long", maybe(lambda: members(head, 1))), ("list in a circle", maybe(lambda: members(f"<{EX}c>", 99))),
    ]


# Catalogs


@cases("shape string, predicate string, inverse boolean, branch long, classes string, datatypes string, allowed string, scalar boolean", [
    ("DepotShape", "in", False, 0, "Town", "", "", False), ("DepotShape", "feeds", False, 0, "", "", "", False), ("DepotShape", "state", False, 0, "", "", "<Open> <Shut>", True),
    ("LabelShape", "label", False, 0, "", "x:string", "", True), ("LabelShape", "opened", False, 0, "", "x:integer", "", True), ("LabelShape", "motto", False, 0, "", "", "", True),
    ("TownShape", "in", True, 0, "Depot", "", "", False), ("TownShape", "label", False, 0, "", "x:string", "", True), ("TownShape", "size", False, 0, "", "x:integer", "", True), ("TownShape", "size", False, 1, "", "x:string", "", True),
])
def catalog_properties(spark):
    """Paths and contracts, a row for each branch."""
    own = samples.catalog()
    join = lambda xs: " ".join(short(x) for x in xs)
    return [(short(own.lens(p.lens).shape)[1:-1], short(p.predicate), p.inverse, n, join(b.classes), join(b.datatypes), join(t.token for t in b.allowed), p.scalar) for p in own.properties for n, b in enumerate(p.branches)]


@cases("shape string, kind string, classes string, targets string", [
    ("DepotShape", "direct_type", "Depot", ""), ("FewShape", "target_nodes", "", "gone oslo"), ("LabelShape", "direct_type", "Depot", ""), ("MixedShape", "union", "Hub", "north"), ("TownShape", "direct_type", "Town", ""),
])
def catalog_selectors(spark):
    own = samples.catalog()
    return [(short(own.lens(s.lens).shape)[1:-1], s.kind, " ".join(map(short, s.classes)), " ".join(map(short, s.targets))) for s in own.selectors]


@cases("limits string, source string, shape string, code string, message string", [
    *((k, "depot", "OddShape", c, m) for k in ("default", "path 1") for c, m in (("target_class_non_iri", "a target class that is no IRI selects nothing"), ("path_unsupported", "only a predicate or the inverse of one is a path"))),
    ("path 1", "depot", "TownShape", "path_depth_exceeded", "the path is deeper than the limit"),
])
def catalog_diagnostics(spark):
    made = {"default": samples.catalog(), "path 1": samples.catalog(limits=CatalogLimits(path=1))}
    return [(k, d.source, short(d.shape)[1:-1], d.code, d.message) for k, c in made.items() for d in c.diagnostics]


@cases("fixtures string, accepted boolean", [("of the whole graph", True), ("of each record", True), ("missing for a record", False), ("empty for a record", False), ("twice for a record", False), ("not known", False), ("none at all", False), ("no owner", False), ("unknown behavior", False), ("record twice", False)])
def qualification_fixtures(spark):
    records = (("s", "selector", "x"), ("s", "property", "y"))
    make = lambda owner="o", rs=records, ids=("a", "b"), own=(): Qualification(owner, "1", rs, ids, own)
    made = {
        "of the whole graph": make, "of each record": lambda: make(own=(("a",), ("a", "b"))), "missing for a record": lambda: make(own=(("a",),)), "empty for a record": lambda: make(own=(("a",), ())), "twice for a record": lambda: make(own=(("a",), ("b", "b"))), "not known": lambda: make(own=(("a",), ("c",))),
        "none at all": lambda: make(ids=()), "no owner": lambda: make(owner=""), "unknown behavior": lambda: make(rs=(("s", "guess", "x"),)), "record twice": lambda: make(rs=records + records[:1]),
    }
    return [(k, accepted(v)) for k, v in made.items()]


@cases("step long, lenses long, files long", [(1, 6, 1), (2, 7, 2), (3, 6, 2)])
def catalog_publication(spark):
    """The current catalog of a folder is swapped whole; older ones stay for who still reads them."""
    one, two, out = samples.catalog(), samples.catalog(samples.source(), samples.source(HEAD + "d:A a sh:NodeShape .", source_id="more")), []
    with tempfile.TemporaryDirectory() as folder:  # the driver's own, for this call
        for n, c in enumerate((one, two, one), 1):
            c.publish(folder)
            now = Catalog.published(folder)
            out.append((n, len(now.lenses) if now == c else -1, len(list(Path(folder).glob("*.json")))))
    return out


@cases("source string, lenses long, usable_selectors long, usable_properties long, scalar_properties long", [
    ("trusted", 6, 5, 9, 6), ("untrusted", 6, 0, 0, 6), ("quarantined", 6, 5, 9, 6), ("untrusted part", 6, 0, 0, 6), ("no selector reviewed", 6, 0, 9, 6), ("no property reviewed", 6, 5, 0, 0), ("no scalar reviewed", 6, 5, 9, 0), ("text changed after review", 6, 5, 8, 5),
])
def catalog_trust(spark):
    """A quarantined source beside a trusted one adds nothing."""
    reviewed = samples.source()
    changed = replace(reviewed, triples=tuple(parse_turtle(SHAPES.replace("d:label ; sh:datatype x:string ; sh:maxCount 1 ] , [ sh:path d:opened", "d:label ; sh:datatype x:token ; sh:maxCount 1 ] , [ sh:path d:opened"))))
    made = {
        "trusted": [reviewed], "untrusted": [samples.source(trust="untrusted")], "quarantined": [reviewed, samples.source(trust="quarantined", source_id="other")], "untrusted part": [samples.source(closure=("trusted", "untrusted"))],
        "no selector reviewed": [samples.source(behaviors=("property", "scalar_projection"))], "no property reviewed": [samples.source(behaviors=("selector",))], "no scalar reviewed": [samples.source(behaviors=("selector", "property"))], "text changed after review": [changed],
    }
    out = []
    for k, sources in made.items():
        c = samples.catalog(*sources)
        out.append((k, len(c.lenses), sum(s.trusted and s.qualified for s in c.selectors), sum(p.trusted and p.qualified for p in c.properties), sum(p.scalar for p in c.properties)))
    return out


@cases("problem string, accepted boolean", [
    ("none", True), ("triples", False), ("bytes", False), ("card", False), ("list", False), ("recursion", False), ("limit of zero", False), ("list in a circle", False), ("empty or", False), ("blank node kind", False), ("two enumerations", False), ("shape in itself", False), ("two sources of one id", False), ("no source", False),
])
def catalog_limits(spark):
    made = {k: {"limits": v} for k, v in {"triples": lambda: CatalogLimits(triples=3), "bytes": lambda: CatalogLimits(bytes=10), "card": lambda: CatalogLimits(card_bytes=10), "list": lambda: CatalogLimits(list=1), "recursion": lambda: CatalogLimits(recursion=1), "limit of zero": lambda: CatalogLimits(path=0)}.items()}
    rdf = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#{}>".format
    bad = {"list in a circle": f"sh:in _:l ] . _:l {rdf('first')} 1 ; {rdf('rest')} _:l .", "empty or": "sh:or () ] .", "blank node kind": "sh:nodeKind sh:BlankNode ] .", "two enumerations": "sh:in (1) , (2) ] .", "shape in itself": "sh:node d:S ] ."}
    out = [("none", accepted(samples.catalog))] + [(k, accepted(lambda v=v: samples.catalog(limits=v["limits"]()))) for k, v in made.items()]
    out += [(k, accepted(lambda v=v: samples.catalog(samples.source(HEAD + "d:S a sh:NodeShape ; sh:property [ sh:path d:p ; " + v)))) for k, v in bad.items()]
    return out + [("two sources of one id", accepted(lambda: samples.catalog(samples.source(), samples.source()))), ("no source", accepted(lambda: Catalog.build([])))]


@cases("change string, accepted boolean", [("none", True), ("scalar", False), ("extra field", False), ("no revision", False), ("field missing", False), ("other revision", False), ("written and read", True)])
def catalog_artifact(spark):
    """The artifact as JSON text, and what it does not survive."""
    own = samples.catalog()
    raw = own.dump()
    text = terms.canonical_json(raw)
    changed = strict_json(text)
    changed["properties"][0]["scalar"] = not changed["properties"][0]["scalar"]
    made = {"none": raw, "scalar": changed, "extra field": raw | {"more": 1}, "no revision": raw | {"revision": ""}, "field missing": {k: v for k, v in raw.items() if k != "lenses"}, "other revision": raw | {"revision": "sha256:0"}}
    return [(k, accepted(lambda v=v: Catalog.reload(v))) for k, v in made.items()] + [("written and read", Catalog.reload(strict_json(text)) == own)]


@cases("overlay string, scalar boolean", [("none", False), ("granted", True), ("untrusted", False), ("not reviewed", False), ("reviewed for another property", False), ("descriptive", None)])
def catalog_overlays(spark):
    """Whether a field without maxCount may be returned."""
    text = SHAPES.replace("[ sh:path d:motto ; sh:maxCount 1 ]", "[ sh:path d:motto ]")
    shape = f"<{EX}LabelShape>"
    review = lambda n: Qualification("samples", "1", ((shape, "scalar_projection", property_signature(parse_turtle(text), EX + "LabelShape", EX + n)),), ("whole",))
    grant = Overlay("o", "executable", "samples", True, ((shape, EX + "motto"),), review("motto"))
    made = {"none": (), "granted": (grant,), "untrusted": (replace(grant, trusted=False),), "not reviewed": (replace(grant, qualification=None),), "reviewed for another property": (replace(grant, qualification=review("label")),)}
    out = [(k, samples.catalog(samples.source(text), overlays=v).find(EX + "LabelShape", EX + "motto").scalar) for k, v in made.items()]
    return out + [("descriptive", True if accepted(lambda: replace(grant, kind="descriptive")) else None)]


def _portable(word: str, owner: str, rest: str = "") -> str:
    name = f"portable-{word}"
    return f"'sha256:' || sha256('{len(name)}:{name}:[\"' || {owner} || '\"{rest}]')"


@case(f"""WITH l AS (SELECT {_portable('lens', "'depot'", f',"{EX}LabelShape"')} AS k), p AS (SELECT {_portable('property', 'k', f',"{EX}label",false,0')} AS k FROM l)
SELECT 'lens' AS item, k AS portable FROM l UNION ALL SELECT 'selector', {_portable('selector', 'k')} FROM l UNION ALL SELECT 'property', k FROM p UNION ALL SELECT 'branch', {_portable('branch', 'k', ',0')} FROM p""")
def catalog_portable_keys(spark, sf_dir):
    """Keys that outlive a build: those of one more source and another build id are the same."""
    own = Catalog.build([samples.source(HEAD + "d:A a sh:NodeShape .", source_id="more"), samples.source()], build_id="another")
    lens = own.find(EX + "LabelShape")
    prop = own.find(EX + "LabelShape", EX + "label")
    selector = next(s for s in own.selectors if s.lens == lens.key)
    return spark.createDataFrame([("lens", lens.portable), ("selector", selector.portable), ("property", prop.portable), ("branch", prop.branches[0].portable)], "item string, portable string")


@cases("place long, kind string, key string", [(0, "lens", "DepotShape"), (1, "lens", "FewShape"), (2, "lens", "LabelShape"), (3, "lens", "MixedShape"), (4, "lens", "OddShape"), (5, "lens", "TownShape"), (0, "selector", "DepotShape"), (1, "selector", "FewShape"), (2, "selector", "LabelShape"), (3, "selector", "MixedShape"), (4, "selector", "TownShape")])
def catalog_numbering(spark):
    """Local keys are numbered in the order of shapes."""
    own = samples.catalog()
    lens = [(int(x.key.rsplit(":", 1)[1]), "lens", short(x.shape)[1:-1]) for x in own.lenses]
    return lens + [(int(x.key.rsplit(":", 1)[1]), "selector", short(own.lens(x.lens).shape)[1:-1]) for x in own.selectors]


# Plans


def _plan_cases() -> dict:
    """name: (raw plan, parts of an engine)."""
    own = samples.catalog()
    good = lambda: samples.build(own, samples.towns)

    def changed(change):
        raw = good()
        change(raw)
        return raw

    drop = lambda part: lambda r: r[part].clear()
    again = lambda part: lambda r: r[part].append(r[part][0] | {"id": "again"})
    iri = {"kind": "iri", "value": EX + "x"}
    return {
        "good": (good(), {}), "no plan": ("text", {}), "unknown field": (changed(lambda r: r.update(more=1)), {}), "unknown kind": (changed(lambda r: r.update(kind="update")), {}), "other catalog": (changed(lambda r: r.update(catalog_revision="old")), {}),
        "entity bound to a literal": (changed(lambda r: r["entities"][1].update(binding={"kind": "literal", "value": "x"})), {}), "required is no flag": (changed(lambda r: r["projections"][0].update(required="yes")), {}), "select returns nothing": (changed(drop("projections")), {}),
        "id used twice": (changed(lambda r: r["entities"][1].update(id=r["entities"][0]["id"])), {}), "lens twice": (changed(again("lenses")), {}), "edge twice": (changed(again("edges")), {}), "projection twice": (changed(again("projections")), {}),
        "lens not used": (changed(lambda r: r["projections"].pop(0)), {}), "entity hangs loose": (changed(drop("edges")), {}), "two parts not connected": (changed(lambda r: r["entities"].append({"id": "x", "binding": iri})), {}), "nothing selects the entity": (changed(drop("selectors")), {}),
        "unknown property": (changed(lambda r: r["edges"][0].update(property_key="none")), {}), "property of another lens": (changed(lambda r: r["edges"][0].update(source_lens=r["projections"][0]["lens"])), {}),
        "value outside its datatype": (samples.build(own, samples.equal("LabelShape", "opened", Term.literal("2001"))), {}), "value outside the enumeration": (samples.build(own, samples.equal("DepotShape", "state", Term.iri(EX + "Lost"))), {}),
        "edge to a literal": (samples.build(own, samples.linked("LabelShape", "label")), {}), "target outside the enumeration": (samples.build(own, samples.linked("DepotShape", "state", "Lost")), {}), "field is not scalar": (samples.build(own, samples.with_field("DepotShape", "feeds")), {}),
        "untrusted catalog": (samples.build(c := samples.catalog(samples.source(trust="untrusted")), samples.towns), {"own": c}),
        "too many entities": (good(), {"policy": QueryPolicy(max_entities=1)}), "too many nodes": (good(), {"policy": QueryPolicy(max_nodes=1)}), "lenses not allowed": (good(), {"authorization": AuthorizationScope("s", lenses=frozenset())}), "properties not allowed": (good(), {"authorization": AuthorizationScope("s", properties=frozenset())}),
        "graphs not named": (good(), {"authorization": AuthorizationScope("s", graphs=frozenset({"urn:g"}))}),
    }


@cases("plan string, outcome string", [("good", "accepted"), *((k, "unsupported") for k in (
    "no plan", "unknown field", "unknown kind", "other catalog", "entity bound to a literal", "required is no flag", "select returns nothing", "id used twice", "lens twice", "edge twice", "projection twice", "lens not used", "entity hangs loose", "two parts not connected",
    "nothing selects the entity", "unknown property", "property of another lens", "value outside its datatype", "value outside the enumeration", "edge to a literal", "target outside the enumeration", "field is not scalar", "untrusted catalog")),
    *((k, "policy_limited") for k in ("too many entities", "too many nodes", "lenses not allowed", "properties not allowed", "graphs not named"))])
def plan_checks(spark):
    """What becomes of a plan before it is run."""
    out = []
    for name, (raw, parts) in _plan_cases().items():
        engine = samples.engine(spark, **parts)
        try:
            engine.compile(raw)
            out.append((name, "accepted"))
        except (AuthorizationError, PolicyError):
            out.append((name, "policy_limited"))
        except PlanError:
            out.append((name, "unsupported"))
    return out


def _renamed(raw: dict) -> dict:
    """The same plan with other ids, all lists reversed."""
    ids = {x["id"]: f"r{n}" for n, x in enumerate(x for v in raw.values() if isinstance(v, list) for x in reversed(v))}
    swap = lambda s: ids.get(s, s)
    return {k: list(reversed(retrieval.map_strings(v, swap))) if isinstance(v, list) else v for k, v in raw.items()}


def _alike(b, flip: bool = False) -> None:
    """Three depots in one town, of which one is in another too."""
    depots = [b.entity(EX + "DepotShape") for _ in range(3)]
    town, other = b.entity(), b.entity(bound=EX + "rome")
    lens = [b.lens(d, EX + "DepotShape") for d in depots]
    for use in lens:
        b.edge(use, EX + "in", town)
    b.edge(lens[0 if flip else 2], EX + "in", other)
    for d in depots:
        b.node(d, f"n{d}")


@cases("pair string, same_plan boolean, same_query boolean", [("renamed and reversed", True, True), ("entities alike but for a neighbour", True, True), ("one filter more", False, False), ("field optional", False, False), ("other bound entity", False, False)])
def plan_canonical(spark):
    """Equal plans have equal digests, near ones do not."""
    engine, own = samples.engine(spark), samples.catalog()
    base = samples.build(own, samples.towns)

    def more(b):
        samples.towns(b)
        b.exists(b.raw["lenses"][1]["id"], EX + "opened")

    optional, bound = samples.build(own, samples.towns), samples.build(own, samples.towns)
    optional["projections"][0]["required"] = False
    bound["entities"][1]["binding"]["value"] = EX + "rome"
    pairs = {"renamed and reversed": (base, _renamed(base)), "entities alike but for a neighbour": (samples.build(own, _alike), _renamed(samples.build(own, lambda b: _alike(b, True)))), "one filter more": (base, samples.build(own, more)), "field optional": (base, optional), "other bound entity": (base, bound)}
    out = []
    for name, two in pairs.items():
        a, b = (engine.explain_plan(x) for x in two)
        out.append((name, a.plan_digest == b.plan_digest, a.query_digest == b.query_digest))
    return out


@cases("plan string, entities long, atoms string, columns string", [("towns", 2, "selector0 edge0 shown0 shown1", "shown0 shown1 entity0 entity1"), ("ask", 2, "selector0 edge0", "entity0 entity1"), ("one class", 1, "selector0 shown0", "shown0 entity0")])
def plan_explained(spark):
    engine, own = samples.engine(spark), samples.catalog()
    made = {"towns": samples.build(own, samples.towns), "ask": samples.build(own, samples.linked("DepotShape", "in", "oslo"), "ask"), "one class": samples.build(own, samples.selected("DepotShape"))}
    out = []
    for name, raw in made.items():
        x = engine.explain_plan(raw)
        out.append((name, len(x.plan.entities), " ".join(x.atoms), " ".join(x.columns)))
    return out


@cases("plan string, nodes long", [("one class", 2), ("edge to a bound town", 6), ("equality", 4), ("optional field", 4)])
def plan_size(spark):
    """Patterns of the compiled query."""
    engine, own = samples.engine(spark), samples.catalog()
    made = {"one class": samples.selected("DepotShape"), "edge to a bound town": samples.towns, "equality": samples.equal("LabelShape", "label", Term.literal("North")), "optional field": samples.with_field("LabelShape", "motto", required=False)}
    return [(k, engine.compile(samples.build(own, v)).nodes) for k, v in made.items()]


@cases("plan string, text string", [
    ("towns", f'SELECT DISTINCT ?shown0 ?entity0 ?entity1 WHERE {{ VALUES ?entity1 {{ <oslo> }} VALUES ?selector0 {{ <Depot> }} ?entity0 <{_RDF_TYPE}> ?selector0 . ?entity0 <in> ?entity1 . ?entity1 <{_RDF_TYPE}> <Town> . ?entity0 <label> ?shown0 . }}'),
    ("ask", f"ASK {{ VALUES ?entity1 {{ <oslo> }} VALUES ?selector0 {{ <Depot> }} ?entity0 <{_RDF_TYPE}> ?selector0 . ?entity0 <in> ?entity1 . ?entity1 <{_RDF_TYPE}> <Town> . }}"),
    ("union", f"SELECT DISTINCT ?entity0 WHERE {{ {{ VALUES ?selector0 {{ <Hub> }} ?entity0 <{_RDF_TYPE}> ?selector0 . }} UNION {{ VALUES ?entity0 {{ <north> }} }} }}"),
    ("equal", f'SELECT DISTINCT ?entity0 WHERE {{ VALUES ?selector0 {{ <Depot> }} ?entity0 <{_RDF_TYPE}> ?selector0 . ?entity0 <label> ?filter0 . FILTER(sameTerm(?filter0, "a \\"b\\" }}")) }}'),
    ("optional enumeration", f"SELECT DISTINCT ?shown0 ?entity0 WHERE {{ VALUES ?selector0 {{ <Depot> }} ?entity0 <{_RDF_TYPE}> ?selector0 . OPTIONAL {{ ?entity0 <state> ?shown0 . VALUES ?shown0 {{ <Open> <Shut> }} }} }}"),
    ("inverse", f"SELECT DISTINCT ?entity0 ?entity1 WHERE {{ VALUES ?entity1 {{ <south> }} VALUES ?selector0 {{ <Town> }} ?entity0 <{_RDF_TYPE}> ?selector0 . ?entity1 <in> ?entity0 . ?entity1 <{_RDF_TYPE}> <Depot> . }}"),
])
def plan_text(spark):
    """Plans as graph queries, read back before they are shown."""
    engine, own = samples.engine(spark), samples.catalog()
    made = {"towns": (samples.towns, "select"), "ask": (samples.linked("DepotShape", "in", "oslo"), "ask"), "union": (samples.selected("MixedShape"), "select"), "equal": (samples.equal("LabelShape", "label", Term.literal('a "b" }')), "select"), "optional enumeration": (samples.with_field("DepotShape", "state", required=False), "select"), "inverse": (samples.linked("TownShape", "in", "south", inverse=True), "select")}
    return [(k, short(engine.explain_plan(samples.build(own, fill, kind)).text)) for k, (fill, kind) in made.items()]


@cases("pair string, same_skeleton boolean", [("other town", True), ("other value", True), ("other property", False), ("optional field", False)])
def plan_skeletons(spark):
    """Candidates that differ in bound entities and compared values only are one."""
    engine, own = samples.engine(spark), samples.catalog()
    town = lambda n: samples.linked("DepotShape", "in", n)
    equal = lambda n, v: samples.equal("LabelShape", n, Term.literal(v) if n != "opened" else Term.literal(v, XSD + "integer"))
    field = lambda required: samples.with_field("LabelShape", "motto", required)
    pairs = {"other town": (town("oslo"), town("rome")), "other value": (equal("label", "a"), equal("label", "b")), "other property": (equal("label", "1"), equal("opened", "1")), "optional field": (field(True), field(False))}
    key = lambda fill: text.skeleton(engine.prepare(samples.build(own, fill)))
    return [(k, key(a) == key(b)) for k, (a, b) in pairs.items()]


@cases("outcome string, n long", [("another plan", 6), ("unsupported", 5)])
def plan_mutations(spark):
    """Plans one change away from a good one: each is refused or another plan, never the same."""
    engine, own = samples.engine(spark), samples.catalog()
    raw = samples.build(own, samples.towns)
    base, met = engine.prepare(raw).digest, Counter()
    for _, changed in text.mutations(raw, own):
        ok = accepted(lambda r=changed: engine.prepare(r))
        met["unsupported" if not ok else "the same plan" if engine.prepare(changed).digest == base else "another plan"] += 1
    return list(met.items())


# Outcomes


class _Broken(FactsTable):
    """A source that does not answer."""

    def relation(self, predicate):
        raise RuntimeError("store is gone")


def _interrupted(compiled, wanted):
    raise RuntimeError("job was cancelled by another")


def _facts(spark, text: str = samples.DATA, graph: str | None = None) -> DataFrame:
    return facts_frame(spark, parse_turtle(text), graph).coalesce(1)


@cases("run string, kind string, n_rows long, more boolean, completeness string", [
    ("depots in a town", "selected", 2, False, "complete"), ("one example", "selected", 1, True, "incomplete"), ("examples enough", "selected", 4, False, "complete"), ("no depot there", "no_match", 0, False, "complete"), ("yes", "boolean", 0, False, "complete"), ("no", "no_match", 0, False, "complete"),
    ("more rows than allowed", "policy_limited", None, None, None), ("more examples than allowed", "policy_limited", None, None, None), ("request of another type", "unsupported", None, None, None), ("cancelled", "failed", None, None, None), ("source breaks", "failed", None, None, None),
    ("two labels", "failed", 0, False, "unknown"), ("value outside its contract", "failed", 0, False, "unknown"), ("literal as entity", "failed", 0, False, "unknown"), ("blank node", "failed", 0, False, "unknown"), ("result too large", "failed", 0, False, "unknown"), ("deadline", "failed", 0, False, "unknown"), ("stale catalog", "unsupported", None, None, None),
    ("untrusted source", "unsupported", None, None, None), ("semantics not reviewed", "unsupported", None, None, None), ("malformed answer", "failed", 0, False, "unknown"), ("interrupted", "failed", 0, False, "unknown"),
])
def engine_outcomes(spark):
    """Every kind of outcome; what goes wrong is never an answer."""
    own = samples.catalog()
    raw = lambda fill, kind="select": samples.build(own, fill, kind)
    every, towns = raw(samples.selected("DepotShape")), raw(samples.towns)
    engine = lambda **parts: samples.engine(spark, **parts)
    policy = lambda **v: {"policy": QueryPolicy(**{"timeout_seconds": 300} | v)}
    runs = {
        "depots in a town": (towns, None, {}), "one example": (every, ExecutionRequest.examples(1), {}), "examples enough": (every, ExecutionRequest.examples(9), {}), "no depot there": (raw(samples.linked("DepotShape", "in", "gone")), None, {}),
        "yes": (raw(samples.linked("DepotShape", "in", "oslo"), "ask"), None, {}), "no": (raw(samples.linked("DepotShape", "in", "nowhere"), "ask"), None, {}),
        "more rows than allowed": (every, None, policy(max_result_rows=3)), "more examples than allowed": (every, ExecutionRequest.examples(4), policy(max_result_rows=3)), "request of another type": (every, "all", {}), "cancelled": (every, ExecutionRequest(cancelled=True), {}), "source breaks": (towns, None, {"source": _Broken(_facts(spark))}),
        "two labels": (raw(samples.with_field("LabelShape", "label")), None, {}), "value outside its contract": (raw(samples.with_field("TownShape", "size")), None, {}), "literal as entity": (raw(samples.linked("DepotShape", "feeds")), None, {}),
        "blank node": (every, None, {"source": FactsTable(_facts(spark, samples.DATA + "[] a d:Depot ."))}), "result too large": (towns, None, policy(max_result_bytes=10)), "deadline": (towns, None, policy(timeout_seconds=0.001)), "stale catalog": (every | {"catalog_revision": "sha256:0"}, None, {}),
    }
    untrusted, bare = samples.catalog(samples.source(trust="untrusted")), samples.catalog(samples.source(behaviors=("selector",)))
    odd = spark.createDataFrame([(None, "junk", f"<{_RDF_TYPE}>", f"<{EX}Depot>")], "g string, s string, p string, o string")
    runs |= {"untrusted source": (samples.build(untrusted, samples.towns), None, {"own": untrusted}), "semantics not reviewed": (samples.build(bare, samples.towns), None, {"own": bare}), "malformed answer": (every, None, {"source": FactsTable(odd)}), "interrupted": (every, None, {})}
    out = []
    for name, (plan, request, parts) in runs.items():
        own_engine = engine(**parts)
        if name == "interrupted":
            own_engine.fetch = _interrupted
        got = own_engine.execute_plan(plan, request)
        p = getattr(got, "packet", None)
        out.append((name, got.kind, *((p.row_count, p.more, p.completeness) if p else (None,) * 3)))
    return out


@cases("run string, line long, text string", [
    ("depots in a town", 1, '"North"\t<north>'), ("depots in a town", 2, '"West"\t<west>'), ("one example", 1, '"North"\t<north>'), ("one example", 2, "... more rows exist"), ("unbound field", 1, "\t<north>"), ("unbound field", 2, "\t<twin>"), ("unbound field", 3, "\t<west>"), ("unbound field", 4, '"sempre"@it\t<south>'),
    ("yes", 1, "true"), ("no", 1, "no visible solution in this dataset and scope"), ("cancelled", 1, "failed: cancelled"),
])
def engine_text(spark):
    """Outcomes as text, rows in the canonical order."""
    engine, own = samples.engine(spark), samples.catalog()
    ask = lambda town: samples.build(own, samples.linked("DepotShape", "in", town), "ask")
    towns = samples.build(own, samples.towns)
    runs = {"depots in a town": (towns, None), "one example": (towns, ExecutionRequest.examples(1)), "unbound field": (samples.build(own, samples.with_field("LabelShape", "motto", required=False)), None), "yes": (ask("oslo"), None), "no": (ask("nowhere"), None), "cancelled": (towns, ExecutionRequest(cancelled=True))}
    return [(name, n, short(text)) for name, (raw, request) in runs.items() for n, text in enumerate(render_result(engine.execute_plan(raw, request)).split("\n"), 1)]


# Evidence


def _mixed(b) -> None:
    """A hub or a given depot, with a compared, an existing and an unbound field."""
    e = b.entity(EX + "MixedShape")
    use = b.lens(e, EX + "LabelShape")
    b.eq(use, EX + "opened", Term.literal("2001", XSD + "integer")).exists(use, EX + "label").field(use, EX + "motto", "motto", required=False).node(e, "depot")


def _inverse(b) -> None:
    e, depot = b.entity(EX + "TownShape"), b.entity(bound=EX + "south")
    b.edge(b.lens(e, EX + "TownShape"), EX + "in", depot, inverse=True).node(e, "town")


_FACTS = {  # run: (row, atom, kind, status, facts)
    "towns": [
        *((d, *rest) for d, label in (("north", "North"), ("west", "West")) for rest in (
            ("selector0", "selector", "witnessed", f"<{d}> a <Depot>"), ("edge0", "edge", "witnessed", f"<{d}> in <oslo>; <oslo> a <Town>"), ("shown0", "projection", "witnessed", f'<{d}> label "{label}"'), ("shown1", "projection", "derived", ""))),
    ],
    "mixed": [("north", "selector0", "selector", "derived", ""), ("north", "filter0", "filter", "derived", '<north> opened "2001"^^<x:integer>'), ("north", "filter1", "filter", "derived", '<north> label "North"'), ("north", "shown0", "projection", "optional_unbound", ""), ("north", "shown1", "projection", "derived", "")],
    "inverse": [("rome", "selector0", "selector", "witnessed", "<rome> a <Town>"), ("rome", "edge0", "edge", "witnessed", "<south> in <rome>; <south> a <Depot>"), ("rome", "shown0", "projection", "derived", "")],
}


@cases("run string, row string, atom string, kind string, status string, facts string", [(k, *x) for k, v in _FACTS.items() for x in v])
def engine_evidence(spark):
    """Every support of every row, from the packets that execution returns: facts keep their own direction."""
    engine, own, out = samples.engine(spark), samples.catalog(), []
    for name, fill in (("towns", samples.towns), ("mixed", _mixed), ("inverse", _inverse)):
        got = engine.execute_plan(samples.build(own, fill))
        by_id = {w.id: w for w in got.packet.witnesses}
        say = lambda w: f"{short(w.subject.token)} {'a' if w.predicate == _RDF_TYPE else short(w.predicate)} {short(w.object.token)}"
        for row, c in zip(got.rows, got.packet.certificates):
            out += [(name, short(row.values[-1].value), s.atom, s.kind, s.status, "; ".join(say(by_id[i]) for i in s.witnesses)) for s in c.supports]
    return out


def _witness_sql(atom: str, s: str, p: str, o: str) -> str:
    text = terms.canonical_json(["run-1", atom, s, p, o])
    return f"SELECT {_literal(atom)} AS atom, {_literal(s)} AS s, 'sha256:' || sha256({_literal('7:witness:' + text)}) AS id"


_NORTH = [("selector0", f"<{EX}north>", _RDF_TYPE, f"<{EX}Depot>"), ("edge0", f"<{EX}north>", EX + "in", f"<{EX}oslo>"), ("edge0", f"<{EX}oslo>", _RDF_TYPE, f"<{EX}Town>"), ("shown0", f"<{EX}north>", EX + "label", '"North"')]


@case(" UNION ALL ".join(_witness_sql(*x) for x in [*_NORTH, *((a, s.replace("north", "west"), p, o.replace("North", "West")) for a, s, p, o in _NORTH if s != f"<{EX}oslo>")]))
def evidence_ids(spark, sf_dir):
    """Witness ids of an execution; a fact that supports two rows is one witness."""
    got = samples.engine(spark).execute_plan(samples.build(samples.catalog(), samples.towns), execution_id="run-1")
    return spark.createDataFrame([(w.atom, w.subject.token, w.id) for w in got.packet.witnesses], "atom string, s string, id string")


def _json(kind: str, value: str) -> dict:
    return {"kind": kind, "value": value, "datatype": None, "language": None}


_ROWS = [[[_json("literal", label), _json("iri", EX + d)], [["entity0", _json("iri", EX + d)], ["entity1", _json("iri", EX + "oslo")]]] for d, label in (("north", "North"), ("west", "West"))]


@case(" UNION ALL ".join(f"SELECT {n} AS position, 'sha256:' || sha256({_literal('3:row:' + terms.canonical_json(r))}) AS row_key, TRUE AS certified" for n, r in enumerate(_ROWS)))
def evidence_row_keys(spark, sf_dir):
    """A row's key covers its values and all entities, hidden ones too."""
    got = samples.engine(spark).execute_plan(samples.build(samples.catalog(), samples.towns))
    return spark.createDataFrame([(n, r.key, c.row_key == r.key) for n, (r, c) in enumerate(zip(got.rows, got.packet.certificates))], "position int, row_key string, certified boolean")


@cases("depot string, atom string, status string, fact string, certified boolean", [(d, a, st, f, True) for d, label in (("north", "North"), ("west", "West")) for a, st, f in (("selector0", "witnessed", f"<{d}> <{_RDF_TYPE}> <Depot>"), ("edge0", "witnessed", f"<{d}> <in> <oslo>"), ("edge0", "witnessed", f"<oslo> <{_RDF_TYPE}> <Town>"), ("shown0", "witnessed", f'<{d}> <label> "{label}"'), ("shown1", "derived", None))])
def packet_rows(spark):
    """A packet as a table of supports, and as JSON that reads back."""
    got = samples.engine(spark).execute_plan(samples.build(samples.catalog(), samples.towns))
    raw = strict_json(terms.canonical_json(evidence.packet_record(got.packet)))
    depot = {r.key: short(r.values[-1].value) for r in got.rows}
    known = {c["row_key"]: c["id"] for c in raw["certificates"]}
    rows = evidence.packet_supports(spark, got.packet).collect()  # bounded by the result's rows
    return [(depot[r.row_key], r.atom, r.status, r.s and f"{short(r.s)} <{short(r.p)}> {short(r.o)}", known[r.row_key] == r.certificate) for r in rows]


_CHANGES = ("support missing", "support twice", "support derived", "field unbound", "certificate twice", "certificates swapped", "row count", "more rows", "plan digest", "query digest", "catalog revision", "policy revision", "authorization", "dataset", "not completed", "completeness", "packet id", "witness missing", "witness changed", "witness asserted", "witness of another run", "boolean set", "row missing", "row key", "row without entities", "witness not in the data")


@cases("change string, accepted boolean", [("none", True), *((c, False) for c in _CHANGES)])
def packet_checks(spark):
    """Packets and rows after one change each, checked against plan and data."""
    engine = samples.engine(spark)
    raw = samples.build(samples.catalog(), samples.towns)
    got = engine.execute_plan(raw)
    compiled, p, rows = engine.compile(raw), got.packet, got.rows
    one, w = p.certificates[0], p.witnesses[0]
    with_one = lambda c: replace(p, certificates=(c, *p.certificates[1:])).sealed()
    with_witness = lambda x: replace(p, witnesses=(x, *p.witnesses[1:])).sealed()
    field = next(s for s in one.supports if s.atom == "shown0")
    empty = Engine(spark, FactsTable(_facts(spark, samples.DATA.replace('d:label "North"', 'd:label "Norther"'))), engine.catalog, samples.EVERYONE, policy=engine.policy)
    packets = {
        "none": p, "support missing": with_one(replace(one, supports=one.supports[:-1])), "support twice": with_one(replace(one, supports=one.supports + one.supports[:1])), "support derived": with_one(replace(one, supports=(replace(one.supports[0], status="derived"), *one.supports[1:]))),
        "field unbound": with_one(replace(one, supports=tuple(replace(s, status="optional_unbound", witnesses=()) if s is field else s for s in one.supports))), "certificate twice": replace(p, certificates=p.certificates + p.certificates[:1]).sealed(), "certificates swapped": replace(p, certificates=p.certificates[::-1]).sealed(),
        "row count": replace(p, row_count=7).sealed(), "more rows": replace(p, more=True).sealed(), "plan digest": replace(p, plan_digest="x").sealed(), "query digest": replace(p, query_digest="x").sealed(), "catalog revision": replace(p, catalog_revision="x").sealed(), "policy revision": replace(p, policy_revision="x").sealed(),
        "authorization": replace(p, authorization_digest="x").sealed(), "dataset": replace(p, dataset_digest="x").sealed(), "not completed": replace(p, completed=False).sealed(), "completeness": replace(p, completeness="unknown").sealed(), "packet id": replace(p, id="x"), "boolean set": replace(p, boolean=True).sealed(),
        "witness missing": replace(p, witnesses=p.witnesses[1:]).sealed(), "witness changed": with_witness(replace(w, object=Term.iri(EX + "none"))), "witness asserted": with_witness(replace(w, assertion="asserted")), "witness of another run": with_witness(replace(w, execution_id="x")),
    }
    checks = {k: (engine, v, rows) for k, v in packets.items()}
    checks |= {"row missing": (engine, p, rows[:1]), "row key": (engine, p, (replace(rows[0], key="x"), *rows[1:])), "row without entities": (engine, p, (replace(rows[0], bindings=()), *rows[1:])), "witness not in the data": (empty, p, rows)}
    return [(k, accepted(lambda v=v: v[0].verify(compiled, v[1], v[2]))) for k, v in checks.items()]


@cases("fact string, there boolean", [("north in oslo", True), ("oslo in north", False), ("north in rome", False), ("west a Hub", True), ("north a Hub", False), ('south label South "S"', True), ("north none oslo", False)])
def fact_probe(spark):
    """Single facts looked up in their physical direction."""
    source = samples.engine(spark).source
    iri = lambda n: Term.iri(EX + n)
    asked = {"north in oslo": (iri("north"), EX + "in", iri("oslo")), "oslo in north": (iri("oslo"), EX + "in", iri("north")), "north in rome": (iri("north"), EX + "in", iri("rome")), "west a Hub": (iri("west"), _RDF_TYPE, iri("Hub")), "north a Hub": (iri("north"), _RDF_TYPE, iri("Hub")), 'south label South "S"': (iri("south"), EX + "label", Term.literal('South "S"')), "north none oslo": (iri("north"), EX + "none", iri("oslo"))}
    return [(k, evidence.facts_exist(spark, source, (evidence.Witness("w", "run", "a", s, p, o),))) for k, (s, p, o) in asked.items()]


# From questions to plans


_NOTE = "kind string, shape string, predicate string, inverse boolean, label string, aliases array<string>, description string, provider_allowed boolean"


@cases("kind string, shape string, label string", [("lens", "DepotShape", "Depot"), ("property", "DepotShape", "lies in"), ("property", "TownShape", "depots"), ("selector", "TownShape", "all towns")])
def approved_cards(spark):
    """Catalog items with an approved note; direction and approval count."""
    notes = [("lens", "DepotShape", None, None, "Depot", True), ("property", "DepotShape", "in", False, "lies in", True), ("property", "TownShape", "in", True, "depots", True), ("property", "TownShape", "in", False, "wrong way", True), ("property", "DepotShape", "state", False, "secret", False), ("selector", "TownShape", None, None, "all towns", True), ("lens", "NoShape", None, None, "none", True)]
    rows = [(k, EX + s, p and EX + p, i, label, [], "", ok) for k, s, p, i, label, ok in notes]
    return [(r.kind, short(r.shape), r.label) for r in retrieval.approved_cards(samples.catalog(), spark.createDataFrame(rows, _NOTE)).collect()]


@cases("intents string, accepted boolean", [("one for each atom", True), ("one missing", False), ("one twice", False), ("one for no atom", False), ("not named", False), ("of their kinds", True), ("of another kind", False)])
def intent_coverage(spark):
    raw = samples.build(samples.catalog(), samples.towns)
    atoms = [{"atom": x["id"]} for part in ("selectors", "edges", "filters", "projections") for x in raw[part]]
    made = {"one for each atom": atoms, "one missing": atoms[1:], "one twice": atoms + atoms[:1], "one for no atom": [*atoms, {"atom": "none"}], "not named": [*atoms[1:], {"atom": None}]}
    kinds = [{"atom": x["id"], "kind": retrieval.INTENT_OF[part]} for part in retrieval.INTENT_OF for x in raw[part]]
    made |= {"of their kinds": kinds, "of another kind": [kinds[0] | {"kind": "output"}, *kinds[1:]]}
    return [(k, accepted(lambda v=v: retrieval.check_coverage(v, raw))) for k, v in made.items()]


@cases("planner string, status string, calls long, n_rows long", [
    ("good", "completed", 1, 2), ("nonsense, then good", "completed", 2, 2), ("nonsense only", "unsupported", 2, None), ("binds an entity itself", "unsupported", 2, None), ("leaves its cards", "unsupported", 2, None), ("intent missing", "unsupported", 2, None), ("mention of two things", "ambiguous", 1, None), ("mention of nothing", "unsupported", 1, None),
])
def planner_loop(spark):
    """Proposals of a planner, at most two, accepted or refused."""
    engine = samples.engine(spark)
    raw = samples.build(engine.catalog, samples.towns)
    raw["entities"][1]["binding"] = None
    atoms = [{"atom": x["id"]} for part in ("selectors", "edges", "filters", "projections") for x in raw[part]]
    good = {"intents": atoms, "mentions": {raw["entities"][1]["id"]: "the capital"}, "plan": raw}
    bound = good | {"plan": samples.build(engine.catalog, samples.towns)}
    names = {"the capital": ("resolved", EX + "oslo"), "a place": ("ambiguous", None)}
    called = lambda text: good | {"mentions": {k: text for k in good["mentions"]}}
    all_cards = [{"key": k} for k in engine.catalog.by_key]
    runs = {"good": ([good], all_cards), "nonsense, then good": (["?", good], all_cards), "nonsense only": (["?"], all_cards), "binds an entity itself": ([bound], all_cards), "leaves its cards": ([good], all_cards[:1]), "intent missing": ([good | {"intents": atoms[1:]}], all_cards), "mention of two things": ([called("a place")], all_cards), "mention of nothing": ([called("x")], all_cards)}
    out = []
    for name, (proposals, cards) in runs.items():
        seen = []

        def planner(question, given):
            seen.append(question)
            return proposals[min(len(seen), len(proposals)) - 1]

        a = retrieval.ask(engine, planner, "which depots are in the capital?", cards, lambda m: names.get(m, ("unsupported", None)))
        out.append((name, a.status, len(seen), len(a.outcome.rows) if a.outcome else None))
    return out


@cases("values string, accepted boolean, same_plan boolean", [("entity", True, False), ("option", True, True), ("unknown option", False, None), ("slot not filled", False, None), ("no IRI", False, None), ("no such place", False, None), ("one value too many", False, None)])
def template_slots(spark):
    """Reviewed plans with declared slots."""
    engine = samples.engine(spark)
    raw = samples.build(engine.catalog, samples.towns)
    slot = retrieval.Slot("town", "entity", ("entities", 1, "binding"))
    enum = replace(slot, kind="enum", options={"the capital": Term.iri(EX + "oslo")})
    made = {"entity": ([slot], {"town": EX + "rome"}), "option": ([enum], {"town": "the capital"}), "unknown option": ([enum], {"town": "x"}), "slot not filled": ([slot], {}), "no IRI": ([slot], {"town": "rome"}), "no such place": ([replace(slot, path=("entities", 7))], {"town": EX + "x"}), "one value too many": ([slot], {"town": EX + "x", "more": "x"})}
    out = []
    for name, (slots, given) in made.items():
        fill = lambda s=slots, v=given: retrieval.instantiate(raw, s, v)
        ok = accepted(fill)
        out.append((name, ok, engine.prepare(fill()).digest == engine.prepare(raw).digest if ok else None))
    return out


@cases("mentions string, accepted boolean", [("whole words", True), ("another text", False), ("outside", False), ("overlapping", False), ("part of a word", False), ("blanks around", False)])
def span_checks(spark):
    """Mentions stand in the question where they say they do."""
    q = "Depots in Oslo or Rome?"
    made = {"whole words": {"a": (10, 14, "Oslo"), "b": (18, 22, "Rome")}, "another text": {"a": (10, 14, "oslo")}, "outside": {"a": (18, 99, "Rome?")}, "overlapping": {"a": (10, 14, "Oslo"), "b": (10, 17, "Oslo or")}, "part of a word": {"a": (10, 13, "Osl")}, "blanks around": {"a": (9, 14, " Oslo")}}
    return [(k, accepted(lambda v=v: retrieval.check_spans(q, v))) for k, v in made.items()]


@cases("mention string, any_type string, town string", [("north", "resolved", "unsupported"), ("Oslo!", "resolved", "resolved"), ("second", "resolved", "unsupported"), ("<http://depot.test/rome>", "resolved", "resolved"), ("paris", "unsupported", "unsupported")])
def typed_entities(spark):
    """Mentions by label or IRI, of any node and of towns only."""
    source = samples.engine(spark).source
    labels = source.relation(EX + "label").rows.groupBy(F.col("src").alias("iri")).agg(F.collect_list(F.regexp_replace("dst", '^"|"$', "")).alias("names"))
    asked = spark.createDataFrame([("north",), ("Oslo!",), ("second",), ("<http://depot.test/rome>",), ("paris",)], "mention string")
    towns = source.members(EX + "Town")[0].select(F.col("node").alias("iri"))
    every, some = ({r.mention: r.status for r in retrieval.resolve_entities(asked, labels, t).collect()} for t in (None, towns))
    return [(m, every[m], some[m]) for m in every]


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda x: len(x) > 2))"


@query(f"""WITH c AS (SELECT 'part/' || p_partkey AS key, p_name, p_type FROM part), w AS (SELECT key, unnest({_WORDS.format('p_name')}) AS word, 3.0 AS w FROM c UNION ALL SELECT key, unnest({_WORDS.format('p_type')}), 1.0 FROM c),
i AS (SELECT word, key, CAST(sum(w) AS DOUBLE) AS weight FROM w WHERE word <> 'with' GROUP BY ALL), s AS (SELECT key, sum(weight) AS score FROM i WHERE word IN ('large', 'polished', 'steel', 'part') GROUP BY key)
SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS position FROM s ORDER BY score DESC, key LIMIT 40""")
def lexical_index(spark, sf_dir):
    """Cards found by their words, a label's counting more than a type's."""
    cards = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part/"), "p_partkey").alias("key"), "p_name", "p_type")
    return retrieval.search_index(retrieval.lexical_index(cards, {"p_name": 3, "p_type": 1}), "the large polished steel part", 40)


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT vec_id, round(list_cosine_similarity(e.v, q.v), 9) AS score FROM e, q ORDER BY list_cosine_similarity(e.v, q.v) DESC, vec_id LIMIT 10""")
def embedding_suggestions(spark, sf_dir):
    """Neighbours by vector among what a plan has confirmed."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    like = vectors.filter("vec_id = 0").first()["embedding"]
    fine = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    found = retrieval.suggest(vectors, F.array(*(F.lit(float(x)) for x in like)), fine, 10, "vec_id", "embedding")
    return found.withColumn("score", F.round("score", 9))


@query("SELECT p_partkey AS partkey, trim(regexp_replace(lower(p_name || '--' || p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS signature FROM part")
def label_signatures(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(F.col("p_partkey").alias("partkey"), retrieval.label_signature(F.concat("p_name", F.lit("--"), "p_brand")).alias("signature"))


@query("SELECT o_orderpriority AS grp, CAST(count(DISTINCT o_custkey) AS DOUBLE) / count(*) AS diversity FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) x WHERE n <= 50 GROUP BY o_orderpriority")
def diversity_at_k(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("grp", F.col("o_orderpriority"))
    return metrics.diversity_at(rows, 50, "grp", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_custkey"))


# Profiles


_FP = "SELECT '<urn:td:customer/' || c_custkey || '>' AS s, '<urn:td:nation>' AS p, '<urn:td:nation/' || c_nationkey || '>' AS o FROM customer UNION ALL SELECT '<urn:td:document/' || doc_id || '>', '<urn:td:says>', '\"x\"@' || lang FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT '<urn:td:part/' || p_partkey || '>', '<urn:td:size>', '\"' || p_size || '\"' || CASE WHEN p_size % 7 = 0 THEN '' ELSE '^^<http://www.w3.org/2001/XMLSchema#integer>' END FROM part"


def _profiled(spark, sf_dir) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    node = lambda kind, c: F.concat(F.lit(f"<urn:td:{kind}/"), F.col(c).cast("string"), F.lit(">"))
    fact = lambda df, s, p, o: df.select(s.alias("s"), F.lit(f"<urn:td:{p}>").alias("p"), o.alias("o"))
    size = F.concat(F.lit('"'), F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 == 0, '"').otherwise(f'"^^<{XSD}integer>'))
    says = fact(t("documents").filter("doc_id IS NOT NULL AND lang IS NOT NULL"), node("document", "doc_id"), "says", F.concat(F.lit('"x"@'), "lang"))
    return fact(t("customer"), node("customer", "c_custkey"), "nation", node("nation", "c_nationkey")).unionByName(says).unionByName(fact(t("part"), node("part", "p_partkey"), "size", size))


@query(f"SELECT p, degree, count(*) AS n_values FROM (SELECT p, o, count(DISTINCT s) AS degree FROM ({_FP}) f GROUP BY p, o) g GROUP BY p, degree")
def profile_fan_in(spark, sf_dir):
    return profile.fan_in(_profiled(spark, sf_dir))


@query(f"SELECT p, nullif(regexp_extract(o, '@([a-z-]+)$', 1), '') AS language, count(*) AS n_facts FROM ({_FP}) f WHERE o LIKE '\"%' GROUP BY ALL")
def profile_languages(spark, sf_dir):
    return profile.languages(_profiled(spark, sf_dir))


@query(f"SELECT p, s, o, position, n_odd FROM (SELECT p, s, o, row_number() OVER (PARTITION BY p ORDER BY s, o) AS position, count(*) OVER (PARTITION BY p) AS n_odd FROM ({_FP}) f WHERE p = '<urn:td:size>' AND o NOT LIKE '%integer>') x WHERE position <= 3")
def profile_counterexamples(spark, sf_dir):
    """Facts that are not what a contract expects, the first few of each predicate."""
    expected = spark.createDataFrame([("<urn:td:size>", "literal", XSD + "integer"), ("<urn:td:nation>", "iri", None), ("<urn:td:says>", "literal", None)], "p string, o_kind string, datatype string")
    return profile.counterexamples(_profiled(spark, sf_dir), expected)


@cases("cls string", [("<Harbour>",), ("<Quay>",)])
def profile_empty_classes(spark):
    asked = spark.createDataFrame([(f"<{EX}{c}>",) for c in ("Depot", "Harbour", "Town", "Quay", "Quay")], "cls string")
    return [(short(r.cls),) for r in profile.empty_classes(_facts(spark), asked).collect()]


@query("SELECT o_orderpriority AS priority, CASE WHEN count(*) = 0 THEN '0' WHEN count(*) = 1 THEN '1' WHEN count(*) <= 10 THEN '2-10' WHEN count(*) <= 100 THEN '11-100' ELSE '>100' END AS n FROM orders GROUP BY o_orderpriority, o_orderstatus")
def profile_disclosed(spark, sf_dir):
    """Counts as bands, a local column and one without a class left out."""
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("note"))
    return profile.disclosed(counts, {"priority": "exact", "status": "local_only", "n": "bucketed"})


@cases("start string, goal string, path string", [("DepotShape", "TownShape", "DepotShape TownShape"), ("TownShape", "LabelShape", "TownShape LabelShape"), ("DepotShape", "LabelShape", "DepotShape TownShape LabelShape"), ("LabelShape", "TownShape", ""), ("DepotShape", "NoShape", ""), ("TownShape", "TownShape", "TownShape")])
def connecting_paths(spark):
    own = samples.catalog()
    pairs = [("DepotShape", "TownShape"), ("TownShape", "LabelShape"), ("DepotShape", "LabelShape"), ("LabelShape", "TownShape"), ("DepotShape", "NoShape"), ("TownShape", "TownShape")]
    return [(a, b, " ".join(map(short, retrieval.connecting_path(own, EX + a, EX + b)))) for a, b in pairs]


# Run reports


def _corpus(**change) -> dict:
    questions = [{"id": f"q-{n}", "scenario": "abc"[n % 3], "text": "what?", "status": "direct"} for n in range(21)]
    return {"frozen_at": "2026-01-01T00:00:00+00:00", "questions": questions} | change


@cases("corpus string, accepted boolean", [("good", True), ("zone as Z", True), ("time without zone", False), ("no time", False), ("too few questions", False), ("too many questions", False), ("one id twice", False), ("field too many", False), ("two scenarios", False), ("text is no text", False), ("unknown status", False), ("id with blanks", False)])
def corpus_checks(spark):
    q = _corpus()["questions"]
    made = {
        "good": {}, "zone as Z": {"frozen_at": "2026-01-01T00:00:00Z"}, "time without zone": {"frozen_at": "2026-01-01T00:00:00"}, "no time": {"frozen_at": "never"}, "too few questions": {"questions": q[:19]}, "too many questions": {"questions": [x | {"id": f"q-{n}"} for n, x in enumerate(q + q)]}, "one id twice": {"questions": q + q[:1]},
        "field too many": {"more": 1}, "two scenarios": {"questions": [x | {"scenario": "ab"[n % 2]} for n, x in enumerate(q)]}, "text is no text": {"questions": [x | {"text": 1} for x in q]}, "unknown status": {"questions": [x | {"status": "maybe"} for x in q]}, "id with blanks": {"questions": [q[0] | {"id": "q 0"}, *q[1:]]},
    }
    return [(k, accepted(lambda v=v: harness.validate_corpus(_corpus(**v)))) for k, v in made.items()]


@query("""SELECT o_orderpriority AS scenario, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) / count(*) AS direct, CAST(count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS DOUBLE) / count(*) AS combined,
median(CAST(o_custkey % 5 AS INTEGER)) AS median_overlays, max(CAST(o_custkey % 5 AS INTEGER)) AS most_overlays FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def early_gate(spark, sf_dir):
    """Coverage and burden by scenario and of all."""
    status = F.when(F.col("o_orderstatus") == "O", "direct").when(F.col("o_orderstatus") == "P", "overlay").otherwise("blocked")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("scenario"), status.alias("status"), (F.col("o_custkey") % 5).cast("int").alias("overlays"))
    return harness.early_gate(rows)


@cases("thresholds string, passes boolean", [("met", True), ("three scenarios", False), ("all direct", False), ("no overlays", False)])
def gate_passes(spark):
    q = spark.createDataFrame([("a", "direct", 0), ("a", "overlay", 1), ("b", "direct", 0), ("b", "direct", 1), ("c", "blocked", 4)], "scenario string, status string, overlays int")
    cover = harness.early_gate(q)
    return [(k, harness.gate_passes(cover, **v)) for k, v in {"met": {}, "three scenarios": {"scenarios": 3}, "all direct": {"direct": 1.0}, "no overlays": {"burden": 0.0}}.items()]


@cases("median_ratio double, ok boolean", [(1.0, True)])
def paired_ratio(spark):
    """Pairs without a duration to divide by count for nothing."""
    pairs = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (1.0, 1.0), (1.0, 0.0)], "a double, b double")
    return [tuple(r) for r in harness.paired_ratio(pairs, "a", "b").collect()]


_ATTEMPT = "run long, expected string, status string, correct boolean, critical boolean, covered boolean, valid boolean, calls long, seconds double, cost double, tokens long, flat_tokens long, direct_correct boolean, flat_status string, flat_correct boolean, direct_failure string, required_cards array<string>, candidate_cards array<string>, expected_entities array<string>, entities array<string>, expected_intents array<string>, intents array<string>"


def _attempts(spark) -> DataFrame:
    rows = [
        (1, "completed", "completed", True, True, True, True, 1, 1.0, 0.25, 10, 40, True, "completed", True, None, ["a", "b"], ["a"], ["e"], ["e"], ["i", "j"], ["i"]),
        (1, "completed", "unsupported", False, True, False, False, 2, 2.0, 0.5, 20, 40, False, "unsupported", False, "wrong_rows", ["a"], ["a"], ["e"], [], ["i"], []),
        (1, "completed", "completed", False, False, True, True, 1, 4.0, 0.25, 30, 40, None, "completed", False, None, ["c"], ["c", "d"], ["e", "f"], ["f"], ["i", "j"], ["j", "k", "l"]),
        (2, "unsupported", "unsupported", False, False, True, False, 3, 9.0, 0.25, 40, 40, True, "unsupported", False, None, [], [], [], [], [], []),
    ]
    return spark.createDataFrame(rows, _ATTEMPT)


_REPORT = "run long, n long, intent_extraction_recall double, intent_restriction_precision double, internal_coverage double, lens_retrieval_recall double, entity_accuracy double, plan_validity double, faithful_automation_coverage double, critical_faithful_coverage double, completed_plan_semantic_precision double, unsupported_precision double, unsupported_recall double, false_completion_count long, max_model_calls long, p50_latency_seconds double, p95_latency_seconds double, mean_cost_usd double, candidate_context_token_reduction double, direct_query_semantic_accuracy double"


@cases(_REPORT, [
    (None, 4, 0.5, 0.5, 0.75, 2 / 3, 0.5, 1.0, 1 / 3, 0.5, 0.5, 0.5, 1.0, 1, 3, 3.0, 9.0, 0.3125, 0.375, 2 / 3), (1, 3, 0.5, 0.5, 2 / 3, 2 / 3, 0.5, 1.0, 1 / 3, 0.5, 0.5, 0.0, None, 1, 2, 2.0, 4.0, 1 / 3, 0.5, 0.5),
    (2, 1, None, None, 1.0, None, None, None, None, None, None, 1.0, 1.0, 0, 3, 9.0, 9.0, 0.25, 0.0, 1.0),
])
def planner_metrics(spark):
    return [tuple(r) for r in harness.planner_report(_attempts(spark), ["run"]).collect()]


_PASS = ("plan_validity", "unsupported_recall", "mean_cost_usd", "max_model_calls")
_VALUE = {"intent_extraction_recall": 0.5, "intent_restriction_precision": 0.5, "internal_coverage": 0.75, "lens_retrieval_recall": 2 / 3, "entity_accuracy": 0.5, "plan_validity": 1.0, "faithful_automation_coverage": 1 / 3, "critical_faithful_coverage": 0.5, "completed_plan_semantic_precision": 0.5, "unsupported_precision": 0.5, "unsupported_recall": 1.0, "false_completion_count": 1.0, "max_model_calls": 3.0, "p95_latency_seconds": 9.0, "mean_cost_usd": 0.3125}


@cases("gate string, value double, ok boolean", [(g, v, g in _PASS) for g, v in _VALUE.items()])
def planner_gates(spark):
    report = harness.planner_report(_attempts(spark), ["run"]).filter("run IS NULL")
    limits = dict.fromkeys(harness.AT_LEAST, 0.9) | {"false_completion_count": 0, "max_model_calls": 3, "p95_latency_seconds": 5.0, "mean_cost_usd": 0.5}
    return [(r.gate, r.value, r.ok) for r in harness.planner_gates(report, limits).collect()]


@cases("failure string, n long", [("internal_coverage_rejected", 1), ("false_completion", 1), ("false_defer", 1), ("candidate_retrieval_miss", 1), ("model_call_limit", 1), ("attempt_over_latency_threshold", 1), ("flat_catalog_false_completion", 1), ("flat_catalog_false_defer", 1), ("direct_query_wrong_rows", 1), ("direct_query_pending_review", 1)])
def failure_categories(spark):
    return [tuple(r) for r in harness.failure_categories(_attempts(spark), 2, 5.0).collect()]


@cases("status string, n long", [("completed", 2), ("unsupported", 2)])
def failure_counts(spark):
    return [tuple(r) for r in harness.failure_counts(_attempts(spark), "status").collect()]


@query("SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 200")
def seeded_order(spark, sf_dir):
    """The first rows in an order that depends on seed and key, not on how rows lie."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"))
    return harness.seeded_order(rows, 7, "orderkey").limit(200)


@cases("fixture string, mode string, missing long, unexpected long, ok boolean", [(f, m, 0, 0, True) for f in ("class", "two classes of targets", "bound edge", "inverse edge", "value class", "enumeration", "equal literal", "equal lexical form", "equal node", "existence", "required field", "optional field", "branch", "cycle", "chain") for m in ("graph", "dataset")])
def conformance_matrix(spark):
    """Plans in both modes of the source, their rows against written ones as multisets."""
    number = lambda text: Term.literal(text, XSD + "integer")

    def cycle(b):
        e = b.entity(EX + "DepotShape")
        b.edge(b.lens(e, EX + "DepotShape"), EX + "feeds", e).node(e, "node")

    def chain(b):
        e, to, town = b.entity(EX + "MixedShape"), b.entity(), b.entity()
        b.edge(b.lens(e, EX + "DepotShape"), EX + "feeds", to).edge(b.lens(to, EX + "DepotShape"), EX + "in", town).node(e, "e").node(town, "t")

    plans = {
        "class": (samples.selected("DepotShape"), ["north", "south", "twin", "west"]), "two classes of targets": (samples.selected("MixedShape"), ["north", "west"]), "bound edge": (samples.linked("DepotShape", "in", "oslo"), ["north", "west"]), "inverse edge": (samples.linked("TownShape", "in", "south", inverse=True), ["rome"]),
        "value class": (samples.linked("DepotShape", "in"), ["north", "south", "west"]), "enumeration": (samples.linked("DepotShape", "state"), ["north", "west"]), "equal literal": (samples.equal("LabelShape", "label", Term.literal("Second")), ["twin"]), "equal lexical form": (samples.equal("LabelShape", "opened", number("02001")), ["south"]),
        "equal node": (samples.equal("DepotShape", "in", Term.iri(EX + "rome")), ["south"]), "existence": (samples.existing("LabelShape", "motto"), ["south"]), "required field": (samples.with_field("LabelShape", "opened"), ['"2001"^^<x:integer> north', '"02001"^^<x:integer> south']),
        "optional field": (samples.with_field("DepotShape", "state", required=False), ["Shut north", "- south", "- twin", "Open west"]), "branch": (samples.equal("TownShape", "size", Term.literal("vast"), 1), ["rome"]), "cycle": (cycle, ["west"]), "chain": (chain, ["north oslo", "west oslo"]),
    }
    own, actual, expected = samples.catalog(), [], []
    graph = "urn:g"
    modes = {"graph": samples.engine(spark), "dataset": samples.engine(spark, source=FactsTable(_facts(spark, graph=f"<{graph}>"), (graph,)), dataset=DatasetScope(graphs=(graph,)))}
    say = lambda t: "-" if t is None else short(t.value if t.kind == "iri" else t.token)
    for name, (fill, rows) in plans.items():
        expected += [(f"{name}/{m}", [r]) for m in modes for r in rows]
        for m, engine in modes.items():
            got = engine.execute_plan(samples.build(own, fill))
            actual += [(f"{name}/{m}", [" ".join(map(say, r.values))]) for r in getattr(got, "rows", ())]
    schema = "fixture string, values array<string>"
    matrix = harness.fixture_matrix(spark.createDataFrame(expected, schema), spark.createDataFrame(actual, schema))
    return [(*r.fixture.split("/"), r.missing, r.unexpected, r.ok) for r in matrix.collect()]  # a row for each fixture
