"""Terms and their tokens.

A term is an IRI or a literal. Its token is the canonical N-Triples spelling, and two
terms are the same exactly if their tokens are equal strings: lexical forms are never
cast or normalised. Tokens are what fact tables hold and joins compare; the struct
form only appears at the edges.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from factgraph.errors import PlanError

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SH = "http://www.w3.org/ns/shacl#"
TYPE = RDF + "type"
STRING, LANG_STRING = XSD + "string", RDF + "langString"

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_LANGUAGE = re.compile(r"[A-Za-z]+(-[A-Za-z0-9]+)*")
#: Characters, besides controls, blanks and surrogates, that no IRI may hold.
_BARRED = frozenset('<>"{}|^`\\')
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\f", "\\f"))
_PLAIN = {v: k for k, v in _ESCAPES}


def canonical_json(value: Any) -> str:
    """JSON with one spelling: sorted names, no blanks, plain ASCII."""
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


def digest(domain: str, value: Any) -> str:
    """SHA-256 of JSON data below a domain's name; the name's length keeps one from running into the other."""
    own = hashlib.sha256(f"{len(domain)}:{domain}:".encode())
    own.update(canonical_json(value).encode())
    return f"sha256:{own.hexdigest()}"


def check_iri(value: Any) -> str:
    """An absolute IRI, or PlanError."""
    head = _SCHEME.match(value) if isinstance(value, str) else None
    rest = value[head.end() :] if head else ""
    if not rest or any(c in _BARRED or c <= " " or "\ud800" <= c <= "\udfff" for c in rest):
        raise PlanError("absolute IRI required")
    return value


def check_language(value: str) -> str:
    """A language tag in lower case, or PlanError."""
    if not _LANGUAGE.fullmatch(value):
        raise PlanError("language tag required")
    return value.lower()


#: Fields of each kind of term besides its kind, and what makes their text valid; a literal has datatype or language.
_FORMS = {"iri": {"value": check_iri}, "literal": {"value": str, "datatype": check_iri, "language": check_language}}


@dataclass(frozen=True)
class Term:
    kind: str
    value: str
    datatype: str | None = None
    language: str | None = None

    @classmethod
    def iri(cls, value: str) -> "Term":
        return cls("iri", check_iri(value))

    @classmethod
    def literal(cls, value: str, datatype: str | None = None, language: str | None = None) -> "Term":
        return cls.load({"kind": "literal", "value": value, "datatype": datatype, "language": language})

    @classmethod
    def load(cls, raw: Any) -> "Term":
        """From its JSON form: the fields of its kind, those with null as if they were absent."""
        form = _FORMS.get(raw.get("kind")) if isinstance(raw, Mapping) and isinstance(raw.get("kind"), str) else None
        if form is None or not set(raw) <= {"kind", *_FORMS["literal"]}:
            raise PlanError("not the JSON form of an IRI or literal")
        given = {name: v for name, v in raw.items() if v is not None and name != "kind"}
        if "value" not in given or not all(name in form and isinstance(v, str) for name, v in given.items()) or len(given) > 2:
            raise PlanError(f"fields do not make up one {raw['kind']}")
        for name, v in given.items():
            given[name] = form[name](v)
        return cls(raw["kind"], **given)

    @classmethod
    def parse(cls, token: str) -> "Term":
        """From its token; blank nodes are no result terms."""
        if token.startswith("<") and token.endswith(">"):
            return cls("iri", token[1:-1])
        if not token.startswith('"'):
            raise PlanError("only IRIs and literals are result terms")
        end = token.rindex('"')
        text = re.sub(r"\\[\\\"tbnrf]", lambda m: _PLAIN[m[0]], token[1:end])
        tail = token[end + 1 :]
        if tail.startswith("^^<"):
            return cls("literal", text, tail[3:-1])
        return cls("literal", text, None, tail[1:] or None if tail.startswith("@") else None)

    @property
    def token(self) -> str:
        if self.kind == "iri":
            return f"<{self.value}>"
        text = self.value
        for plain, escaped in _ESCAPES:
            text = text.replace(plain, escaped)
        if self.language:
            return f'"{text}"@{self.language}'
        return f'"{text}"^^<{self.datatype}>' if self.datatype else f'"{text}"'

    @property
    def effective_datatype(self) -> str | None:
        if self.kind == "iri":
            return None
        return self.datatype or (LANG_STRING if self.language else STRING)

    @property
    def sort_key(self) -> tuple[str, str, str, str]:
        return self.kind, self.value, self.datatype or "", self.language or ""

    def json(self) -> dict:
        return {"kind": self.kind, "value": self.value, "datatype": self.datatype, "language": self.language}


def escape(text: Column) -> Column:
    """Text as it stands inside a literal's token."""
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def literal_token(text: Column, datatype: str | None = None) -> Column:
    tail = '"' if datatype is None else f'"^^<{datatype}>'
    return F.concat(F.lit('"'), escape(text.cast("string")), F.lit(tail))


def token_kind(token: Column) -> Column:
    return F.when(token.startswith("<"), "iri").when(token.startswith("_:"), "blank").otherwise("literal")


def token_datatype(token: Column) -> Column:
    """The datatype that is written, or null."""
    return F.nullif(F.regexp_extract(token, r'(?s)^".*"\^\^<([^<>"]*)>$', 1), F.lit(""))


def token_language(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1), F.lit(""))


def token_value(token: Column) -> Column:
    """Lexical form or IRI, without escapes."""
    inner = F.regexp_extract(token, r'(?s)^"(.*)"(?:\^\^<[^<>"]*>|@[A-Za-z0-9-]+)?$', 1)
    hidden = F.replace(inner, F.lit("\\\\"), F.lit("\x00"))
    for plain, escaped in _ESCAPES[1:]:
        hidden = F.replace(hidden, F.lit(escaped), F.lit(plain))
    return F.when(token.startswith("<"), F.regexp_extract(token, r"(?s)^<(.*)>$", 1)).otherwise(F.replace(hidden, F.lit("\x00"), F.lit("\\")))


def effective_datatype(token: Column) -> Column:
    return F.when(token_kind(token) == "literal", F.coalesce(token_datatype(token), F.when(token_language(token).isNotNull(), F.lit(LANG_STRING)), F.lit(STRING)))


def sort_fields(token: Column) -> list[Column]:
    """The four strings by which results are ordered; unbound values come first."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return [empty(F.when(token.isNotNull(), token_kind(token))), empty(token_value(token)), empty(token_datatype(token)), empty(token_language(token))]


def kind_allowed(token: Column, kinds: tuple[str, ...]) -> Column:
    """Whether a token meets every listed node kind."""
    iri = token_kind(token) == "iri"
    meets = {"IRI": iri, "Literal": ~iri, "BlankNodeOrIRI": iri, "IRIOrLiteral": F.lit(True), "BlankNodeOrLiteral": ~iri}
    out = F.lit(True)
    for k in kinds:
        out = out & meets[k]
    return out


def normal_label(text: Column) -> Column:
    """Lower-cased words joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")


def valid_iri(text: Column) -> Column:
    """check_iri() as a column: whether the text is an absolute IRI."""
    barred = "".join("\\" + c for c in sorted(_BARRED))
    return F.coalesce(F.regexp_like(text, F.lit(rf"^{_SCHEME.pattern}[^\x00-\x20{barred}]+\z")), F.lit(False))


def valid_language(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(rf"^{_LANGUAGE.pattern}\z")), F.lit(False))


def domain_digest(domain: str, json_text: Column) -> Column:
    """digest() as a column, of canonical JSON text."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"{len(domain)}:{domain}:"), json_text).cast("binary"), 256))


# The same as SQL text, for expressions that are put together from many parts.


def sql_text(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ascii_sql(x: str) -> str:
    """Text with everything but printable ASCII as JSON escapes, by UTF-16 units."""
    unit = "if(u >= '0020' AND u <= '007E', char(CAST(conv(u, 16, 10) AS INT)), concat(char(92), 'u', lower(u)))"
    spelled = f"array_join(transform(regexp_extract_all(hex(encode(y, 'UTF-16BE')), '(....)', 1), u -> {unit}), '')"
    return f"transform(array({x}), y -> if(y RLIKE '[^ -~]', {spelled}, y))[0]"


def json_sql(x: str) -> str:
    """canonical_json() of a string; null for null. The named escapes of JSON are those of tokens."""
    for plain, escaped in _ESCAPES:
        x = f"replace({x}, {sql_text(plain)}, {sql_text(escaped)})"
    return f"concat('\"', {_ascii_sql(x)}, '\"')"


def term_json_sql(token: str, quoted: str) -> str:
    """canonical_json() of Term.json(), from a token and json_sql() of it; null for null."""
    part = lambda p: f"regexp_extract({token}, {sql_text(p)}, 1)"
    value, kind, tag = part(r'(?s)^"(.*)"(?:\^\^<[^<>"]*>|@[A-Za-z0-9-]+)?\z'), part(r'(?s)^".*"\^\^<([^<>"]*)>\z'), part(r'(?s)^".*"@([A-Za-z0-9-]+)\z')
    named = lambda x: f"if({x} = '', 'null', concat('\"', {_ascii_sql(x)}, '\"'))"
    iri = f"""concat('{{"datatype":null,"kind":"iri","language":null,"value":"', substr({quoted}, 3, length({quoted}) - 4), '"}}')"""
    literal = f"""concat('{{"datatype":', {named(kind)}, ',"kind":"literal","language":', {named(tag)}, ',"value":"', {_ascii_sql(value)}, '"}}')"""
    return f"CASE WHEN startswith({token}, '<') THEN {iri} WHEN {token} IS NOT NULL THEN {literal} END"


def digest_sql(domain: str, json_text: str) -> str:
    """digest() of canonical JSON text."""
    return f"concat('sha256:', sha2(concat('{len(domain)}:{domain}:', {json_text}), 256))"
