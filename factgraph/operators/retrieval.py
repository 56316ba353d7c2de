"""From questions to plans, without a model: cards, ranking, entity resolution, coverage, templates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.errors import PlanError
from factgraph.functions.terms import Term, normal_label
from factgraph.plans.catalog import Catalog

#: Words that say nothing about a card (fixed values).
STOPWORDS = (
    "and", "are", "both", "during", "for", "from", "has", "have", "how", "into", "our", "still", "that", "the", "their", "them", "they", "this",
    "what", "when", "where", "which", "who", "with",
)


def words(text: Column) -> Column:
    """Distinct words of more than two letters that are no stopwords."""
    every = F.array_distinct(F.split(normal_label(text), " "))
    return F.filter(every, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def overlap(question: Column, card: Column) -> Column:
    return F.size(F.array_intersect(words(question), words(card)))


def approved_cards(catalog: Catalog, notes: DataFrame) -> DataFrame:
    """Cards of trusted, reviewed catalog items that have an approved note.

    ``notes``: kind, shape, predicate, inverse, label, aliases, description, provider_allowed.
    """
    spark = notes.sparkSession
    shape = {x.key: x.shape[1:-1] for x in catalog.lenses}
    rows = [("lens", x.key, x.shape[1:-1], None, False, x.key) for x in catalog.lenses if x.trusted]
    rows += [("selector", x.key, shape[x.lens], None, False, x.lens) for x in catalog.selectors if x.trusted and x.qualified]
    rows += [("property", x.key, shape[x.lens], x.predicate, x.inverse, x.lens) for x in catalog.properties if x.trusted and x.qualified]
    items = spark.createDataFrame(rows, "kind string, key string, shape string, predicate string, inverse boolean, lens string")
    noted = notes.filter("provider_allowed").withColumn("inverse", F.coalesce("inverse", F.lit(False)))
    joined = items.alias("i").join(F.broadcast(noted).alias("n"), (F.col("i.kind") == F.col("n.kind")) & (F.col("i.shape") == F.col("n.shape")) & F.col("i.predicate").eqNullSafe(F.col("n.predicate")) & (F.col("i.inverse") == F.col("n.inverse")))
    return joined.select("i.kind", "i.key", "i.lens", "i.shape", "n.label", "n.aliases", "n.description").orderBy("kind", "key")


def rank_cards(cards: DataFrame, question: Column, limit: int = 24, group: str = "lens", text: str = "text", key: str = "key") -> DataFrame:
    """The best cards: groups by their summed score, cards of a group by their own, ties by name; those of no score come last."""
    scored = cards.withColumn("score", overlap(question, F.col(text)).cast("long"))
    scored = scored.withColumn("group_score", F.sum("score").over(Window.partitionBy(group)))
    order = [F.col("group_score").desc(), F.col(group), F.col("score").desc(), F.col(key)]
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))  # at most ``limit`` rows


def label_signature(text: Column) -> Column:
    """Labels are alike if their letters and digits are: lower case, one blank for whatever else lies between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def resolve_entities(mentions: DataFrame, labels: DataFrame, of_type: DataFrame | None = None) -> DataFrame:
    """mention, status (resolved, ambiguous, unsupported) and iri of each mention.

    ``labels`` has iri and an array of names; names match by their words, exactly. A
    mention that is an IRI in angle brackets stands for itself if a label has it. With
    ``of_type`` (iri) only its nodes are meant.
    """
    if of_type is not None:
        labels = labels.join(of_type.select("iri"), "iri", "left_semi")
    labels = labels.withColumn("names", F.concat("names", F.array(F.concat(F.lit("<"), F.regexp_replace("iri", "^<|>$", ""), F.lit(">")))))
    names = labels.select("iri", F.explode("names").alias("name")).select("iri", normal_label(F.col("name")).alias("_n")).filter("_n <> ''").distinct()
    asked = mentions.select("mention").distinct().withColumn("_n", normal_label(F.col("mention")))
    found = asked.join(names, "_n", "left").groupBy("mention").agg(F.count("iri").alias("n"), F.min("iri").alias("one"))
    status = F.when(F.col("n") == 0, "unsupported").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return found.select("mention", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("iri"))


#: The kind of intent that an atom of each part can serve.
INTENT_OF = {"selectors": "population", "edges": "relation", "filters": "restriction", "projections": "output"}


def check_coverage(intents: list[Mapping[str, Any]], raw: Mapping[str, Any]) -> None:
    """Every intent names one plan atom, every atom serves one intent, of its kind where the intent says one."""
    kind = {x["id"]: INTENT_OF[part] for part in INTENT_OF for x in raw.get(part, ())}
    if any(i.get("kind") is not None and i["kind"] != kind.get(i.get("atom")) for i in intents):
        raise PlanError("an intent of another kind than its atom")
    atoms = Counter(x["id"] for part in ("selectors", "edges", "filters", "projections") for x in raw.get(part, ()))
    served = Counter(a for i in intents for a in ([i.get("atom")] if isinstance(i.get("atom"), str) else []))
    if len(served) != len(intents) or served != atoms:
        raise PlanError("intents and plan atoms do not match one to one")


def check_spans(question: str, mentions: Mapping[str, tuple[int, int, str]]) -> None:
    """Every mention is the text of its own span of the question, whole words of it, and no two overlap."""
    last = 0
    for start, end, text in sorted(mentions.values()):
        if not (last <= start < end <= len(question)) or question[start:end] != text or text != text.strip():
            raise PlanError(f"no span of the question: {text!r}")
        if (start and question[start - 1].isalnum() and text[0].isalnum()) or (end < len(question) and question[end].isalnum() and text[-1].isalnum()):
            raise PlanError(f"a part of a word: {text!r}")
        last = end


def lexical_index(cards: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """word, key, weight: the words of each card, weighted by the fields that hold them (a field may be an array)."""
    kind = dict(cards.dtypes)
    text = lambda f: F.array_join(f, " ") if kind[f].startswith("array") else F.col(f)
    parts = [cards.select("key", F.explode(words(F.coalesce(text(f), F.lit("")))).alias("word"), F.lit(float(w)).alias("w")) for f, w in weights.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("word", "key").agg(F.sum("w").alias("weight"))


def search_index(index: DataFrame, question: str, k: int) -> DataFrame:
    """key, score and position of the ``k`` best cards for a question."""
    asked = index.sparkSession.range(1).select(F.explode(words(F.lit(question))).alias("word"))
    scored = index.join(F.broadcast(asked), "word").groupBy("key").agg(F.sum("weight").alias("score"))
    order = [F.col("score").desc(), F.col("key")]
    return scored.orderBy(*order).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))  # k rows


def suggest(vectors: DataFrame, like: Column, confirmed: DataFrame, k: int, key: str = "key", vector: str = "vector") -> DataFrame:
    """The ``k`` rows nearest to ``like`` by cosine, of those that a plan's result (``confirmed``) holds: a suggestion is never an answer by itself."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.try_divide(dot(F.col(vector), like), F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(like, like)))
    own = vectors.join(confirmed.select(key), key, "left_semi").select(key, score.alias("score")).filter("score IS NOT NULL")
    return own.orderBy(F.col("score").desc(), key).limit(k)


def handles(keys: list[tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """Short names for (kind, key) pairs, and the way back."""
    letters, counts, short = {"lens": "L", "selector": "S", "property": "P", "branch": "B"}, Counter(), {}
    for kind, key in keys:
        short[key] = f"{letters[kind]}{counts[kind]}"
        counts[kind] += 1
    return short, {v: k for k, v in short.items()}


def map_strings(value: Any, change: Callable[[str], str]) -> Any:
    if isinstance(value, str):
        return change(value)
    if isinstance(value, Mapping):
        return {k: map_strings(v, change) for k, v in value.items()}
    return [map_strings(v, change) for v in value] if isinstance(value, (list, tuple)) else value


@dataclass(frozen=True)
class Slot:
    """A place of a template: ``path`` into the raw plan; entity, literal or enum values."""

    name: str
    kind: str
    path: tuple[str | int, ...]
    options: Mapping[str, Term] | None = None
    datatype: str | None = None


def instantiate(template: Mapping[str, Any], slots: list[Slot], values: Mapping[str, str]) -> dict:
    """A reviewed plan with its declared slots filled; nothing else changes."""
    if set(values) != {s.name for s in slots}:
        raise PlanError("values and slots do not match")
    raw = map_strings(template, str)
    for s in slots:
        text = values[s.name]
        if s.kind == "enum":
            if text not in (s.options or {}):
                raise PlanError(f"{s.name} is no option")
            term = s.options[text]
        else:
            term = Term.iri(text) if s.kind == "entity" else Term.literal(text, s.datatype)
        at = raw
        for step in s.path[:-1]:
            at = at[step]
        if s.path[-1] not in (at if isinstance(at, dict) else range(len(at))):
            raise PlanError(f"{s.name} has no place in the template")
        at[s.path[-1]] = term.json()
    return raw


Planner = Callable[[str, list[Mapping[str, Any]]], Mapping[str, Any]]


@dataclass(frozen=True)
class Answer:
    status: str
    reason: str = ""
    outcome: Any = None


def ask(engine, planner: Planner, question: str, cards: list[Mapping[str, Any]], resolve: Callable[[str], tuple[str, str | None]], calls: int = 2) -> Answer:
    """Let ``planner`` propose a plan within ``cards``; at most ``calls`` proposals, then unsupported.

    A proposal has intents, mentions (entity id -> text) and plan. Mentions are bound here,
    by exact resolution, never by the planner.
    """
    allowed, reason = {c["key"] for c in cards}, "no proposal"
    for _ in range(calls):
        try:
            got = planner(question, cards)
            if not isinstance(got, Mapping) or set(got) != {"intents", "mentions", "plan"}:
                raise PlanError("a proposal has intents, mentions and plan")
            raw = map_strings(got["plan"], str)
            keys = {x[k] for part in ("selectors", "lenses", "edges", "filters", "projections") for x in raw.get(part, ()) for k in ("key", "property_key") if k in x}
            if not keys <= allowed:
                raise PlanError("plan leaves its cards")
            check_coverage(got["intents"], raw)
            for e in raw.get("entities", ()):
                if e.get("binding") is not None:
                    raise PlanError("entities are bound by mention only")
                if e["id"] in got["mentions"]:
                    status, iri = resolve(got["mentions"][e["id"]])
                    if status != "resolved":
                        return Answer(status, got["mentions"][e["id"]])
                    e["binding"] = Term.iri(iri).json()
            engine.validate_plan(raw)
            return Answer("completed", outcome=engine.execute_plan(raw))
        except (PlanError, KeyError, TypeError, AttributeError) as e:
            reason = str(e)
    return Answer("unsupported", reason)


def connecting_path(catalog: Catalog, start: str, goal: str, most: int = 4) -> list[str]:
    """Shapes on a shortest way between two shapes through value classes; empty if there is none."""
    lens_of = {c: s.lens for s in catalog.selectors for c in s.classes}
    links: dict[str, set[str]] = {}
    for p in catalog.properties:
        for b in p.branches:
            for c in b.classes:
                if c in lens_of:
                    links.setdefault(p.lens, set()).add(lens_of[c])
    shape = {x.key: x.shape[1:-1] for x in catalog.lenses}
    a, z = (next((k for k, v in shape.items() if v == s), None) for s in (start, goal))
    ways, seen = [[a]], {a}
    while ways and a and z:
        way = ways.pop(0)
        if way[-1] == z:
            return [shape[k] for k in way]
        if len(way) <= most:
            for k in sorted(links.get(way[-1], set()) - seen):
                seen.add(k)
                ways.append([*way, k])
    return []
