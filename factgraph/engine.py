"""The engine: raw plans in, typed outcomes with evidence out.

Planning is done on the driver without jobs. A result is one Spark job of at most
``max_result_rows`` + 1 sorted rows, which also says where contracts do not hold; its
witnesses are set-oriented jobs over those rows. Bad plans never raise: they become
outcomes. ``certify`` and ``faults`` do the same for whole results, as tables.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.errors import AuthorizationError, EvidenceError, PlanError, PolicyError, UnsupportedPlan
from factgraph.functions.terms import Term, sort_fields
from factgraph.operators import evidence
from factgraph.operators.evidence import Packet, ResultRow, certify, check_packet, make_row
from factgraph.plans.catalog import Catalog, CatalogLimits, Overlay, ShapeSource
from factgraph.plans.compiler import BAD, MANY, Compiled, compile_plan
from factgraph.plans.query import AuthorizationScope, DatasetScope, ExecutionRequest, Plan, QueryPolicy, authorize, canonical, normalize, validate
from factgraph.plans.text import query_text
from factgraph.sources.facts import FactsTable


#: What a field's value can break.
_BAD, _MANY = "a returned value is outside its contract", "a scalar field has several values"


@dataclass(frozen=True)
class Selected:
    rows: tuple[ResultRow, ...]
    packet: Packet
    kind: str = "selected"
    degraded: bool = False


@dataclass(frozen=True)
class BooleanResult:
    value: bool
    packet: Packet
    kind: str = "boolean"


@dataclass(frozen=True)
class NoMatch:
    message: str
    packet: Packet
    kind: str = "no_match"


@dataclass(frozen=True)
class PolicyLimited:
    reason: str
    kind: str = "policy_limited"


@dataclass(frozen=True)
class Unsupported:
    reason: str
    kind: str = "unsupported"


@dataclass(frozen=True)
class Failed:
    reason: str
    packet: Packet | None = None
    kind: str = "failed"


Outcome = Selected | BooleanResult | NoMatch | PolicyLimited | Unsupported | Failed


@dataclass(frozen=True)
class Explanation:
    plan: Plan
    plan_digest: str
    query_digest: str
    atoms: tuple[str, ...]
    columns: tuple[str, ...]
    text: str
    physical: str


class Engine:
    """Executes plans of one catalog over one source."""

    def __init__(self, spark: SparkSession, source, catalog: Catalog, authorization: AuthorizationScope, dataset: DatasetScope | None = None, policy: QueryPolicy | None = None):
        self.spark, self.source, self.catalog = spark, source, catalog
        self.authorization, self.dataset, self.policy = authorization, dataset or DatasetScope(), policy or QueryPolicy()
        if self.dataset.default_graph_mode != "store_default":
            raise PolicyError("other default graphs than the store's are not supported")

    @classmethod
    def from_facts(cls, facts: DataFrame, sources: list[ShapeSource], authorization: AuthorizationScope, dataset: DatasetScope | None = None, overlays: tuple[Overlay, ...] = (), policy: QueryPolicy | None = None, limits: CatalogLimits | None = None, build_id: str | None = None) -> "Engine":
        dataset = dataset or DatasetScope()
        catalog = Catalog.build(sources, overlays, build_id, limits)
        return cls(facts.sparkSession, FactsTable(facts, dataset.graphs), catalog, authorization, dataset, policy)

    def prepare(self, raw) -> Plan:
        """The canonical form of a raw plan; PlanError if it is not executable."""
        plan = normalize(raw, self.catalog, self.policy)
        validate(plan, self.catalog)
        authorize(plan, self.authorization, self.dataset)
        return canonical(plan)

    def validate_plan(self, raw) -> Plan:
        return self.prepare(raw)

    def compile(self, raw, limit: int | None = None) -> Compiled:
        """The lazy result of a plan: distinct rows of tokens, in the canonical order if limited."""
        if limit is not None and (type(limit) is not int or limit <= 0):
            raise PolicyError("a limit is a positive integer")
        c = compile_plan(self.spark, self.source, self.catalog, self.prepare(raw), self.policy)
        if limit is not None:
            c._plain.result = self.ordered(c, c.rows).limit(limit)
        return c

    @staticmethod
    def ordered(c: Compiled, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*(f for n in (*c.public, *c.entities) for f in sort_fields(F.col(n))))

    def certify(self, raw, execution_id: str) -> DataFrame:
        """The whole result of a plan as tokens, with row_key, certificate and supports of each row, and broken, the contracts that do not hold."""
        c = self.compile(raw)
        rows = evidence.certified(c.checked, self.source.as_tokens(), c, self.catalog, execution_id)
        return rows.select(*c.public, *c.entities, "row_key", "certificate", "supports", self.broken(c).alias("broken"))

    def faults(self, raw, execution_id: str, rows: DataFrame, certificates: DataFrame) -> DataFrame:
        """row_key, atom, fault of what does not hold in rows and certificates of a plan, from wherever they come."""
        return evidence.faults(rows, certificates, self.source.as_tokens(), self.compile(raw), self.catalog, execution_id)

    @staticmethod
    def broken(c: Compiled) -> Column:
        """Which returned values of a checked row are outside their contract or not the only one, as an array of texts."""
        fields = [p.id for p in c.plan.projections if p.kind == "field"]
        told = [F.when(F.col(f + p), F.lit(f"{p}: {text}")) for p in fields for f, text in ((BAD, _BAD), (MANY, _MANY))]
        return F.array_compact(F.array(*told)) if told else F.array().cast("array<string>")

    def explain_plan(self, raw, limit: int | None = None) -> Explanation:
        """What a plan means: its canonical form, its atoms, the query text over the engine's graphs (with the limit, if one is given), and Spark's plan."""
        c = self.compile(raw, limit)
        text = c.rows._jdf.queryExecution().simpleString()
        return Explanation(c.plan, c.plan.digest, c.query_digest, c.plan.atoms, (*c.public, *c.entities), query_text(c.plan, self.catalog, self.dataset.graphs, limit), text)

    def execute_plan(self, raw, request: ExecutionRequest | None = None, execution_id: str | None = None) -> Outcome:
        request = request or ExecutionRequest()
        if not isinstance(request, ExecutionRequest):
            return Unsupported("an execution request is typed")
        try:
            plan = self.prepare(raw)
            wanted = request.count if request.extent == "examples" else self.policy.max_result_rows
            if wanted > self.policy.max_result_rows:
                raise PolicyError("more examples than the policy allows")
        except (AuthorizationError, PolicyError) as e:
            return PolicyLimited(str(e))
        except PlanError as e:
            return Unsupported(str(e))
        if request.cancelled:
            return Failed("cancelled")
        execution_id = execution_id or uuid.uuid4().hex
        try:
            compiled = compile_plan(self.spark, self.source, self.catalog, plan, self.policy)
            _ = compiled.rows if plan.kind == "ask" else compiled.checked
        except PolicyError as e:
            return PolicyLimited(str(e))
        except Exception as e:  # a source that does not answer as it should
            return Failed(f"compile: {type(e).__name__}: {e}")
        try:
            return self.timed(lambda: self.outcome(compiled, request, execution_id, self.fetch(compiled, wanted), wanted))
        except TimeoutError:
            return Failed("deadline_exceeded", self.packet(compiled, request, execution_id, 0, None, False, completed=False))
        except (EvidenceError, PlanError) as e:
            return Failed(str(e), self.packet(compiled, request, execution_id, 0, None, False, completed=False))
        except Exception as e:
            return Failed(f"execution: {type(e).__name__}", self.packet(compiled, request, execution_id, 0, None, False, completed=False))

    def fetch(self, c: Compiled, wanted: int) -> list:
        """Rows of a checked result; BAD, MANY say which contracts do not hold."""
        return c.rows.limit(1).collect() if c.plan.kind == "ask" else self.ordered(c, c.checked).limit(wanted + 1).collect()

    def timed(self, work):
        """``work``'s result; its jobs are interrupted at the deadline."""
        tag, over = f"factgraph-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            over.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.policy.timeout_seconds, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            out = work()
        except Exception:
            if over.is_set():
                raise TimeoutError from None
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        if over.is_set():
            raise TimeoutError
        return out

    def outcome(self, c: Compiled, request: ExecutionRequest, execution: str, got: list, wanted: int) -> Outcome:
        if c.plan.kind == "ask":
            packet = self.packet(c, request, execution, 0, bool(got), False)
            self.verify(c, packet, ())
            return BooleanResult(True, packet) if got else NoMatch("no visible solution in this dataset and scope", packet)
        more = len(got) > wanted
        if more and request.extent == "complete":
            return PolicyLimited("more rows than the policy allows")
        got = got[:wanted]
        rows = tuple(make_row([r[n] for n in c.public], [(e, r[e]) for e in c.entities]) for r in got)
        size = len(json.dumps([[v and v.json() for v in r.values] for r in rows]))
        if size > self.policy.max_result_bytes:
            raise EvidenceError("result_byte_limit")
        for r in got:
            for p in (p.id for p in c.plan.projections if p.kind == "field"):
                if r[BAD + p] or r[MANY + p]:
                    raise EvidenceError(_BAD if r[BAD + p] else _MANY)
        certificates, witnesses = (), ()
        if rows:
            _, certificates, witnesses = certify(self.spark.createDataFrame(got, c.checked.schema).coalesce(1), self.source.as_tokens(), c, self.catalog, execution)
        packet = self.packet(c, request, execution, len(rows), None, more, witnesses=witnesses, certificates=certificates)
        self.verify(c, packet, rows)
        return Selected(rows, packet) if rows else NoMatch("no visible solution in this dataset and scope", packet)

    def packet(self, c: Compiled, request: ExecutionRequest, execution: str, count: int, boolean: bool | None, more: bool, completed: bool = True, **parts) -> Packet:
        state = "unknown" if not completed else "incomplete" if more else "complete"
        return Packet(execution, self.catalog.revision, self.policy.revision, self.authorization.digest, self.dataset.digest, c.plan.digest, request.digest, c.query_digest, c.plan.kind, count, boolean, more, completed, state, **parts).sealed()

    def verify(self, c: Compiled, packet: Packet, rows: tuple[ResultRow, ...]) -> None:
        """Check any packet of this engine's plans; EvidenceError if it does not hold."""
        expected = {"catalog_revision": self.catalog.revision, "policy_revision": self.policy.revision, "authorization_digest": self.authorization.digest, "dataset_digest": self.dataset.digest}
        check_packet(self.spark, self.source.as_tokens(), self.catalog, c, packet, rows, expected)


def render_result(outcome: Outcome) -> str:
    """Rows as tab-separated tokens, an empty field for an unbound one."""
    if isinstance(outcome, Selected):
        lines = ["\t".join("" if v is None else v.token for v in r.values) for r in outcome.rows]
        return "\n".join(lines + ["... more rows exist"] * outcome.packet.more)
    if isinstance(outcome, BooleanResult):
        return "true"
    if isinstance(outcome, NoMatch):
        return outcome.message
    return f"{outcome.kind}: {outcome.reason}"


__all__ = ["BooleanResult", "Engine", "Explanation", "Failed", "NoMatch", "Outcome", "PolicyLimited", "Selected", "Term", "Unsupported", "UnsupportedPlan", "render_result"]
