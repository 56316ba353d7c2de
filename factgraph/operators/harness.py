"""Question corpora, fixture matrices and run reports, over tables of results."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.errors import CatalogError
from factgraph.functions.terms import digest
from factgraph.operators.metrics import nearest_rank, ratio


def write_new_json(path: str, value: Any) -> None:
    """JSON into a file that must not exist yet."""
    with Path(path).open("x", encoding="utf-8") as out:
        json.dump(value, out, indent=2, sort_keys=True)


def validate_corpus(corpus: Mapping[str, Any]) -> str:
    """Check a frozen question corpus; its revision. Fields: frozen_at, questions of id, scenario, text and status."""

    def need(ok, what: str) -> None:
        if not ok:
            raise CatalogError(what)

    need(set(corpus) == {"frozen_at", "questions"} and isinstance(corpus["questions"], list), "a corpus has frozen_at and questions")
    try:
        need(isinstance(corpus["frozen_at"], str) and datetime.fromisoformat(corpus["frozen_at"]).tzinfo is not None, "frozen_at needs a zone")
    except ValueError as e:
        raise CatalogError("frozen_at is no time") from e
    questions = corpus["questions"]
    need(20 <= len(questions) <= 30, "a corpus has 20 to 30 questions")
    for q in questions:
        need(isinstance(q, Mapping) and set(q) == {"id", "scenario", "text", "status"} and all(isinstance(v, str) and v.strip() for v in q.values()), "a question has id, scenario, text and status")
        need(re.fullmatch(r"[a-z][a-z0-9-]*", q["id"]) and q["status"] in ("direct", "overlay", "blocked"), "question id or status")
    need(len({q["id"] for q in questions}) == len(questions), "question ids repeat")
    need(len({q["scenario"] for q in questions}) >= 3, "a corpus has 3 scenarios at least")
    return digest("corpus", corpus)


def early_gate(questions: DataFrame) -> DataFrame:
    """Coverage of each scenario and, with scenario null, of all: questions answered directly, and with overlays.

    ``questions``: scenario, status (direct, overlay, blocked), overlays.
    """
    direct, either = F.col("status") == "direct", F.col("status").isin("direct", "overlay")
    return questions.groupingSets([[F.col("scenario")], []], "scenario").agg(
        F.count("*").alias("n"), ratio(direct).alias("direct"), ratio(either).alias("combined"), F.median("overlays").alias("median_overlays"), F.max("overlays").alias("most_overlays")
    )


def gate_passes(coverage: DataFrame, direct: float = 0.5, combined: float = 0.7, scenarios: int = 2, burden: float = 1.0) -> bool:
    """Whether an early_gate() table meets its thresholds."""
    rows = coverage.collect()  # a row for each scenario
    whole = next(r for r in rows if r.scenario is None)
    enough = sum(r.combined >= combined for r in rows if r.scenario is not None)
    return whole.direct >= direct and enough >= scenarios and whole.median_overlays <= burden


def fixture_matrix(expected: DataFrame, actual: DataFrame, fixture: str = "fixture") -> DataFrame:
    """fixture, missing, unexpected and ok: rows of each fixture compared as multisets.

    Both tables have the fixture's name, and one ``values`` array for each row.
    """
    signed = lambda df, n: df.select(fixture, "values", F.lit(n).cast("long").alias("_n"))
    gaps = signed(expected, 1).unionByName(signed(actual, -1)).groupBy(fixture, "values").agg(F.sum("_n").alias("_gap"))
    gap = F.col("_gap")
    return gaps.groupBy(fixture).agg(F.sum(F.greatest(gap, F.lit(0))).alias("missing"), F.sum(F.greatest(-gap, F.lit(0))).alias("unexpected"), F.bool_and(gap == 0).alias("ok"))


def paired_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Median of a / b over pairs, and whether a is no slower."""
    return pairs.agg(F.median(F.try_divide(F.col(a), F.col(b))).alias("median_ratio")).withColumn("ok", F.col("median_ratio") <= 1)


def planner_report(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of planning attempts, over all and for each value of each column in ``by``.

    ``attempts``: expected and status (completed, unsupported, ...), correct, critical,
    covered and valid (booleans), calls, seconds, cost, tokens and flat_tokens (numbers),
    direct_correct (null: not reviewed), and the arrays required_cards, candidate_cards,
    expected_entities, entities, expected_intents, intents. Intents and entities are
    compared as multisets, cards as sets. Shares over nothing are null.
    """
    done, refused = F.col("status") == "completed", F.col("status") == "unsupported"
    wanted, unwanted = F.col("expected") == "completed", F.col("expected") == "unsupported"
    flag = lambda c: F.when(c, 1).otherwise(0)
    share = lambda n, d: F.try_divide(F.sum(n).cast("double"), F.sum(d).cast("double"))
    of = lambda n, d: share(flag(n & d), flag(d))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    common = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    over = lambda c, size: F.when(c, size).otherwise(0)
    return attempts.groupingSets([[], *([F.col(c)] for c in by)], *by).agg(
        F.count("*").alias("n"),
        share(over(done, common("expected_intents", "intents")), over(done, F.size("expected_intents"))).alias("intent_extraction_recall"),
        share(over(done, common("expected_intents", "intents")), over(done, F.size("intents"))).alias("intent_restriction_precision"),
        share(flag(F.col("covered")), F.lit(1)).alias("internal_coverage"),
        share(over(done, both("required_cards", "candidate_cards")), over(done, F.size("required_cards"))).alias("lens_retrieval_recall"),
        share(common("expected_entities", "entities"), F.size("expected_entities")).alias("entity_accuracy"),
        of(F.col("valid"), done).alias("plan_validity"),
        of(F.col("correct"), wanted).alias("faithful_automation_coverage"),
        of(F.col("correct"), wanted & F.col("critical")).alias("critical_faithful_coverage"),
        of(F.col("correct"), done).alias("completed_plan_semantic_precision"),
        of(unwanted, refused).alias("unsupported_precision"),
        of(refused, unwanted).alias("unsupported_recall"),
        F.sum(flag(done & (~wanted | ~F.col("correct")))).alias("false_completion_count"),
        F.max("calls").alias("max_model_calls"),
        F.median("seconds").alias("p50_latency_seconds"),
        nearest_rank("seconds", 0.95).alias("p95_latency_seconds"),
        F.avg("cost").alias("mean_cost_usd"),
        (1 - F.try_divide(F.sum("tokens").cast("double"), F.sum("flat_tokens").cast("double"))).alias("candidate_context_token_reduction"),
        F.try_divide(F.sum(flag(F.col("direct_correct"))).cast("double"), F.count("direct_correct").cast("double")).alias("direct_query_semantic_accuracy"),
    )


#: Metrics that must reach their threshold, and those that must not pass it.
AT_LEAST = ("intent_extraction_recall", "intent_restriction_precision", "internal_coverage", "lens_retrieval_recall", "entity_accuracy", "plan_validity", "faithful_automation_coverage", "critical_faithful_coverage", "completed_plan_semantic_precision", "unsupported_precision", "unsupported_recall")
AT_MOST = ("false_completion_count", "max_model_calls", "p95_latency_seconds", "mean_cost_usd")


def planner_gates(report: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """gate, value, threshold and ok for each gate of each row of a planner_report(); a metric over nothing fails."""
    each = [(n, F.col(n) >= thresholds[n]) for n in AT_LEAST] + [(n, F.col(n) <= thresholds[n]) for n in AT_MOST]
    gates = F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(float(thresholds[n])).alias("threshold"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in each))
    by = [c for c in report.columns if c not in {"n", "p50_latency_seconds", "candidate_context_token_reduction", "direct_query_semantic_accuracy", *AT_LEAST, *AT_MOST}]
    return report.select(*by, F.explode(gates).alias("g")).select(*by, "g.*")


def failure_categories(attempts: DataFrame, max_model_calls: int, p95_latency_seconds: float) -> DataFrame:
    """How many attempts fell into each category of failure; an attempt may fall into several.

    ``attempts`` as in planner_report(), with flat_status and flat_correct of the planner
    that was given the whole catalog, and direct_failure, what a wrong direct query did wrong.
    """
    done, wanted, correct = F.col("status") == "completed", F.col("expected") == "completed", F.coalesce("correct", F.lit(False))
    flat_done, flat_correct = F.coalesce(F.col("flat_status") == "completed", F.lit(False)), F.coalesce("flat_correct", F.lit(False))
    missed = F.size(F.array_except("required_cards", "candidate_cards")) > 0
    kinds = {
        "internal_coverage_rejected": ~F.col("covered"),
        "false_completion": done & ~correct,
        "false_defer": wanted & ~done,
        "wrong_disposition": ~(done & ~correct) & ~wanted & (F.col("status") != F.col("expected")),
        "candidate_retrieval_miss": missed,
        "model_call_limit": F.col("calls") > max_model_calls,
        "attempt_over_latency_threshold": F.col("seconds") > p95_latency_seconds,
        "flat_catalog_false_completion": flat_done & ~flat_correct,
        "flat_catalog_false_defer": wanted & ~flat_done,
        "direct_query_pending_review": F.col("direct_correct").isNull(),
    }
    direct = F.when(~F.col("direct_correct"), F.concat(F.lit("direct_query_"), F.coalesce(F.nullif("direct_failure", F.lit("")), F.lit("semantic_failure"))))
    met = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in kinds.items()), direct))
    return attempts.select(F.explode(met).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


def failure_counts(attempts: DataFrame, column: str = "failure") -> DataFrame:
    return attempts.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def seeded_order(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """``rows`` in an order that depends on seed and key only, the digests of both; repeated keys stay together."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
