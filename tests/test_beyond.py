"""Paths, absence, counts, exact selection, ranked search and live certificates against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from graphs import EVERYONE, Builder, catalog, facts
from pyspark.sql import functions as F

from factgraph.engine import Engine
from factgraph.errors import UnsupportedPlan
from factgraph.operators import closed, metrics, paths, search
from factgraph.plans.query import DatasetScope, QueryPolicy
from factgraph.sources.facts import FactsTable
from factgraph.sources.shared import shared_folder, stored
from factgraph.streaming.certificates import LiveCertificates

LOOSE = QueryPolicy(timeout_seconds=120)


def steps_from(edges, start, most):
    found, front = {start: 0}, [start]
    for k in range(1, most + 1):
        front = [o for n in front for s, o in edges if s == n and o not in found and not found.update({o: k})]
    return found


def test_reachable_nodes_and_their_paths(spark):
    r = random.Random(1)
    edges = sorted({(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(70)}) + [("n0", "n0")]  # cycles and a loop
    table = stored(spark.createDataFrame([(s, f"p{(int(s[1:]) + int(o[1:])) % 2}", o) for s, o in edges] + [("n1", None, None), (None, "p", "n2")], "s string, p string, o string"), "edges")
    starts = spark.createDataFrame([("n0",), ("n5",), ("n5",), ("lost",), (None,)], "node string")
    for most in (1, 3, 50):
        reached = paths.reachable(table, starts, most)
        got = {(x.start, x.node): x.steps for x in reached.collect()}
        assert got == {(s, n): k for s in ("n0", "n5", "lost") for n, k in steps_from(edges, s, most).items()}
    own = paths.witness_paths(reached)
    known = {(x.s, x.p, x.o) for x in table.collect()}
    for x in own.collect():
        assert len(x.path) == x.steps and all(tuple(h) in known for h in x.path)
        assert [h.s for h in x.path] == [x.start, *(h.o for h in x.path)][: len(x.path)] and (not x.path or x.path[-1].o == x.node)
    assert paths.path_faults(own, table).count() == 0
    short = own.withColumn("path", F.when(F.col("steps") > 1, F.slice("path", 1, 1)).otherwise(F.col("path")))
    assert {x.fault for x in paths.path_faults(short, table).collect()} == {"length", "ends"}
    assert paths.reachable(table.limit(0), starts.limit(0), 5).count() == 0


def test_absence_is_stated_and_checked(spark):
    people = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, None)], "k long")
    orders = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "k long")
    assert {x.k for x in closed.absent(people, orders, "k").collect()} == {2, 4}
    statement = stored(closed.absence_statement(people, orders, "k"), "statement")
    assert {x.what: x.n for x in statement.collect()} == {"population": 4, "facts": 4, "present": 2, "absent": 2}
    assert closed.statement_faults(statement, people.repartition(3), orders, "k").count() == 0
    swapped = spark.createDataFrame([(2,), (3,), (9,), (None,)], "k long")  # as many as before, but others
    assert {x.what for x in closed.statement_faults(statement, people, swapped, "k").collect()} == {"facts", "present", "absent"}
    odd = statement.withColumn("n", F.when(F.col("what") == "absent", 1).otherwise(F.col("n")))
    assert {x.what for x in closed.statement_faults(odd, people, orders, "k").collect()} == {"absent", "sum"}


def test_counts_add_up_and_changes_are_found(spark):
    rows = stored(spark.createDataFrame([("a", k % 50) for k in range(200)] + [("b", k) for k in range(7)] + [(None, 1), ("c", None)], "g string, v int"), "rows")
    evidence = stored(closed.counted(rows, "g", "v", 4), "counts")
    sums = {x.g: x.n for x in evidence.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    assert sums == {"a": 50, "b": 7, None: 1}
    claims = spark.createDataFrame([("a", 50), ("b", 7), (None, 1)], "g string, n long")
    assert closed.count_faults(claims, evidence, rows, "g", "v", 4).count() == 0
    fewer = rows.filter("NOT (g = 'b' AND v = 3)")
    (one,) = closed.count_faults(claims, evidence, fewer, "g", "v", 4).collect()
    assert (one.g, one.fault) == ("b", "changed")
    wrong = claims.withColumn("n", F.when(F.col("g") == "a", 51).otherwise(F.col("n")))
    assert [(x.g, x.fault) for x in closed.count_faults(wrong, evidence, rows, "g", "v", 4).collect()] == [("a", "count")]


@pytest.mark.parametrize("most", [10, 100_000])
def test_values_at_ranks_in_several_passes(spark, most):
    r = random.Random(8)
    values = {"wide": [r.lognormvariate(0, 9) for _ in range(3000)], "few": [float(r.randrange(3)) for _ in range(2000)], "hot": [5.0] * 1500 + [r.random() * 10 for _ in range(500)], "one": [2.5], None: [-1.0, -math.inf, 7.0]}
    rows = stored(spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("none", None)], "g string, v double").repartition(4), "values")
    shares = (0.0, 0.01, 0.5, 0.95, 1.0)
    got = metrics.nth_values(rows, ["g"], "v", {str(s): metrics.share_rank(s) for s in shares}, most)
    assert {(x.g, x.name): x.nth for x in got.collect()} == {(g, str(s)): sorted(vs)[max(math.ceil(s * len(vs)), 1) - 1] for g, vs in values.items() for s in shares}
    assert got.count() == len(values) * len(shares)


def test_ranked_search(spark):
    r = random.Random(2)
    docs = [(k, " ".join(r.choice(["ant", "bee", "cat", "dog", "É", "elk"]) for _ in range(r.randint(0, 12))) or None) for k in range(60)]
    allowed = {k for k, _ in docs if k % 3}
    questions = [(0, "Cat, cat and DOG?"), (1, "é"), (2, "unknown words"), (3, None), (4, "")]
    index = search.postings(spark.createDataFrame(docs, "k long, text string"), "k", "text", spark.createDataFrame([(k,) for k in allowed] + [(1,)], "k long"))
    held = {k: re.findall(r"\w+", (t or "").lower()) for k, t in docs if k in allowed}
    held = {k: w for k, w in held.items() if w}
    mean = sum(map(len, held.values())) / len(held)
    want = []
    for q, text in questions:
        scores = Counter()
        for w in set(re.findall(r"\w+", (text or "").lower())):
            df = sum(w in ws for ws in held.values())
            for k, ws in held.items():
                if w in ws:
                    tf = ws.count(w)
                    scores[k] += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        best = sorted(((-round(s, 6), k) for k, s in scores.items()))[:5]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    got = search.bm25(index, spark.createDataFrame(questions, "question long, text string"), 5)
    assert sorted((x.question, x.position, x.id, x.score) for x in got.collect()) == sorted(want)
    vectors = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(40)] + [(90, None), (91, [0.0] * 4), (92, [math.nan] * 4), (93, [None, 1.0, 1.0, 1.0])]
    near = search.nearest(spark.createDataFrame(vectors, "id long, v array<double>"), spark.createDataFrame([(7, vectors[3][1]), (8, None)], "question long, v array<double>"), 3)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    best = sorted((-round(cosine(vectors[3][1], v), 6), k) for k, v in vectors[:40])[:3]
    assert [(x.question, x.id, -x.score) for x in near.orderBy("position").collect()] == [(7, k, s) for s, k in best]
    both = search.fused([got, near.withColumn("question", F.lit(0).cast("long"))], 2).filter("question = 0").collect()
    assert len(both) == 2 and both[0].score >= both[1].score


def test_live_certificates_equal_those_from_scratch(spark, tmp_path):
    cat, whole = catalog(), facts(spark).cache()
    engine = Engine(spark, FactsTable(whole), cat, EVERYONE, DatasetScope(), LOOSE)
    b = Builder(cat)
    who, job = b.entity(), b.entity()
    w = b.lens(who, "WorkShape")
    raw = b.select(who, "WorkShape").edge(w, "on", job).exists(w, "can").node(who).field(b.lens(job, "JobShape"), "title").raw
    parts = [whole.filter(F.pmod(F.xxhash64("s", "p", "o"), F.lit(3)) == k) for k in range(3)]
    live = LiveCertificates(engine, raw, shared_folder(spark, "live-test"), "x")
    state = lambda df: sorted((r.row_key, r.certificate) for r in df.collect())
    for k, part in enumerate(parts):
        live.apply(part, k)
    want = state(engine.certify(raw, "x"))
    assert want and state(live.current(spark)) == want
    live.apply(parts[2], 2)  # the batch is repeated after a failure
    live.apply(parts[0].unionByName(parts[0]), 3)  # facts that are known
    assert state(live.current(spark)) == want and spark.read.parquet(f"{live.folder}/facts/batch=3").count() == 0
    b = Builder(cat)
    e = b.entity()
    with pytest.raises(UnsupportedPlan):
        LiveCertificates(engine, b.select(e, "NameShape").field(b.lens(e, "NameShape"), "nick", required=False).raw, str(tmp_path), "x")
