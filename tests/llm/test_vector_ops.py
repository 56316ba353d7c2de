"""Searches against brute force."""

import math
import random

import numpy as np
import pytest

from factgraph.llm import impact_index, posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    centers = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    out = []
    for k in range(1500):
        c = centers[k % 12]
        out.append((k, [x + r.gauss(0, 0.5) for x in c]))
    for k in range(1500, 1900):  # a third of a part: one vector
        out.append((k, centers[0]))
    nan, inf = math.nan, math.inf
    out += [(2000, None), (2050, [nan] * 16), (2100, [inf] + [0.0] * 15), (2150, [None] + [1.0] * 15), (2200, [0.0] * 16), (None, centers[1]), (50, centers[2]), (2250, [1.0, 2.0])]
    return [(i, e and [None if x is None else float(np.float32(x)) for x in e]) for i, e in out]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x") for i, e in rows], SCHEMA).repartition(3)


def usable(rows, zero):
    out = [(i, np.array(e + [0.0] * (16 - len(e)))) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    return [(i, e) for i, e in out if zero or e.any()]


def test_exact_top_k(spark, rows):
    good = usable(rows, True)
    ids, x = np.array([i for i, _ in good]), np.floor(256 * np.array([e for _, e in good])).astype(np.int64)
    want = []
    for n in np.flatnonzero(ids % 50 == 0):
        s = x @ x[n]
        own = [(int(v), int(i)) for v, i in zip(s, ids) if i != ids[n]]
        want += [(int(ids[n]), v, i) for v, i in own]
    best = {}
    for q, v, i in want:
        best.setdefault(q, []).append((-v, i))
    got = {}
    for r in impact_index.search(frame(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert got.keys() == best.keys()
    for q in best:
        have = [(v, i) for _, v, i in sorted(got[q])]
        assert [k for k, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        if q != 50:  # two query rows share id 50, and give the five best pairs of both
            assert have == sorted(best[q])[:5]
    assert impact_index.search(frame(spark, rows).limit(0)).count() == 0
    few = impact_index.search(frame(spark, rows[:3])).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]


def test_impact_block_stops_on_proof_only():
    rng = np.random.default_rng(0)
    v = (rng.standard_exponential((500, 12)) ** 3 * rng.choice([-1, 1], (500, 12)) * 10).astype(np.int64)
    q = (rng.standard_exponential((20, 12)) ** 3 * 10).astype(np.int64).astype(float)
    block = impact_index.ImpactBlock(np.arange(500), v)
    row, col, score = block.top(np.full(20, -1), q, 5, np.full(20, -np.inf))
    for k in range(20):
        s = v @ q[k].astype(np.int64)
        mine = sorted(zip(-score[row == k], col[row == k]))[:5]
        assert mine == sorted(zip(-s, np.arange(500)))[:5]
    assert len(row) < 20 * 500


def test_large_impacts_are_exact_or_an_error(spark):
    r = random.Random(5)
    # Scores beyond 2**53 that differ in their last digits.
    big = [(k, [float(2**28 + r.randint(-3, 3)) for _ in range(8)]) for k in range(0, 400)]
    table = spark.createDataFrame([(i, e, 0, "x") for i, e in big], SCHEMA.replace("float", "double"))
    x = np.array([e for _, e in big]).astype(np.int64).astype(object)
    for row in impact_index.search(table, scale=1).collect():
        s = x @ x[row.query_id]
        order = sorted((-v, i) for i, v in enumerate(s) if i != row.query_id)
        assert (-row.score, row.vec_id) == order[row["rank"] - 1]
    with pytest.raises(OverflowError):
        impact_index.search(table, scale=256)


def test_postings_hold_what_is_not_zero():
    v = np.array([[0, 0, 3], [5, 0, 0], [0, -2, 0], [0, 0, 0]])
    block = impact_index.ImpactBlock(np.arange(4), v)
    assert [(a.tolist(), b.tolist(), c.tolist()) for a, b, c, _, _ in block.segments] == [([1], [0], [5.0]), ([2, 0], [1, 2], [-2.0, 3.0])]
    row, col, score = block.top(np.array([9]), np.array([[1.0, 1.0, 1.0]]), 2, np.full(1, -np.inf))
    assert sorted(zip(score.tolist(), col.tolist()), reverse=True)[:2] == [(5, 1), (3, 0)]


def test_nearest(spark, rows):
    good = usable(rows, False)
    ids = np.array([i for i, _ in good])
    x = np.array([e for _, e in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in posting_lists.search(frame(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for n in np.flatnonzero((ids % 50 == 0) & (ids != 50)):
        s = np.where(ids == ids[n], -9, x @ x[n])
        top = np.lexsort((ids, -np.round(s, 12)))[:5]
        mine = sorted(got[int(ids[n])])
        assert [k for k, _, _ in mine] == [1, 2, 3, 4, 5]
        by = {int(i): v for i, v in zip(ids, s)}
        assert all(abs(by[i] - v) < 1e-9 for _, i, v in mine if i != 50)
        hits += len({i for _, i, _ in mine} & set(ids[top].tolist()))
        total += 5
    assert hits >= 0.9 * total
    assert 2200 not in got and 2000 not in got and not any(i in (2200, 2050) for v in got.values() for _, i, _ in v)
    assert posting_lists.search(frame(spark, rows).limit(0)).count() == 0
    assert posting_lists.search(frame(spark, rows[:1])).count() == 0


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(1)
    c = posting_lists.unit(rng.normal(size=(300, 8)))
    graph = posting_lists.CentroidGraph(c, degree=10)
    right = 0
    for q in posting_lists.unit(rng.normal(size=(50, 8))):
        near = np.argsort(posting_lists.distances(q[None], c)[0])[:10]
        right += len({k for _, k in graph.nearest(q, 30)[:10]} & set(near.tolist()))
    assert right >= 450


def test_lists_are_scanned_until_the_distance_ends_the_search(spark, monkeypatch):
    # Random directions: no list is much nearer than others, and neighbours lie in many.
    monkeypatch.setattr(posting_lists, "PER_LIST", 30)
    monkeypatch.setattr(posting_lists, "GROUP_ROWS", 300)
    monkeypatch.setattr(posting_lists, "QUERY_ROWS", 50)
    x = posting_lists.unit(np.random.default_rng(3).normal(size=(6000, 48)))
    got = {}
    table = spark.createDataFrame([(k, e.tolist(), 0, "x") for k, e in enumerate(x)], "vec_id long, embedding array<double>, label int, score string")
    for r in posting_lists.search(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for n in range(0, 6000, 50):
        s = x @ x[n]
        s[n] = -9
        hits += len(got[n] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.97 * 600, hits


def test_copies_of_one_id_take_one_place(spark):
    x = np.random.default_rng(4).normal(size=(30, 8))
    near = [(7, (x[0] * (1 + k)).tolist(), 0, "x") for k in range(20)]  # one id, twenty rows, nearest to the query
    table = spark.createDataFrame([(50 if k == 0 else 100 + 50 * k + 1, e.tolist(), 0, "x") for k, e in enumerate(x)] + near, SCHEMA.replace("float", "double"))
    got = [(r["rank"], r.vec_id) for r in posting_lists.search(table).orderBy("rank").collect()]
    assert [k for k, _ in got] == [1, 2, 3, 4, 5] and got[0][1] == 7 and len({i for _, i in got}) == 5
