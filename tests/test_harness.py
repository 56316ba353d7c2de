import pytest

from factgraph.errors import CatalogError
from factgraph.operators import harness


def corpus(**change):
    qs = [{"id": f"q-{k}", "scenario": "abc"[k % 3], "text": "what?", "status": "direct"} for k in range(21)]
    return {"frozen_at": "2026-01-01T00:00:00+00:00", "questions": qs} | change


def test_corpus(tmp_path):
    assert harness.validate_corpus(corpus()) == harness.validate_corpus(corpus()) != harness.validate_corpus(corpus(frozen_at="2026-01-02T00:00:00Z"))
    one = corpus()["questions"]
    for bad in ({"frozen_at": "2026-01-01"}, {"frozen_at": "never"}, {"questions": one[:5]}, {"questions": one + one[:1]}, {"more": 1}, {"questions": [{**q, "scenario": "a"} for q in one]}, {"questions": [{**q, "text": 1} for q in one]}):
        with pytest.raises(CatalogError):
            harness.validate_corpus(corpus(**bad))
    harness.write_new_json(f"{tmp_path}/x.json", corpus())
    with pytest.raises(FileExistsError):
        harness.write_new_json(f"{tmp_path}/x.json", {})


def test_gate_and_matrix(spark):
    q = spark.createDataFrame([("a", "direct", 0), ("a", "overlay", 1), ("b", "direct", 0), ("b", "direct", 1), ("c", "blocked", 4)], "scenario string, status string, overlays int")
    cover = harness.early_gate(q)
    assert {r.scenario: (r.direct, r.combined) for r in cover.collect()} == {"a": (0.5, 1.0), "b": (1.0, 1.0), "c": (0.0, 0.0), None: (0.6, 0.8)}
    assert harness.gate_passes(cover) and not harness.gate_passes(cover, scenarios=3)
    schema = "fixture string, values array<string>"
    a = spark.createDataFrame([("f", ["x"]), ("f", ["x"]), ("g", [None])], schema)
    b = spark.createDataFrame([("f", ["x"]), ("g", [None]), ("h", ["y"])], schema)
    got = {r.fixture: (r.missing, r.unexpected, r.ok) for r in harness.fixture_matrix(a, b).collect()}
    assert got == {"f": (1, 0, False), "g": (0, 0, True), "h": (0, 1, False)}
    pairs = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (1.0, 1.0), (1.0, 0.0)], "a double, b double")
    assert tuple(harness.paired_ratio(pairs, "a", "b").first()) == (1.0, True)


def test_seeded_order(spark):
    df = spark.createDataFrame([(k, 10 - k) for k in range(10)], "id int, v int")
    order = [r.id for r in harness.seeded_order(df, 7).collect()]
    assert order == [r.id for r in harness.seeded_order(df.orderBy("v"), 7).collect()] and order != list(range(10))
