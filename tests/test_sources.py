import pytest
from graphs import DATA, facts

from factgraph.errors import CatalogError, PlanError
from factgraph.functions.terms import Term, effective_datatype, sort_fields, token_value
from factgraph.sources.turtle import parse_turtle, read_facts, read_ntriples, read_turtle, strict_json, write_facts
from factgraph.streaming.facts import append_facts, stream_facts


def test_turtle():
    text = """
    PREFIX e: <http://e/> @base <http://b/> .
    e:a a e:T ; e:p 1, 1.5, 1e3, true, "x\\n\\u00e9"@EN-us, '''no''' .
    """
    with pytest.raises(CatalogError):
        parse_turtle(text)
    got = parse_turtle(text.replace(", '''no'''", ', """two\nlines "q" """, <rel>, [ e:q ( e:x "y" ) ]'))
    objects = [o for s, p, o in got if p == "<http://e/p>"]
    assert objects[:5] == ['"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"1.5"^^<http://www.w3.org/2001/XMLSchema#decimal>', '"1e3"^^<http://www.w3.org/2001/XMLSchema#double>', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>', '"x\\né"@en-us']
    assert objects[5:7] == ['"two\\nlines \\"q\\" "', "<http://b/rel>"] and objects[7].startswith("_:b0000")
    assert sum(p.endswith("#rest>") for _, p, _ in got) == 2
    for bad in ("e:a e:b e:c .", "<http://a> <http://b> .", "<http://a> <http://b> <http://c>"):
        with pytest.raises(CatalogError):
            parse_turtle(bad)


def test_files_round_trip(spark, tmp_path):
    df = facts(spark, DATA, "<http://g>")
    write_facts(df, f"{tmp_path}/facts")
    back = read_facts(spark, f"{tmp_path}/facts")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        write_facts(df, f"{tmp_path}/facts")
    (tmp_path / "d.ttl").write_text(DATA)
    assert sorted(map(tuple, read_turtle(spark, f"{tmp_path}/d.ttl", "<http://g>").collect())) == sorted(map(tuple, df.collect()))
    lines = "".join(f"{r.s} {r.p} {r.o} .\n" for r in df.collect())
    (tmp_path / "d.nt").write_text(lines.replace('"@en', '"@EN') + "# a comment\n\n")
    assert sorted(map(tuple, read_ntriples(spark, f"{tmp_path}/d.nt", "<http://g>").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.nt").write_text("<http://a> nonsense .\n")
    with pytest.raises(Exception, match="N-Triples"):
        read_ntriples(spark, f"{tmp_path}/bad.nt").collect()


def test_streams_of_facts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text('<http://a> <http://p> "1" .\n<http://a> <http://p> "1" .\n')
    calls = []
    for name, text in ((None, ""), ("b.nt", '<http://a> <http://p> "1" .\n<http://b> <http://p> <http://a> .\n')):
        if name:
            (tmp_path / "in" / name).write_text(text)
        q = append_facts(stream_facts(spark, f"{tmp_path}/in", "<http://g>"), f"{tmp_path}/t", f"{tmp_path}/c", lambda s: calls.append(1))
        assert q.awaitTermination(120)
    assert sorted((r.s, r.o) for r in read_facts(spark, f"{tmp_path}/t").collect()) == [("<http://a>", '"1"'), ("<http://b>", "<http://a>")]
    assert len(calls) == 2


def test_columns_agree_with_terms(spark):
    terms = [Term.iri("urn:a"), Term.literal('q"\\\n\t'), Term.literal("1", "urn:d"), Term.literal("x", language="en"), Term.literal(""), Term.literal("\\n")]
    df = spark.createDataFrame([(k, t.token) for k, t in enumerate(terms)], "k int, t string")
    c = df["t"]
    got = df.select("k", token_value(c).alias("v"), effective_datatype(c).alias("d")).orderBy("k").collect()
    assert [(r.v, r.d) for r in got] == [(t.value, t.effective_datatype) for t in terms]
    order = [r.k for r in df.orderBy(*sort_fields(c)).collect()]
    assert order == [k for k, _ in sorted(enumerate(terms), key=lambda x: x[1].sort_key)]


def test_strict_json():
    assert strict_json('{"a": [1]}') == {"a": [1]}
    for bad in ('{"a": 1, "a": 2}', "[NaN]"):
        with pytest.raises(PlanError):
            strict_json(bad)


def test_nquads_and_blank_nodes_of_files(spark, tmp_path):
    from factgraph.sources.turtle import nquads_facts, read_nquads, write_nquads

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.nq").write_text('# facts\n_:x <urn:p> "1"@EN <urn:g> .\n<urn:s> <urn:p> _:x.y _:x . # end\n\n<urn:s> <urn:p> <urn:o> .\n<urn:s> <urn:p> <urn:o> .\n')
    rows = read_nquads(spark, str(tmp_path / "in")).collect()
    assert sorted((r.g, r.s, r.o) for r in rows if r.s == "<urn:s>" and r.g is None) == [(None, "<urn:s>", "<urn:o>")]
    own = {r.s for r in rows if r.s.startswith("_:")}
    assert len(own) == 2 and {r.g for r in rows if r.o.startswith("_:")} == own  # a label is one node in its file, another in the other
    assert {r.o for r in rows if r.s in own} == {'"1"@en'}
    whole = read_nquads(spark, str(tmp_path / "in"))
    write_nquads(whole.filter("NOT s LIKE '\\_:%' AND NOT o LIKE '\\_:%'"), str(tmp_path / "out"))
    assert read_nquads(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="not an N-Quads line"):
        nquads_facts(spark.createDataFrame([("<urn:s> <urn:p> .", "f")], "value string, file string")).collect()
