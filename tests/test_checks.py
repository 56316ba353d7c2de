"""Every query with SQL gives the SQL's rows; tables are read from the smallest test data."""

import os

import pytest

from factgraph import checks, queries, table_queries

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{TABLES}/{n}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


OWN = (
    "star_join card_ranking field_optional recall_at_k latency_percentiles grouped_report certificate_coverage row_keys evidence_edge evidence_inverse evidence_selector evidence_filter evidence_field evidence_valid evidence_faults scalar_observed "
    "field_bound sel_target_nodes store_star_join store_cycle_join store_sel_union store_terms store_predicates store_characteristics path_reach path_witness path_faults absence_evidence absence_broken aggregate_evidence aggregate_broken ranked_fusion "
    "hybrid_retrieval live_certificates"
).split()


def compare(spark, db, run, text):
    df, sql = run(spark, TABLES), db.execute(text)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in sql.description], sql.fetchall())


@pytest.mark.parametrize("name", checks.CASES)
def test_case_over_the_sample_graph(spark, db, name):
    compare(spark, db, checks.CASES[name], checks.CASES_SQL[name])


@pytest.mark.parametrize("name", [*checks.QUERIES, *table_queries.QUERIES, *OWN])
def test_query_equals_sql(spark, db, name):
    compare(spark, db, {**queries.QUERIES, **checks.QUERIES, **table_queries.QUERIES}[name], {**queries.SQL, **checks.SQL, **table_queries.SQL}[name])
