"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from docmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries without SQL, whose operators have tests of their own.
ROWS_ONLY = {"p3_normalize_unicode", "x2_chunk_paragraphs", "x3_chunk_soft", "x4_chunk_recursive", "x5_chunk_markdown", "x5_markdown_pages", "c1_ingest_corpus", "k1_vector_indexed"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, int | bool | type(None)) else str(v)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    found = db.sql(SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(df.columns)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["p1_normalize_whitespace", "p8_math_or_table", "x1_chunk_fixed", "a3_topics", "k3_text_topk", "k1_vector_topk", "w6_rrf", "d1_merge_candidates", "j8_graph_neighbors"])
def test_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in QUERIES["w4_limit_per_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark):
    plan = QUERIES["a12_risk_ranking"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_quantity" not in plan
