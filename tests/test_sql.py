"""Queries and their SQL on small tables of keys, sums and words that the given ones don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docmill.operators import extract, report
from docmill.plans import fixtures, registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def both(spark, path, name, *tables):
    """The rows of a query and of its SQL on the tables in path."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = QUERIES[name](spark, str(path))
    found = con.sql(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(found)


def put(path, name, sql):
    duckdb.connect().sql(f"copy ({sql}) to '{path}/{name}.parquet' (format parquet)")


def test_s6_tells_keys_over_a_million_apart(spark, tmp_path):
    put(tmp_path, "lineitem", "select * from (values (1::bigint, 1000001::bigint, 'A'), (2, 1, 'A'), (2, 1, 'A')) as v(l_suppkey, l_partkey, l_returnflag)")
    assert both(spark, tmp_path, "s6_graph", "lineitem") == ([("A", 2)], [("A", 2)])


def test_a12_sums_do_not_hang_on_their_order(spark, tmp_path):
    put(tmp_path, "lineitem", "select g::bigint as l_partkey, p::double as l_discount, 1.0::double as l_extendedprice from (values (1, 0.1), (1, 0.2), (1, 0.3), (2, 0.3), (2, 0.2), (2, 0.1), (3, 0.6), (4, 0.25), (5, 0.05)) as v(g, p)")
    mine, sql = both(spark, tmp_path, "a12_risk_ranking", "lineitem")
    assert mine == sql and [(k, n) for k, _, n in mine] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert [r for _, r, _ in mine] == [0.6, 0.6, 0.6, 0.3, 0.1]  # 0.25 and 0.05 are rounded up, in both
    rows = spark.createDataFrame([(1, None, 1.0)], "g int, probability double, impact double")
    assert report.risk_ranking(rows, "g").first().risk is None


def test_c5_takes_the_first_eight_concepts(spark, tmp_path):
    words = "zulued yankee xrayed wordly victor unions tangos sierra romeos quebec"
    put(tmp_path, "benchmark", f"select 1::bigint as item_id, '{words}' as text")
    put(tmp_path, "documents", "select 1::bigint as doc_id, 'Zulued yankee. romeos quebec' as text, 'en' as lang, 'src0' as source, 28::bigint as n_chars")
    mine, sql = both(spark, tmp_path, "c5_relation_report", "benchmark", "documents")
    assert mine == sql and {r[-1] for r in mine} == {8}


@pytest.mark.parametrize("kinds", [None, ["threshold"], ["metric", "equation"]])
def test_x11_picks_first_rows_without_a_window(spark, kinds):
    """The same metric stands in every source of a page: no window may hold it."""
    s = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, "A.md").otherwise("a.md").alias("filename"), F.lit(1).alias("page"), F.lit("Coverage index: strong\nrisk = y + 1\nRTO at least 5% of all recovery targets").alias("content"))
    out = extract.extract_formula_rows(s, kinds=kinds)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.kind, r.filename, r.id) for r in out.collect()}
    assert rows == {(k, "A.md", 0) for k in kinds or ["threshold", "metric", "equation"]}


def test_small_files_are_dealt_out(spark):
    t = fixtures.dealt(spark, "/root/testdata/sf0.001", "part", "p_partkey", "p_size")
    assert t.columns == ["p_partkey", "p_size"] and t.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_files_of_a_stream_do_not_grow(spark):
    from docmill.plans.suites import report as suite

    assert [suite.arriving(spark.range(n), 5) for n in (0, 10, 25_000, 25_001, 100_000)] == [5, 5, 5, 10, 20]


def test_bm25_sends_the_best_of_each_task(spark):
    """No row for each chunk and query is shuffled: the plan has no join of postings with questions."""
    plan = QUERIES["k3_bm25_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_a7_cuts_texts_once(spark):
    """Pairs meet on stored rows, not on texts that are cut again for each side."""
    from docmill.operators import graph

    c = spark.createDataFrame([(1, "alpha"), (1, "beta x")], "query_id int, concept string")
    chunks = spark.createDataFrame([("a", "Alpha, beta x."), ("b", "beta. x alpha")], "chunk_uuid string, content string")
    out = graph.concept_cooccurrence(c, chunks)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(content") == 0
    assert [(r.x, r.y, r.evidence, r.n_chunks) for r in out.collect()] == [("alpha", "beta x", "strong", 1)]


def test_p17_of_blank_texts_is_empty(spark, tmp_path):
    """The heading's line end was stripped where no text followed, so the heading stayed; Unicode's spaces stayed at the ends."""
    texts = ["null", "''", "' '", "chr(10)", "chr(9) || chr(10)", "'Doc: x' || chr(10) || 'y'", "'Doc: x'", "chr(160)", "chr(12288) || ' a' || chr(160) || 'b ' || chr(8195)", "repeat('x', 1799) || '  yz'"]
    put(tmp_path, "documents", f"select i::bigint as doc_id, t as text, 'en' as lang, 'src0' as source, 0::bigint as n_chars from (values {', '.join(f'({i}, {t})' for i, t in enumerate(texts))}) as v(i, t)")
    mine, sql = both(spark, tmp_path, "p17_embedding_text", "documents")
    assert mine == sql and [t for _, t in mine[:8]] == ["", "", "", "", "", "Doc: x y", "Doc: x", ""] and mine[8][1] == "a\u00a0b"


def test_j13_takes_all_formulas_of_a_chunk(spark, tmp_path):
    """Formulas after the sixth of a chunk were left out, in the query and in its SQL."""
    put(tmp_path, "lineitem", "select 7::bigint as l_orderkey, i::bigint as l_partkey from range(9) as r(i) union all select 8, 3")
    put(tmp_path, "orders", "select * from (values (7::bigint), (8), (9)) as v(o_orderkey)")
    put(tmp_path, "part", "select i::bigint as p_partkey, i::int as p_size, 'b' as p_brand, 't' as p_type from range(8) as r(i)")
    mine, sql = both(spark, tmp_path, "j13_attach_formulas", "lineitem", "orders", "part")
    assert mine == sql and [(q, text.count("LaTeX")) for q, text, _ in mine] == [(7, 8), (8, 1)]
    from docmill.operators import graph

    m = spark.createDataFrame([("c", i) for i in range(9)], "chunk_uuid string, entity_id int")
    f = spark.createDataFrame([(i, f"x{i}", None, None) for i in range(9)], "formula_id int, latex string, plain string, meaning string")
    s = spark.createDataFrame([(1, "c")], "query_id int, chunk_uuid string")
    assert [graph.attach_formulas(s, m, f, k).first().content.count("LaTeX") for k in (None, 6)] == [9, 6]
