from docmill.llm import preferences
from docmill.llm.queries import oracle_sql, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_prefix_completions_and_masks(spark):
    rows = [(1, 0, "user", "hi é"), (1, 1, "assistant", "yes"), (1, 2, "user", "and"), (1, 3, "assistant", "a"), (2, 0, "user", "hi é"), (2, 1, "assistant", "yes"), (2, 2, "user", "or"), (3, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' as turns", "1 as chosen_id")
    out = {r.chosen_id: r for r in preferences.format_preferences(df).collect()}
    r = out[1]
    assert (r.rejected_id, r.n_common) == (2, 2) and r.prompt == render([("user", "hi é"), ("assistant", "yes")])
    assert r.chosen == render([("user", "and"), ("assistant", "a")]) and r.rejected == render([("user", "or")])
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["a<|end|>"] and r.rejected_mask == []
    assert out[3].rejected_id is None and out[3].rejected is None and out[3].chosen == render([("", "")]) and out[3].n_common == 0
    assert len(out) == 2
    given = preferences.format_preferences(df, spark.createDataFrame([(2, 1), (3, 9), (8, 1)], "chosen_id long, rejected_id long")).collect()
    assert sorted((r.chosen_id, r.n_common) for r in given) == [(2, 2), (3, 0)]


def test_common_first_turn_is_paired_whole(spark):
    rows = [(i * 7, 0, "user", "same") for i in range(901)] + [(i * 7, 1, "assistant", str(i % 3)) for i in range(901)]
    out = preferences.format_preferences(spark.createDataFrame(rows, SCHEMA)).collect()
    seen = [r.chosen_id for r in out] + [r.rejected_id for r in out if r.rejected_id is not None]
    assert sorted(seen) == [i * 7 for i in range(901)] and sum(r.rejected_id is None for r in out) == 1
    assert all(r.n_common >= 1 for r in out if r.rejected_id is not None)
    assert preferences.format_preferences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries()["op4_preferences"](spark, sf).collect()]
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = con.sql(oracle_sql()["op4_preferences"])
    key = lambda r: r[0]
    assert sorted(got, key=key) == sorted((tuple(r) for r in rel.fetchall()), key=key)
