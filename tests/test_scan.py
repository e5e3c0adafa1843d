"""What a search over the stored index sends from its tasks, and the shape of the index."""

import random

import numpy as np
from pyspark.sql import functions as F

from docmill.operators import index, search

WORDS = ["mfa", "risk", "risks", "the", "a", "plan", "règle", "émfa"]


def corpus(spark, n=400):
    rng = random.Random(5)
    rows = [(f"c{i:04d}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))), f"src{i % 4}.md", i) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_uuid string, content string, filename string, n int").withColumn("ingestion_ts", F.timestamp_seconds("n")).drop("n")


def test_the_index_has_one_row_for_each_chunk(spark, tmp_path):
    """A row for each word is shuffled and sorted at about a hundred bytes a word: the index of 1 GB failed by disk."""
    idx = index.build_index(corpus(spark), str(tmp_path / "i"))
    assert idx.postings.count() == 400
    plan = index.posting_rows(corpus(spark), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_a_task_sends_the_best_of_each_query_only(spark, tmp_path):
    """What is shuffled for a very common word are k rows for each task and query, not a row for each chunk that holds it."""
    idx = index.build_index(corpus(spark), str(tmp_path / "i"))
    q = spark.createDataFrame([(i, ["the", WORDS[i % 8]]) for i in range(5)] + [(0, ["plan"])], "query_id int, terms array<string>")
    held = index.chunk_words(idx).repartition(3)
    for method in ("count", "bm25"):
        n, mean = index.corpus_size(idx)
        mine = index.best_texts(q, held, 7, method, n, mean, 6)
        want = search.text_topk(q, search.inverted_index(corpus(spark)), 7, method, n_chunks=n, mean_length=mean, digits=6)
        assert sorted(map(tuple, mine.select("query_id", "chunk_uuid", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "chunk_uuid", "score", "rank").collect()))


def test_queries_in_blocks_are_the_same(spark, tmp_path, monkeypatch):
    idx = index.build_index(corpus(spark), str(tmp_path / "i"))
    q = spark.createDataFrame([(i, [WORDS[i % 8], WORDS[(i + 3) % 8]]) for i in range(9)], "query_id int, terms array<string>")
    p = spark.createDataFrame([(i, f"{WORDS[i % 8]} {WORDS[(i + 1) % 8]}") for i in range(9)], "query_id int, phrase string")
    rows = lambda: [sorted(map(tuple, df.collect())) for df in (index.text_search(q, idx, 5), index.phrase_search(p, idx, 5))]
    whole = rows()
    monkeypatch.setattr(index, "PAIRS", 4)
    monkeypatch.setattr(index, "NEEDLES", 2)
    assert rows() == whole


def test_phrases_by_the_rule_of_texts(spark, tmp_path):
    """The longest word of a phrase may stand whole elsewhere in the chunk, as search.phrase_topk has it and the SQL of K-4 states."""
    data = corpus(spark)
    idx = index.build_index(data, str(tmp_path / "i"))
    p = spark.createDataFrame([(1, "risk the"), (2, "a risk"), (3, "mfa a"), (4, "plan règle"), (5, "isk")], "query_id int, phrase string")
    both = [sorted((r.query_id, r.chunk_uuid, r["rank"]) for r in df.collect()) for df in (index.phrase_search(p, idx, 300, longest="chunk"), search.phrase_topk(p, data, 300))]
    assert both[0] == both[1] and both[0]
    assert index.phrase_search(p, idx, 300).count() < len(both[0])


def test_names_with_the_same_beginning_meet_only_what_they_contain(spark):
    """All names of a corpus may begin alike: then every needle met every text by its first three letters."""
    texts = spark.createDataFrame([(f"src{i}",) for i in range(300)], "text string")
    needles = spark.createDataFrame([(f"src{i}",) for i in range(0, 300, 7)] + [("",), ("zz",)], "needle string")
    got = sorted((r.text, r.needle) for r in search.containing(texts, needles).collect())
    assert got == sorted((f"src{i}", f"src{j}") for i in range(300) for j in range(0, 300, 7) if str(i).startswith(str(j)))
    plan = search.containing(texts, needles)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" not in plan


def test_nearest_of_a_task_are_those_of_all(spark):
    """Cells send the best of a task for each query, ties to the smaller name, also with more ties than k."""
    import numpy as np

    from docmill.operators import vectors

    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 50, axis=0)])
    data = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "chunk_uuid string, embedding array<double>")
    q = data.where("chunk_uuid >= 'v290'").select(F.col("chunk_uuid").alias("query_id"), "embedding")
    made = vectors.build_index(data, 4)
    mine = [tuple(r) for r in vectors.search(made, q, 7, made.cells, digits=6).select("query_id", "chunk_uuid", "score", "rank").collect()]
    want = [tuple(r) for r in search.vector_topk(q, data, 7, digits=6).select("query_id", "chunk_uuid", "score", "rank").collect()]
    assert sorted(mine) == sorted(want) and len(mine) == 60 * 7


def test_exact_vectors_meet_in_blocks_not_in_rows_of_arrays(spark):
    """A row held 2,048 vectors and was copied for each query: K-1 over 1 GB failed by executor memory."""
    rng = np.random.default_rng(3)
    data = spark.createDataFrame([(f"c{i % 40}" if i else None, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(200)], "chunk_uuid string, embedding array<double>")
    q = spark.createDataFrame([(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(30)], "query_id int, embedding array<double>")
    found = search.vector_topk(q, data, 7, digits=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
    whole, blocks = (sorted(tuple(r) for r in df.select("query_id", "score", "rank").collect()) for df in (found, search.vector_topk(q, data, 7, 400, 16, digits=6)))
    assert whole == blocks and len(whole) > 100


def test_texts_are_scored_in_their_own_row(spark):
    """A row for each word of the corpus that is asked for was grouped: one task's memory grew with the corpus."""
    from docmill.plans.suites import search as suite

    plan = suite.k3(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "term" not in plan


def test_phrases_and_aliases_are_found_in_one_pass(spark, monkeypatch):
    """Each word or short substring of each chunk was a row of a shuffle; now a task sends its newest hits."""
    data = corpus(spark).unionByName(corpus(spark).where("chunk_uuid < 'c0100'")).withColumn("ingestion_ts", F.when(F.col("chunk_uuid") != "c0007", F.date_trunc("minute", "ingestion_ts")))
    p = spark.createDataFrame([(1, "risk the"), (1, "A plan"), (2, "a risk"), (3, "mfa a"), (4, "plan règle"), (5, "isk"), (6, None), (6, "zebra")], "query_id int, phrase string")
    a = spark.createDataFrame([(1, "MFA"), (2, "isk"), (2, "e"), (3, "the a"), (4, "risks plan"), (5, ""), (6, "zebra")], "query_id int, alias string")
    rows = sorted({(r.chunk_uuid, r.filename, r.content, r.ingestion_ts) for r in data.collect()}, key=lambda r: (r[3] is None, -r[3].timestamp() if r[3] else 0, r[0]))
    main = {"risk the": "risk", "a plan": "plan", "a risk": "risk", "mfa a": "mfa", "plan règle": "règle"}
    asked = {(r.query_id, r.phrase.lower()) for r in p.where("phrase != ''").collect()}
    phrases = [(q, c, n + 1) for q in range(1, 6) for n, c in enumerate([c for c, _, t, _ in rows if any(x in t and main.get(x, x) in t.split() for i, x in asked if i == q)][:9])]
    aliases = [(q, x, c, n + 1) for q, x in map(tuple, a.collect()) if x for n, c in enumerate([c for c, f, t, _ in rows if "src3" in f and x.lower() in t and x != "MFA"][:9])]
    for most in (100, 2):
        monkeypatch.setattr(search, "NEEDLES", most)
        found, held = search.phrase_topk(p, data, 9), search.glossary_topk(a, data, "src3", 9)
        assert sorted((r.query_id, r.chunk_uuid, r["rank"]) for r in found.collect()) == sorted(phrases) and len(phrases) > 20
        assert sorted((r.query_id, r.alias, r.chunk_uuid, r["rank"]) for r in held.collect()) == sorted(aliases) and len(aliases) > 20
        for df in (found, held):
            assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_meet_the_files_of_their_scope(spark, monkeypatch):
    """The words of a chunk were an array in each row of a query and chunk, and each part of a name was a row: K-6 over 1 GB failed by disk."""
    data = corpus(spark, 60).withColumn("filename", F.concat(F.lit("src"), (F.expr("cast(substring(chunk_uuid, 2) as int)") % 23).cast("string"), F.lit(".md")))
    q = spark.createDataFrame([(1, "src1.pdf", ["the", "mfa", "the", "", "a\nb"]), (2, "src12.pdf", ["règle", "risk"]), (3, "x", ["the"]), (4, None, ["the"]), (5, "src22.pdf", None), (6, "src3.pdf", [])], "query_id int, active_doc string, terms array<string>")
    rows = {(r.chunk_uuid, r.filename, r.content, r.ingestion_ts) for r in data.collect()}
    want = set()
    for who, doc, terms in q.collect():
        name = (doc or "").replace(".pdf", "")
        own = [(sum(w in (terms or []) for w in t.split()), at, c) for c, f, t, at in rows if name and (name in f[:-3] or f[:-3] in name)]
        for rank, (n, _, c) in enumerate(sorted(own, key=lambda x: (-x[0], -x[1].timestamp(), x[2]))[:5], 1):
            want.add((who, c, round(n * 0.1 or 0.001, 6), rank))
    held = data.select("chunk_uuid", search.words(F.col("content")).alias("w"))
    for most, words in ((100, held), (2, data.select("chunk_uuid", "filename", search.words(F.col("content")).alias("w")))):
        monkeypatch.setattr(search, "NEEDLES", most)
        found = search.doc_scope_topk(q, data, lambda ids: words, 5)  # noqa: B023
        assert {(r.query_id, r.chunk_uuid, round(r.score, 6), r["rank"]) for r in found.collect()} == want and len(want) > 15
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_looked_up_as_columns(spark, tmp_path):
    """Each word of a chunk was looked up by itself, so C-3 over 6 GB failed by time; sums are those of before, added up in the order of the words."""
    import inspect

    from docmill.operators import scan

    source = inspect.getsource(scan.scorer)
    assert "index_in" in source and "Counter" not in source
    idx = index.build_index(corpus(spark), str(tmp_path / "i"))
    n, mean = index.corpus_size(idx)
    q = spark.createDataFrame([(1, ["the", "the", "zebra", None, ""]), (2, ["zebra"]), (3, ["mfa", "règle"]), (4, [])], "query_id int, terms array<string>")
    for method in ("count", "bm25"):
        mine = index.best_texts(q, index.chunk_words(idx), 9, method, n, mean, 6)
        want = search.text_topk(q, search.inverted_index(corpus(spark)), 9, method, n_chunks=n, mean_length=mean, digits=6)
        rows = [sorted(map(tuple, df.select("query_id", "chunk_uuid", "score", "rank").collect())) for df in (mine, want)]
        assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {1, 3}
