"""Hubs of the graph, reports over a question's own sources, forced sources of tier A, sanitised charts."""

import json
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from docmill.operators import fuse, graph, report, scan
from docmill.plans import pipelines


def graph_tables(spark, n=3000, queries=12):
    """Every third chunk mentions entity 0, each chunk some of its own; seeds are chunks that mention entity 0."""
    rows = [(0, c, "TERM") for c in range(0, n, 3)] + [(1 + (c * m) % 500, c, "TERM") for c in range(n) for m in (1, 7)] + [(9999, c, "generic") for c in range(n)]
    seeds = [(q, 3 * (q * 5 + i)) for q in range(queries) for i in range(3)]
    return spark.createDataFrame(rows, "entity_id long, chunk_uuid long, category string"), spark.createDataFrame(seeds, "query_id long, chunk_uuid long"), rows, seeds


def plain_neighbours(rows, seeds, least=2, k=4):
    of_chunk, of_entity = {}, {}
    for e, c, kind in rows:
        if kind != "generic":
            of_chunk.setdefault(c, set()).add(e)
            of_entity.setdefault(e, set()).add(c)
    out = set()
    for q in {q for q, _ in seeds}:
        own = {c for x, c in seeds if x == q}
        shared = Counter(c for e in set().union(*[of_chunk[c] for c in own]) for c in of_entity[e])
        best = sorted(((-n, c) for c, n in shared.items() if n >= least and c not in own))[:k]
        out |= {(q, c, -n, i + 1) for i, (n, c) in enumerate(best)}
    return out


def test_hubs_are_split_without_losing_neighbours(spark):
    m, s, rows, seeds = graph_tables(spark)
    for size in (50, 1_000_000):
        found = graph.graph_neighbors(m, s, split_rows=size)
        assert {(r.query_id, r.chunk_uuid, r.shared, r["rank"]) for r in found.collect()} == plain_neighbours(rows, seeds)


def test_no_key_holds_a_hub(spark):
    m, s, rows, seeds = graph_tables(spark)
    own = m.where("category = 'TERM'").select("entity_id", "chunk_uuid").distinct()
    wanted = s.join(own, "chunk_uuid").select("query_id", "entity_id").distinct()
    asked, held = graph.split_hubs(wanted, own, 200)
    made = asked.join(held, ["entity_id", "part"])
    assert made.count() == wanted.join(own, "entity_id").count()
    whole = wanted.join(own, "entity_id").groupBy("entity_id").count().agg(F.max("count")).first()[0]
    most = made.groupBy("entity_id", "part").count().agg(F.max("count")).first()[0]
    assert whole == 12 * 1000 and most <= 400


def test_a_hub_of_queries_is_split_by_query(spark):
    own = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "entity_id long, chunk_uuid long")
    wanted = spark.range(1000).select(F.col("id").alias("query_id"), F.lit(1).cast("long").alias("entity_id"))
    asked, held = graph.split_hubs(wanted, own, 100)
    made = asked.join(held, ["entity_id", "part"])
    assert made.count() == 2000 and made.groupBy("part").count().agg(F.max("count")).first()[0] <= 200
    empty = graph.split_hubs(wanted.limit(0), own, 100)
    assert empty[0].join(empty[1], ["entity_id", "part"]).count() == 0


def relations(spark, queries, sources):
    chunks = spark.createDataFrame([("a", "Alpha needs gamma. Beta stands apart."), ("b", "alpha and beta agree."), ("c", None), ("d", "delta")], "chunk_uuid string, content string")
    edges = spark.createDataFrame([("Gamma", "USES", "beta")], "source string, relation string, target string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    s = None if sources is None else spark.createDataFrame(sources, "query_id long, chunk_uuid string")
    return {(r.query_id, r.x, r.y): r for r in pipelines.relation_report(q, chunks, edges, sources=s).collect()}


def test_relations_count_in_a_questions_own_sources(spark):
    asks = [(1, 'links of "alpha", "beta", "gamma"'), (2, 'the chain of "alpha", "beta"'), (3, None)]
    rows = relations(spark, asks, [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "a")])
    assert {k: (r.evidence, r.n_chunks) for k, r in rows.items()} == {
        (1, "alpha", "beta"): ("weak", 1),
        (1, "alpha", "gamma"): ("strong", 1),
        (1, "beta", "gamma"): ("edge", 1),
        (2, "alpha", "beta"): ("strong", 1),
    }
    assert rows[1, "alpha", "beta"].snippet.startswith("Alpha needs") and rows[2, "alpha", "beta"].snippet.startswith("alpha and")
    assert not rows[1, "alpha", "beta"].multi_hop and rows[2, "alpha", "beta"].unchained and rows[2, "alpha", "beta"].hops == 2
    everywhere = relations(spark, asks, None)
    assert everywhere[1, "alpha", "beta"].n_chunks == 2 and everywhere[2, "alpha", "beta"].n_chunks == 2
    nothing = relations(spark, asks, [])
    assert nothing[1, "alpha", "gamma"].evidence == "not_found" and nothing[1, "beta", "gamma"].evidence == "edge"


def test_two_edges_make_a_chain(spark):
    edges = spark.createDataFrame([("alpha", "R", "beta"), ("beta", "R", "gamma")], "source string, relation string, target string")
    chunks = spark.createDataFrame([("a", "x")], "chunk_uuid string, content string")
    q = spark.createDataFrame([(1, 'the path of "alpha", "beta", "gamma"')], "query_id long, query string")
    rows = pipelines.relation_report(q, chunks, edges).collect()
    assert len(rows) == 3 and all(r.multi_hop and not r.unchained for r in rows)


def tier_a(spark, queries, sources=(), texts=(("x", "norm x"), ("y", " "), ("z", None)), vectors=None):
    vectors = [("x", [1.0, 0.0], "A"), ("y", [1.0, 0.1], "A"), ("z", [0.9, 0.0], "A"), ("w", [1.0, 0.0], "B"), ("n", None, "A")] if vectors is None else vectors
    q = spark.createDataFrame(queries, "query_id long, query string, embedding array<double>")
    s = spark.createDataFrame(list(sources), "query_id long, pos int, tier string, content string")
    v = spark.createDataFrame(vectors, "chunk_uuid string, embedding array<double>, tier string")
    t = spark.createDataFrame(list(texts), "chunk_uuid string, content string")
    return sorted((r.query_id, r.pos, r.tier, r.content) for r in fuse.search_tier_a(s, q, v, t).collect())


def test_tier_a_is_searched_for_where_it_is_asked_for_and_lacking(spark):
    ask, v = "which obligations hold", [1.0, 0.0]
    queries = [(1, ask, v), (2, ask, v), (3, "hello", v), (4, None, v), (5, ask, None), (6, "checklist of obligations", v), (7, ask, [float("nan"), 1.0])]
    assert tier_a(spark, queries, [(1, 1, "B", "b"), (2, 1, "a", "own")]) == [(1, 0, "A", "norm x"), (1, 1, "B", "b"), (2, 1, "a", "own")]
    assert tier_a(spark, queries[:1], texts=[("y", " ")]) == []
    assert tier_a(spark, queries[:1], vectors=[]) == [] and tier_a(spark, [], [(1, 1, "B", None)]) == [(1, 1, "B", None)]


def test_charts_are_sanitised_after_they_are_chosen(spark):
    points = [{"category": c, "value": "1"} for c in ("Italia Sud", "Sudan", "South", "Nord")]
    charts = [(1, 1, 1, json.dumps({"timeframe": "Q1 2024, 2019 and 2024", "data_points": points, "title": "t"})), (2, 1, 1, json.dumps({"timeframe": "last week", "confidence": 0.9})), (3, 1, 1, None)]
    df = spark.createDataFrame(charts, "doc_id long, page_no int, pass int, raw string")
    rows = {r.doc_id: r for r in report.normalize_chart_json(df, sanitize=True).collect()}
    assert set(rows) == {1, 2} and rows[1].timeframe == "2019 vs 2024" and rows[2].timeframe == "NOT READABLE"
    assert [n.label for n in rows[1].numbers] == ["Sudan", "Nord"] and rows[1].n_points == 2 and "South" not in rows[1].text
    assert rows[1].confidence == report.normalize_chart_json(df).where("doc_id = 1").first().confidence


def test_plain_model_output_is_read_as_it_is(spark):
    """Texts were tidied by five patterns before the first reading, and acronyms found twice: the graph of a large corpus took over its time."""
    raws = ['{"nodes": [{"id": "a ,]"}]}', '{"nodes": [{"id": "a\x01b"}]}', '{"nodes": [{"id": "a,]\x02"},]}', '{"nodes": [{"id": "x"},]}', '{"nodes": [{"id": “q”}]}', 'so: {"nodes": [{"id": "y"}]}', '```json\n{"nodes": [{"id": "z"}]}\n```', '{"nodes": [{"id": "lone \\d"}]}', '{"nodes": [', "", None, "none"]
    out = graph.parse_llm_json(spark.createDataFrame(list(enumerate(raws)), "k long, raw string"))
    assert out.columns == ["k", "raw", "ok", "parsed"]
    rows = {r.k: r for r in out.collect()}
    want = ["a ,]", "a b", "a] ", "x", "q", "y", "z", "lone \\\\d", None, None, None, None]
    assert [rows[k].parsed.nodes[0].id if rows[k].ok else None for k in range(len(raws))] == want
    assert all((r.parsed is None) == (not r.ok) for r in rows.values())
    pairs = spark.createDataFrame([("c", "Part One")], "chunk_uuid string, canonical string").withColumn("acronym", F.regexp_replace("canonical", "[^A-Z]", ""))
    found = graph.enrich_synonyms(spark.createDataFrame([("c", "po", ["x"]), ("c", "part one", None)], "chunk_uuid string, id string, synonyms array<string>"), pairs)
    assert {r.id: r.synonyms for r in found.collect()} == {"po": ["x", "Part One"], "part one": ["PO"]}
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_relations_and_formulas_carry_no_texts_through_ranks(spark):
    """Formula texts were sorted with the ranks of all chunks, and each token of each end of an edge was a row: a task's memory grew with both."""
    from docmill.plans.suites import graph as suite

    e = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("b", "r", "a"), ("c", "r", "c"), ("a", "r", "z")], "source string, relation string, target string")
    ents = spark.createDataFrame([("a", "red blue"), ("b", "blue green"), ("c", "red")], "entity_id string, name string")
    t = spark.createDataFrame([(1, "red"), (1, "blue"), (1, "green"), (1, "red"), (2, "green")], "query_id int, token string")
    got = sorted(tuple(r) for r in graph.search_relations(e, ents, t, 3).select("query_id", "rank", "source", "target", "hits").collect())
    assert got == [(1, 1, "a", "b", 3), (1, 2, "b", "a", 3), (1, 3, "a", "z", 2), (2, 1, "a", "b", 1), (2, 2, "b", "a", 1)]
    m = spark.createDataFrame([("c1", x) for x in range(9)] + [("c2", 8), ("c2", 8), ("c3", 77)], "chunk_uuid string, entity_id int")
    f = spark.createDataFrame([(x, f"x{x % 2}", None, "m") for x in range(2, 9)], "formula_id int, latex string, plain string, meaning string")
    s = spark.createDataFrame([(1, "c1"), (2, "c2"), (1, "c1"), (3, "c3")], "query_id int, chunk_uuid string")
    out = graph.attach_formulas(s, m, f)
    assert {r.query_id: r.content for r in out.collect()} == {1: "LaTeX: x0 | Plain:  | Meaning: m\nLaTeX: x1 | Plain:  | Meaning: m", 2: "LaTeX: x0 | Plain:  | Meaning: m"}
    for query in (suite.j13, suite.j11):
        assert "RepartitionByExpression" in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_concepts_meet_where_a_chunk_is(spark, monkeypatch):
    """Each concept of each sentence was a row, written small enough to be broadcast and too large for the driver: A-7 failed by its memory over 0.1 GB."""
    import random
    import re

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "règle", "a", "b"]
    texts = [(i % 280 if i else None, rng.choice([None, "", "Alpha, beta"]) if i % 20 == 0 else "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", ", "]) for _ in range(rng.randrange(1, 20)))) for i in range(300)]
    asks = [(1, "Alpha"), (1, "alpha,"), (1, "beta a"), (1, "gamma"), (1, None), (2, "alpha"), (2, "a b a"), (2, "zebra"), (2, "--"), (3, "règle"), (3, "gamma"), (3, "beta a")]
    graph_split = lambda t: re.split(r"[.;!?][ \n]+|\n", t)
    sources = [(q, rng.randrange(300)) for q in (1, 2, 4) for _ in range(80)]

    def plain(own):
        low = [(n, t) for n, t in texts if t is not None and n is not None]
        lines = {}
        for n, t in low:
            cut = [" ".join("".join(c if c.isalnum() else " " for c in s).split()) for s in graph_split(t.lower())]
            lines.setdefault(n, []).append(cut)
        out = {}
        for q in {q for q, _ in asks}:
            names = sorted({c.lower() for x, c in asks if x == q and c is not None})
            for i, x in enumerate(names):
                for y in names[i + 1 :]:
                    spots = {c: {n: {s for cut in cuts for s, t in enumerate(cut) if c.strip(",-") and f" {c.strip(',-')} " in f" {t} "} for n, cuts in lines.items() if own is None or (q, n) in own} for c in (x, y)}
                    both = [(not spots[x][n] & spots[y][n], n) for n in spots[x] if spots[x][n] and spots[y][n]]
                    out[q, x, y] = ("not_found", 0) if not both else ("weak" if min(both)[0] else "strong", len(both))
        return out

    c = spark.createDataFrame(asks, "query_id long, concept string")
    chunks = spark.createDataFrame(texts, "chunk_uuid long, content string").repartition(5)
    s = spark.createDataFrame(sources, "query_id long, chunk_uuid long")
    for most in (100, 2):
        monkeypatch.setattr(graph, "PAIRS", most)
        for own, known in ((None, None), (set(sources), s)):
            out = graph.concept_cooccurrence(c, chunks, sources=known)
            assert {(r.query_id, r.x, r.y): (r.evidence, r.n_chunks) for r in out.collect()} == plain(own)
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "explode" not in plan and "split(" not in plan
    lines = chunks.where("content is not null").selectExpr("chunk_uuid", "transform(split(lower(content), '[.;!?][ \n]+|\n'), s -> split(s, '[^a-zè]+')) as t")
    schema = StructType([StructField("chunk_uuid", LongType()), *[StructField(x, ArrayType(IntegerType())) for x in "cs"]])
    sent = lines.mapInArrow(scan.concepts_in([(4, ["alpha"]), (9, ["beta", "a"])], to_arrow_schema(schema)), schema).collect()
    assert 0 < len(sent) <= 300 and all(len(r.c) == len(r.s) and set(r.c) <= {4, 9} for r in sent)


def test_entities_need_no_edges_and_synonyms_meet_chunks(spark, monkeypatch):
    """C-2 wrote the edges for the entities too, and shuffled each entity of each chunk to its synonyms: it failed by disk."""
    pairs = spark.createDataFrame([("c", "Part One", "PO"), ("c", "Part Two", "PO"), ("c", "Part One", "PO"), ("c", None, "X"), ("d", "po", None)], "chunk_uuid string, canonical string, acronym string")
    chunks = spark.createDataFrame([("c",), ("d",), ("e",)], "chunk_uuid string")
    rows = {r.chunk_uuid: r.found for r in graph.with_synonyms(chunks, pairs).collect()}
    assert rows == {"c": {"part one": ["PO"], "part two": ["PO"], "po": ["Part One", "Part Two"]}, "d": {}, "e": None}
    one = spark.createDataFrame([(i, c, []) for c in "cde" for i in ("PO", "part ONE", "x")], "id string, chunk_uuid string, synonyms array<string>")
    want = {(r.id, r.chunk_uuid): r.synonyms for r in graph.enrich_synonyms(one, pairs).collect()}
    assert {(r.id, r.chunk_uuid): list((rows[r.chunk_uuid] or {}).get(r.id.lower(), [])) for r in one.collect()} == want
    written = []
    keep = pipelines.stored
    monkeypatch.setattr(pipelines, "stored", lambda df, path: written.append(path.rsplit("/", 1)[1].rsplit("-", 1)[0]) or keep(df, path))
    raw = spark.createDataFrame([(1, 1, '{"nodes": [{"id": "PO"}, {"id": "b"}], "edges": [{"source": "PO", "target": "b"}]}')], "doc_id int, page_no int, raw string")
    canon = spark.createDataFrame([], "raw_relation string, verb string, object string, qualifier string")
    texts = spark.createDataFrame([(1, 1, "c", "f", "Part One (PO) is")], "doc_id int, page_no int, chunk_uuid string, filename string, content string").withColumn("ingestion_ts", F.current_timestamp())
    made = pipelines.build_graph(raw, canon, texts, parts=("entities", "mentions"))
    assert set(made) == {"entities", "mentions"} and written == ["graph-rows"]
    whole = pipelines.build_graph(raw, canon, texts)
    assert set(whole) == set(pipelines.GRAPH) and whole["edges"].count() == 1
    for out in (made, whole):
        assert {r.id: r.synonyms for r in out["entities"].collect()} == {"PO": ["Part One"], "b": []}
