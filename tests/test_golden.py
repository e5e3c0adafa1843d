"""Hand-written rows and properties of single operators."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import chunk, clean, extract, fuse, graph, maintain, query, report, search
from docmill.sources import files


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


@pytest.mark.parametrize(("text", "value"), [("250.000", 250000.0), ("250,5", 250.5), ("250.000,50", 250000.5), ("250,000.50", 250000.5), ("250,000", 250.0), ("12", 12.0), ("1.5", 1.5)])
def test_numbers(spark, text, value):
    assert one(spark, c=text).select(extract.number_value(F.col("c"))).first()[0] == value


@pytest.mark.parametrize("text", ["Multi-Factor Authentication (MFA)", "MFA (Multi-Factor Authentication)"])
def test_acronyms(spark, text):
    rows = extract.extract_acronyms(one(spark, chunk_uuid="c", text=text)).collect()
    assert [(r.canonical, r.acronym) for r in rows] == [("Multi-Factor Authentication", "MFA")]


@pytest.mark.parametrize(("verb", "stem"), [("ESTABLISHE", "ESTABLISH"), ("DISCUSS", "DISCUSS"), ("DISCUS", "DISCU"), ("VISITED", "VISIT"), ("RUNNING", "RUNN"), ("USES", "USES")])
def test_lemma(spark, verb, stem):
    assert one(spark, v=verb).select(graph.lemma(F.col("v"))).first()[0] == stem


def test_relation_names(spark):
    assert [one(spark, v=v).select(graph.safe_relation(F.col("v"))).first()[0] for v in ("BAD REL", "GOOD_REL")] == ["RELATES_TO", "GOOD_REL"]


@pytest.mark.parametrize(("query", "pages"), [("pag 8-9", [8, 9]), ("pagina 8/9", [8, 9]), ("page 10-12", [10, 11, 12]), ("pages 1-90", [1, 90])])
def test_requested_pages(spark, query, pages):
    assert search.query_facets(one(spark, query=query)).first().pages == pages


def test_compound_terms_stay_whole(spark):
    assert "csirt-nx" in search.tokenize_queries(one(spark, query="what is CSIRT-NX about")).first().terms


@pytest.mark.parametrize(("tier", "want"), [("GRAPH", "GRAPH"), ("", "C"), (None, "C"), ("TIER_A_METHODOLOGY", "A"), ("user", "USER"), ("x", "X")])
def test_tiers(spark, tier, want):
    assert clean.normalize_tier(spark.createDataFrame([(tier,)], "tier string")).first().tier == want


@pytest.mark.parametrize(("name", "want"), [("Report_out.pdf", "report"), ("My-File.md", "myfile"), (None, "")])
def test_names(spark, name, want):
    assert clean.normalize_doc_name(spark.createDataFrame([(name,)], "filename string")).first().filename == want


def test_unicode(spark):
    rows = spark.createDataFrame([("ﬁne   日本 text",), (None,), ("x = \x02∑ ½",)], "text string")
    assert [r.text for r in clean.normalize_unicode(rows).collect()] == ["fine text", "", "x = ∑ 1⁄2"]


def test_windows(spark):
    rows = chunk.chunk_fixed(one(spark, doc_id=1, text="".join(chr(97 + i % 26) for i in range(1210)))).orderBy("pos").collect()
    assert [len(r.chunk) for r in rows] == [800, 610, 10]


def test_chunk_types(spark):
    rows = spark.createDataFrame([("formula", 1, "x"), ("text", 1, "x"), (None, None, "a |--- b"), ("chart", None, None)], "toon_type string, image_id long, text string")
    assert [r.chunk_type for r in clean.classify_chunk_type(rows).collect()] == ["formula", "image", "table", "chart"]


def greedy(rows, page, doc, k):
    out, pages, docs = [], {}, {}
    for score, uid, f, p in sorted(rows, key=lambda r: (-r[0], r[1])):
        if len(out) < k and pages.get((f, p), 0) < page and docs.get(f, 0) < doc:
            out.append(uid)
            pages[f, p] = pages.get((f, p), 0) + 1
            docs[f] = docs.get(f, 0) + 1
    return sorted(out)


def test_diversify_is_the_greedy_choice(spark):
    rng = random.Random(1)
    cases = {q: [(rng.randrange(20), f"c{i:02}", f"f{rng.randrange(3)}", rng.randrange(3)) for i in range(rng.randrange(1, 30))] for q in range(120)}
    df = spark.createDataFrame([(q, float(s), u, f, p) for q, rows in cases.items() for s, u, f, p in rows], "query_id long, score double, chunk_uuid string, filename string, page int")
    got = {q: [] for q in cases}
    for r in fuse.diversify(df, 2, 3, 6).collect():
        got[r.query_id].append(r.chunk_uuid)
    assert all(sorted(got[q]) == greedy(rows, 2, 3, 6) for q, rows in cases.items())


def test_packing_is_sequential(spark):
    rng = random.Random(2)
    cases = {q: [(f"h{i}", "x" * rng.randrange(0, 900)) for i in range(rng.randrange(1, 12))] for q in range(100)}
    df = spark.createDataFrame([(q, i, h, c) for q, rows in cases.items() for i, (h, c) in enumerate(rows)], "query_id long, pos int, header string, content string")
    got = {}
    for r in fuse.pack_context(df, 2000).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.body)
    for q, rows in cases.items():
        want, total = [], 0
        for h, c in rows:
            if total + len(h) + len(c) + 2 > 2000:
                room = 2000 - total - len(h) - 50
                if room > 200:
                    want.append(c[:room])
                break
            want.append(c)
            total += len(h) + len(c) + 2
        assert got.get(q, []) == want


def test_rrf_of_two_first_places(spark):
    row = one(spark, query_id=1, chunk_uuid="a", vector_score=0.5, text_score=2.0, graph_score=0.0)
    assert abs(fuse.rrf_fuse(row).first().rrf - 2 / 61) < 1e-12


def test_verdicts(spark):
    rows = [("m", 0.8, 0.7, False, None), ("m", 0.6, 0.9, False, None), ("m", 0.5, 1.0, False, None), ("m", 0.9, 0.9, True, None), ("m", 0.0, 0.0, False, "PASS"), ("m", 7.0, 0.8, False, None)]
    r = report.eval_quality(spark.createDataFrame(rows, "llm_model string, faithfulness double, relevance double, scope_violation boolean, verdict string")).first()
    assert (r.n_pass, r.n_warn, r.n_fail) == (3, 2, 1)


def soft(text, tokens):
    size, overlap, at, out = 4 * tokens, 4 * tokens // 10, 0, []
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            window = text[at:end]
            for mark in ("\n\n", "\n", " "):
                if (p := window.rfind(mark)) > size // 2:
                    end = at + p
                    break
        if piece := text[at:end].strip(" \t\n\r\f"):
            out.append(piece)
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def test_soft_chunks(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "x", "\n", "\n\n", "longerword "]) for _ in range(rng.randrange(0, 200))) for _ in range(60)] + ["", "y" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk.chunk_soft(df, 20).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert all(got.get(i, []) == soft(t, 20) for i, t in enumerate(texts))


def test_recursive_chunks_are_short_and_whole(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "End. ", "\n", "\n\n", "w" * 30]) for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["z" * 5000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk.chunk_recursive(df, 200, 40).orderBy("doc_id", "pos").collect():
        assert len(r.chunk) <= 240
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert all("".join("".join(got[i]).split()) == "".join(t.split()) for i, t in enumerate(texts))


def test_paragraphs_are_packed(spark):
    text = "a" * 300 + "\n\n" + "b" * 300 + "\n\n" + "c" * 300 + "\n\n" + "d" * 1000
    rows = chunk.chunk_paragraphs(one(spark, doc_id=1, text=text)).orderBy("pos").collect()
    assert [len(r.chunk) for r in rows] == [602, 300, 800, 400]


def test_markdown_chunks(spark):
    text = "intro\n# Index\ncontents here\n\n# Policy\n" + "All staff must use strong words. " * 20 + "\n\nshort"
    rows = chunk.chunk_markdown(one(spark, doc_id=1, filename="p.md", text=text)).orderBy("chunk_index").collect()
    assert rows and all(r.chunk.startswith("Doc: p.md | Sezione: ") for r in rows) and not any("Index" in r.chunk for r in rows)


def test_virtual_pages_against_a_plain_loop(spark):
    """Paragraphs take the page of the last mark before them; those over 1,200 characters are cut at 1,000 with 200 of overlap."""
    rng = random.Random(12)
    rows = []
    for d in range(12):
        parts = []
        for i in range(rng.randrange(1, 9)):
            mark = f"# PAGE {rng.randrange(1, 40)}\n" if rng.random() < 0.4 else ""
            parts.append(mark + "".join(rng.choice("abcd ") for _ in range(rng.choice([30, 500, 1200, 1201, 2300]))).strip() + "x")
        rows.append((d, rng.choice(["a.md", None]), "\n\n".join(parts)))
    got = chunk.chunk_markdown_pages(spark.createDataFrame([*rows, (99, "n.md", None)], "doc_id long, filename string, text string"))
    cleaned = {r.doc_id: r.text for r in clean.clean_markdown(spark.createDataFrame(rows, "doc_id long, filename string, text string")).collect()}
    for carry, found in ((True, got), (False, chunk.chunk_markdown_pages(spark.createDataFrame(rows, "doc_id long, filename string, text string"), carry=False))):
        want = []
        for d, name, _ in rows:
            page, n = 1, 0
            for part in [p.strip() for p in re.split(r"\n(?=# PAGE)|\n\n", cleaned[d]) if p.strip()]:
                mark = re.search(r"# PAGE (\d+)", part)
                page = int(mark[1]) if mark else page if carry else 1
                for begin in range(0, len(part), 800) if len(part) > 1200 else (0,):
                    text = " ".join((part[begin : begin + 1000] if len(part) > 1200 else part).split())
                    want.append((d, page, n, text, f"Doc: {name or ''} | Content: {text[:80]}...\n{text}"))
                    n += 1
        assert sorted((r.doc_id, r.page_no, r.chunk_index, r.text, r.chunk) for r in found.collect()) == sorted(want)


def test_best_definitions_keep_terms_without_hits(spark):
    terms = spark.createDataFrame([(1, "MFA", "MFA"), (1, "MFA", "multi-factor"), (1, "RTO", "RTO"), (2, "MFA", "MFA")], "query_id int, term string, alias string")
    hits = spark.createDataFrame([(1, "MFA", "c2", 2), (1, "multi-factor", "c1", 1), (2, "MFA", "c2", 1)], "query_id int, alias string, chunk_uuid string, rank int")
    texts = spark.createDataFrame([("c1", "x\nMulti-factor means two proofs.\nmore", "g.md", 4), ("c2", "MFA: see above", "g.md", 5)], "chunk_uuid string, content string, filename string, page_no int")
    got = {(r.query_id, r.term): (r.page, r.definition, r.found) for r in extract.best_definitions(terms, hits, texts).collect()}
    assert got == {(1, "MFA"): (4, "Multi-factor means two proofs.\nmore", True), (1, "RTO"): (None, None, False), (2, "MFA"): (5, "MFA: see above", True)}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chunk_uuid string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "chunk_uuid string, v int")
    once = maintain.upsert_chunks(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 9), ("b", 3), ("c", 4)] == sorted(map(tuple, maintain.upsert_chunks(once, new).collect()))


def test_inbox_and_sidecars(spark, tmp_path):
    box = tmp_path / "TIER_A_NORMATIVE" / "norm_frameworks_intl"
    box.mkdir(parents=True)
    (box / "a.md").write_text("# T\nx")
    (box / "b.PDF").write_bytes(b"%PDF")
    (box / "c.txt").write_text("no")
    (box / "a.md.meta.json").write_text('{"tier": "B", "ontology": "o"}')
    (box / "b.PDF.meta.json").write_text("{broken")
    found = {r.filename: r for r in files.scan_inbox(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.md", "b.PDF"} and len(found["a.md"].doc_id) == 32
    side = {r.path.rsplit("/", 1)[1]: r for r in files.read_sidecars(spark, str(tmp_path)).collect()}
    assert side["a.md"].tier == "B" and side["b.PDF"].tier is None


def test_broken_json_goes_to_quarantine(spark):
    raws = ['{"nodes": [{"id": "a"}], "edges": []}', 'x ```json\n{"nodes": [{"id": "b"},], "edges": []}\n```', '{"nodes": [{"id": "c"', None, "no json"]
    out = graph.parse_llm_json(spark.createDataFrame(list(enumerate(raws)), "k long, raw string")).orderBy("k").collect()
    assert [r.ok for r in out] == [True, True, False, False, False] and out[1].parsed.nodes[0].id == "b"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunk.chunk_recursive(docs).count() == chunk.chunk_soft(docs).count() == extract.extract_facts(docs).count() == 0
    assert search.text_topk(spark.createDataFrame([], "query_id long, terms array<string>"), search.inverted_index(spark.createDataFrame([], "chunk_uuid string, content string"))).count() == 0


def test_vector_topk_in_blocks(spark):
    rng = np.random.default_rng(4)
    v, q = rng.integers(-3, 4, (90, 4)).astype(float), rng.integers(-3, 4, (7, 4)).astype(float)
    v[5], q[2] = 0, 0  # without direction: no hits
    vectors = spark.createDataFrame([(f"c{i:02d}", x.tolist()) for i, x in enumerate(v)], "chunk_uuid string, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>")
    want = []
    for i, x in enumerate(q):
        if x.any():
            scored = sorted((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 6), f"c{j:02d}") for j, y in enumerate(v) if y.any())
            want += [(i, c, -s, n + 1) for n, (s, c) in enumerate(scored[:9])]
    for blocks in ((200, 8), (1 << 20, 1000)):
        got = search.vector_topk(queries, vectors, 9, *blocks, digits=6).collect()
        assert sorted((r.query_id, r.chunk_uuid, r.score + 0.0, r.rank) for r in got) == sorted(want)
    assert search.vector_topk(queries.limit(0), vectors).count() == 0 == search.vector_topk(queries, vectors.limit(0)).count()


def test_risk_ranking_in_ranges(spark):
    rng = np.random.default_rng(5)
    risks = [float(x) for x in rng.integers(0, 60, 300)]
    rows = [(i, 0.5, 2 * r) for i, r in enumerate(risks)] + [(1000, None, 1.0)]
    got = report.risk_ranking(spark.createDataFrame(rows, "g int, probability double, impact double"), "g", pieces=7).collect()
    assert len(got) == 301
    for r in got:
        assert r.rank == (301 if r.g == 1000 else 1 + sum(x > risks[r.g] for x in risks))
    assert report.risk_ranking(spark.createDataFrame([], "g int, probability double, impact double"), "g").count() == 0


def test_index_of_asked_terms(spark):
    chunks = spark.createDataFrame([("a", "One two two"), ("b", "two three"), ("c", None), ("d", "")], "chunk_uuid string, content string")
    queries = spark.createDataFrame([(1, ["two", "two"]), (2, ["zebra"]), (3, None), (4, ["one", "three"])], "query_id int, terms array<string>")
    whole, part = search.inverted_index(chunks), search.inverted_index(chunks, asked=search.asked_terms(queries))
    assert part.where("term = 'zebra'").count() == 0 and whole.count() == part.count() == 4
    for method in ("count", "bm25"):
        n, mean = search.corpus_size(chunks)
        assert (n, mean) == (4, 2.5)
        found = [sorted(map(tuple, search.text_topk(queries, i, 5, method, n_chunks=n, mean_length=mean, digits=6).collect())) for i in (whole, part)]
        assert found[0] == found[1] and {(r[0], r[1]) for r in found[0]} == {(1, "a"), (1, "b"), (4, "a"), (4, "b")}


@pytest.mark.parametrize(("size", "overlap"), [(8, 2), (8, 0), (8, 6)])
def test_windows_of_code_points(spark, size, overlap):
    texts = [None, "", "a", "é😀\n" * 9, "x" * 8, "y" * 13, "\r\n\u2028z" * 7]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", chunk.windows(F.col("text"), size, overlap).alias("w")).collect()
    for r in rows:
        t = texts[r.k]
        assert r.w == ([t] if not t else [t[b : b + size] for b in range(0, len(t), size - overlap)])


def test_threshold_scan_knows_limits_of_both_languages(spark):
    texts = ["il massimo 5 giorni", "tolleranza di 3 mm", "between 4 and 9", "sla di 24 ore", "maximum 10 users", "up to 7 days", "nothing of 12 here"]
    chunks = spark.createDataFrame([(f"c{i}", t, i) for i, t in enumerate(texts)], "chunk_uuid string, content string, ingestion_ts long")
    assert {r.chunk_uuid for r in search.threshold_scan(chunks).collect()} == {f"c{i}" for i in range(6)}


def packed(pieces, size, sep):
    out, now = [], None
    for p in pieces:
        if now is None:
            now = p
        elif len(now) + len(sep) + len(p) <= size:
            now += sep + p
        else:
            out.append(now)
            now = p
    return out + ([now] if now is not None else [])


def recursive(text, size, slack, seps=("\n\n", "\n", ". ", " ")):
    """A plain recursion over the separators that are left."""
    if len(text) <= size + slack:
        return [text]
    for i, sep in enumerate(seps):
        if sep in text:
            return [x for p in packed(text.split(sep), size, sep) for x in recursive(p, size, slack, seps[i + 1 :])]
    k = 0
    while len(text) / 2**k > size + slack:
        k += 1
    width = -(-len(text) // 2**k)
    return [text[b : b + width] for b in range(0, len(text), width)]


def test_recursive_chunks_against_a_plain_recursion(spark):
    rng = random.Random(14)
    bits = ["word ", "End. ", "\n", "\n\n", "\n\n\n", "w" * 30, " ", "é😀 ", "v" * 300, ". . "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 150))) for _ in range(150)] + [None, "", " \n", "z" * 5000, "\n" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk.chunk_recursive(df, 200, 40).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, t in enumerate(texts):
        want = [c for p in recursive(t or "", 200, 40) if (c := p.strip(" \t\n\r\f"))]
        assert got.get(i, []) == want, t


def test_paragraphs_against_a_plain_loop(spark):
    rng = random.Random(15)
    bits = ["para ", "x" * 50, "\n", "\n\n", "\n \t\n", "é😀", "y" * 130, "\n\n\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(150)] + [None, "", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk.chunk_paragraphs(df, 120, 30).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    import re

    for i, t in enumerate(texts):
        pieces = [p for x in re.split(r"\n[ \t]*\n", t or "") if (p := x.strip(" \t\n\r\f"))]
        want = [c for p in packed(pieces, 120, "\n\n") for c in ([p] if len(p) <= 120 else [p[b : b + 120] for b in range(0, len(p), 90)])]
        assert got.get(i, []) == want, t


def test_chunking_is_linear_in_a_text(spark):
    """Texts of 350,000 and 1.4 million characters through every chunker: a quadratic one takes sixteen times as long for the longer one."""
    import time

    text = "Some words of a line. " * 30 + "\n"
    short, long = (spark.createDataFrame([(1, "p.md", text * n)], "doc_id long, filename string, text string") for n in (530, 2120))
    for fn in (chunk.chunk_paragraphs, chunk.chunk_soft, chunk.chunk_recursive, chunk.chunk_markdown, chunk.chunk_fixed):
        fn(short).count()
        began = time.time()
        fn(short).count()
        middle = time.time()
        assert fn(long).count() > 100
        assert time.time() - middle < 8 * (middle - began) + 10, fn


def test_unicode_against_the_library(spark):
    """NFKC by the standard library, then the two classes of characters that go."""
    import re
    import unicodedata

    rng = random.Random(16)
    bits = ["ﬁ", "½", "Ⅷ", "é", "é", "ｆｕｌｌ", "日本", "∑", "\x02", "\x7f", " \t ", "\n", "risk score", "plain", "ƒ", "ɐ", "😀", "sla", "•"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(300)] + [None]
    math = re.compile(clean.MATH_CONTEXT.replace(r"\s", r"[ \t\n\x0b\f\r]"), re.ASCII | re.IGNORECASE)
    for r in clean.normalize_unicode(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect():
        t = unicodedata.normalize("NFKC", texts[r.k] or "")
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t) if math.search(t) else re.sub("[^\x20-\x7e\xa0-ɏ]+", " ", t)
        assert r.text == re.sub(r"[ \t\n\r\f\x0b]+", " ", t).strip(" "), texts[r.k]


def test_aliases_of_model_output(spark):
    """An id before a name before a label; a type that is a relation on edges and a category on nodes; keys inside texts stay."""
    raw = '{"entities": [{"id": "E1", "name": "Std", "label": "L", "type": "norm", "description": "the \\"type\\": x"}, {"label": "only", "synonyms": "s", "props": {"a": 1, "b": {"c": 2}, "d": [1, 2]}}, {"description": "nameless"}], "relationships": [{"from": "E1", "to": "only", "type": "applies to", "evidence": "p. 3"}, {"source": "E1", "target": "only"}, {"from": "E1"}]}'
    nodes, edges = graph.normalize_graph(graph.parse_llm_json(spark.createDataFrame([(1, 2, raw)], "doc_id long, page_no int, raw string")).where("ok"))
    got = {r.id: r for r in nodes.collect()}
    assert set(got) == {"E1", "only"} and got["E1"].category == "NORM" and got["E1"].description == 'the "type": x'
    assert got["only"].category == "UNCLASSIFIED" and got["only"].synonyms == ["s"] and got["only"].props == {"a": "1", "d": "[1,2]"}
    assert sorted((r.source, r.relation, r.target, r.evidence) for r in edges.collect()) == [("E1", "APPLIES_TO", "only", "p. 3"), ("E1", "RELATED_TO", "only", "")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("relazioni tra MFA, controllo accessi e backup.", ["MFA", "controllo accessi", "backup"]),
        ("relationship between the \"Incident plan\" and NIS2-X using the graph", ["Incident plan", "NIS2-X"]),
        ("from server to database through firewall and proxy.", ["server", "database", "firewall", "proxy"]),
        ("backup strategy overview", ["backup", "strategy", "overview"]),
        ("what about risk", []),
        ("tra a, b, c, d, e1, f, g, h, i e l.", ["a", "b", "c", "d", "e1", "f", "g", "h"]),
    ],
)
def test_graph_concepts(spark, text, want):
    got = one(spark, query=text).select(query.graph_concepts(F.col("query")).alias("c")).first().c
    assert got == want


def test_concepts_under_one_name(spark):
    got = one(spark, query="between MFA and strong login and \"mfa\"").select(query.graph_concepts(F.col("query"), {"strong login": "mfa"}).alias("c")).first().c
    assert got == ["mfa"]
    assert "utenze privilegiate" in one(spark, c="privileged accounts").select(query.concept_variants(F.col("c")).alias("v")).first().v


def test_formula_classes(spark):
    rows = [
        ("cvss", "score = 0.6 * impact", ""), ("x", "x = 12", ""), ("mttd", "MTTD = tempo medio per rilevare", "metrica"), ("m", "MTTR = \\text{mean time}", ""), ("formula recuperata", "$$a^2$$", ""), ("r", "Condizione 2: oltre il 5\\% degli utenti", ""), ("formule collegate", "a = b/c", ""), ("y", "sum of \\frac{a}{b}", ""),
        ("z", "Plain: a = b/c", ""), ("n", "5 %", ""),
    ]
    df = spark.createDataFrame([("d.md", 1, *r) for r in rows], "filename string, page int, name string, formula string, meaning string")
    got = {(r.name, r["class"], r.formula, r.meaning) for r in extract.classify_formula_rows(df).collect()}
    assert got == {
        ("cvss", "computational", "score = 0.6 * impact", ""), ("x", "cited", None, ""), ("MTTD", "definitional", None, "tempo medio per rilevare"), ("MTTR", "definitional", None, "mean time"),
        ("Condizione 2", "threshold", "Condizione 2: oltre il 5% degli utenti", ""), ("y", "computational", "sum of \\fracab", ""), ("z", "cited", None, ""), ("n", "cited", None, ""),
    }


def test_threshold_windows_and_criteria(spark):
    text = "La soglia\nvale oltre\n1,5 milioni di utenti\nnell'Unione"  # no line alone has a word, a number and five words
    assert [r.rule for r in extract.extract_threshold_rules(one(spark, chunk_uuid="c", text=text)).collect()] == ["soglia vale oltre 1,5 milioni di utenti nell'Unione"]
    rule = "Condizione 1: oltre il 5% degli utenti dell'Unione europea oppure over 1 million users"
    row = one(spark, filename="f", page=1, rule=rule)
    r = extract.aggregate_thresholds(row).first()
    assert r.criterion == "oltre il 5% degli utenti nell'Unione oppure oltre 1 milione di utenti nell'Unione" and r.scope.startswith("oltre il 5% degli utenti")


def test_thresholds_are_looked_for(spark):
    """A question about thresholds whose sources have none reads further chunks; others don't."""
    from docmill.plans import pipelines

    queries = spark.createDataFrame([(1, "formula e soglia di notifica incidenti"), (2, "formula of risk")], "query_id long, query string")
    sources = spark.createDataFrame([(q, 1, f"s{q}", "a.md", 1, "text", "risk = a * b", 1.0, "DB") for q in (1, 2)], "query_id long, pos int, id string, filename string, page int, type string, content string, score double, origin string")
    chunks = spark.createDataFrame([("c1", "n.md", 2, "La soglia di notifica vale oltre il 5% degli utenti.", 1), ("c2", "o.md", 1, "nothing", 1)], "chunk_uuid string, filename string, page_no int, content string, ingestion_ts long")
    out = pipelines.formula_report(queries, sources, chunks)
    assert {(r.query_id, r["class"], r.filename) for r in out["rows"].collect()} == {(1, "computational", "a.md"), (2, "computational", "a.md"), (1, "threshold", "n.md")}
    assert [(r.query_id, r.criterion) for r in out["thresholds"].collect()] == [(1, "oltre il 5% degli utenti")]
