"""Queries of the retrieval channels."""

from pyspark.sql import functions as F

from docmill.functions import lexicons as L
from docmill.operators import index, search, vectors
from docmill.operators.clean import whole_words
from docmill.plans import fixtures as fx
from docmill.plans.registry import register
from docmill.sources import files
from docmill.sources.shared import new_folder


@register("w1_latest_versions", f"with {fx.CHUNKS_SQL} select chunk_uuid, content, cast(epoch_us(ingestion_ts) as bigint) as us from (select *, row_number() over (partition by chunk_uuid order by ingestion_ts desc, content) as n from chunks) where n = 1")
def w1(spark, sf):
    return search.latest_versions(fx.chunks(spark, sf)).select("chunk_uuid", "content", F.unix_micros("ingestion_ts").alias("us"))


@register("w1_latest_bucketed", f"with {fx.CHUNKS_SQL} select chunk_uuid, content, cast(epoch_us(ingestion_ts) as bigint) as us from (select *, row_number() over (partition by chunk_uuid order by ingestion_ts desc, content) as n from chunks) where n = 1")
def w1b(spark, sf):
    path = new_folder(spark, "bucketed")
    t = files.write_bucketed(fx.chunks(spark, sf), path.rsplit("/", 1)[1].replace("-", "_"), path, 16)
    return search.latest_bucketed(t).select("chunk_uuid", "content", F.unix_micros("ingestion_ts").alias("us"))


STOPS = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
QUESTION = "'Explain the MFA and KPI9 of ' || text || ' on page 3-' || (item_id % 7 + 3) || ', pag 12'"
TOKENS = """list_distinct(list_transform(list_filter(regexp_extract_all({q}, '[A-Za-zÀ-ÿ0-9_-]+'), lambda t: (upper(t) = t and length(t) between 2 and 10) or (regexp_matches(t, '^[A-Za-z]{{1,5}}[0-9]{{0,3}}$') and length(t) between 2 and 10) or length(t) > 3), lambda t: lower(t)))"""


@register("x18_query_tokens", f"""with t as (select item_id as query_id, list_sort({TOKENS.format(q=QUESTION)}) as t from benchmark)
 select query_id, array_to_string(t, ' ') as tokens, array_to_string(list_filter(t, lambda x: x not in ({STOPS})), ' ') as terms from t""")
def x18(spark, sf):
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(QUESTION).alias("query"))
    out = search.tokenize_queries(b)
    return out.select("query_id", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), F.array_join(F.array_sort("terms"), " ").alias("terms"))


FACETED = "'see page 3-' || (item_id % 7 + 4) || ' and \"exact ' || item_id || '\" in MFA and NIST, pagina 90/120'"


@register("x19_query_facets", """select item_id as query_id, array_to_string(list_sort(list_distinct(list_concat(range(3, item_id % 7 + 5), [90, 120]))), ',') as pages, 'exact ' || item_id as phrases, 'MFA NIST' as acronyms from benchmark""")
def x19(spark, sf):
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(FACETED).alias("query"))
    out = search.query_facets(b)
    return out.select("query_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("phrases", "|").alias("phrases"), F.array_join("acronyms", " ").alias("acronyms"))


RULES = [("audit", "thth|then|ment"), ("formula", "ou|the"), ("graph", "un|eux"), ("glossary", "der|la")]
FLAG = {n: f"regexp_matches(q, '{whole_words(t)}')" for n, t in RULES}


@register("x20_query_classes", f"""with q as (select doc_id, lower(coalesce(text, '')) as q from documents), f as (select doc_id, length(q) as n, {", ".join(f"{v} as is_{k}" for k, v in FLAG.items())} from q)
 select doc_id, is_audit, is_formula, is_graph, is_glossary, case when is_audit then 'audit' when is_formula then 'formula' when is_graph then 'graph' when is_glossary then 'glossary' else 'text' end as intent,
 cast(case when n > 300 or is_graph or is_glossary then 140 else 100 end as int) as vector_k, cast(case when n > 300 or is_graph or is_glossary then 15 else 8 end as int) as final_k from f""")
def x20(spark, sf):
    out = search.classify_queries(fx.table(spark, sf, "documents").withColumnRenamed("text", "query"), RULES)
    return out.select("doc_id", "is_audit", "is_formula", "is_graph", "is_glossary", "intent", "vector_k", "final_k")


CUES = [("the", "article"), ("the", "determiner"), ("ment", "noun"), ("ou", "or"), ("zqx", "none")]


@register("j12_expand_tokens", "select distinct doc_id as query_id, token from documents, (values ('the', 'article'), ('the', 'determiner'), ('ment', 'noun'), ('ou', 'or'), ('zqx', 'none')) as c(cue, token) where contains(lower(text), cue)")
def j12(spark, sf):
    q = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return search.expand_tokens(q, CUES)


#: The newest version of each chunk, which an index holds.
NEWEST = "(select * from (select *, row_number() over (partition by chunk_uuid order by ingestion_ts desc) as newest from chunks) where newest = 1)"
WORDS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != '')"
INDEX = f"""w as (select chunk_uuid, {WORDS.format(c='content')} as w from c1), i0 as (select chunk_uuid, len(w) as length, unnest(w) as term from w), idx as (select term, chunk_uuid, length, count(*) as tf from i0 group by all)"""
ASKED = f"""{fx.ASKED_SQL}, terms as (select distinct query_id, unnest({WORDS.format(c='query')}) as term from asked)"""


def one_version(spark, sf):
    return fx.chunks(spark, sf).where(~F.col("content").endswith(" (rev)"))


def asked_terms(spark, sf):
    return fx.asked(spark, sf).withColumn("terms", search.words(F.col("query")))


@register("k3_text_topk", f"""with {fx.CHUNKS_SQL}, {INDEX}, {ASKED}, s as (select query_id, chunk_uuid, cast(sum(tf) as bigint) * 0.1::double as score from idx join terms using (term) group by all)
 select query_id, chunk_uuid, round(score, 6) as score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_uuid) as rank from s) where rank <= 60""")
def k3(spark, sf):
    held = one_version(spark, sf).select("chunk_uuid", search.words(F.col("content")).alias("w"))
    return index.best_texts(asked_terms(spark, sf), held, digits=6)


@register("k3_text_indexed", f"""with {fx.CHUNKS_SQL}, newest as {NEWEST}, {INDEX.replace("from c1)", "from newest)")}, {ASKED}, s as (select query_id, chunk_uuid, cast(sum(tf) as bigint) * 0.1::double as score from idx join terms using (term) group by all)
 select query_id, chunk_uuid, round(score, 6) as score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_uuid) as rank from s) where rank <= 60""")
def k3_indexed(spark, sf):
    return index.text_search(asked_terms(spark, sf), fx.text_index(spark, sf), digits=6)


@register("k3_bm25_topk", f"""with {fx.CHUNKS_SQL}, {INDEX}, {ASKED}, df as (select term, count(*) as df from idx group by term), m as (select avg(length) as mean from (select distinct chunk_uuid, length from idx)), n as (select count(*) as n from c1),
 s as (select query_id, chunk_uuid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from idx join terms using (term) join df using (term), m, n group by all)
 select query_id, chunk_uuid, round(score, 5) as score from (select *, row_number() over (partition by query_id order by round(score, 5) desc, chunk_uuid) as rank from s) where rank <= 20""")
def k3b(spark, sf):
    c, q = one_version(spark, sf), asked_terms(spark, sf)
    n, mean = search.corpus_size(c)
    held = c.select("chunk_uuid", search.words(F.col("content")).alias("w"))
    return index.best_texts(q, held, 20, "bm25", n, mean, 5).drop("rank")


#: Phrases of an item: every third word of its whole text with the two after it.
PHRASE_SQL = "p as (select distinct query_id, phrase from (select *, row_number() over (partition by query_id order by phrase) as pn from (select distinct item_id as query_id, lower(array_to_string(w[i:i + 2], ' ')) as phrase from (select item_id, w, unnest(range(2, len(w), 3)) as i from (select item_id, string_split(text, ' ') as w from benchmark)))) where pn <= 12)"
K4_SQL = f"""with {fx.CHUNKS_SQL}, {PHRASE_SQL}, pw as (select *, (list_sort(list_filter({WORDS.format(c='phrase')}, lambda x: length(x) = list_max(list_transform({WORDS.format(c='phrase')}, lambda y: length(y))))))[1] as main from p),
 cw as (select chunk_uuid, ingestion_ts, lower(content) as low, unnest(list_distinct({WORDS.format(c='content')})) as main from SOME_CHUNKS),
 h as (select distinct query_id, chunk_uuid, ingestion_ts from cw join pw using (main) where contains(low, phrase))
 select query_id, chunk_uuid, 2.0::double as score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by ingestion_ts desc, chunk_uuid) as rank from h) where rank <= 40"""


def phrases(spark, sf):
    cut = F.expr("explode(transform(filter(sequence(2, greatest(2, size(w)), 3), i -> i < size(w)), i -> array_join(slice(w, i, 3), ' ')))")
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", " ").alias("w")).select("query_id", cut.alias("phrase"))


@register("k4_phrase_topk", K4_SQL.replace("SOME_CHUNKS", "chunks"))
def k4(spark, sf):
    return search.phrase_topk(phrases(spark, sf), fx.chunks(spark, sf))


#: Aliases of an item: its first words, and two of them in capitals, as acronyms are.
ALIAS_SQL = "t as (select distinct item_id as query_id, unnest([string_split(text, ' ')[1], string_split(text, ' ')[2], string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[4], upper(replace(string_split(text, ' ')[2], 'ß', 'ss')), upper(replace(string_split(text, ' ')[5], 'ß', 'ss'))]) as alias from benchmark)"
K5_SQL = f"""with {fx.CHUNKS_SQL}, {ALIAS_SQL}, g as (select * from SOME_CHUNKS where contains(lower(filename), 'src3')),
 h as (select distinct query_id, alias, chunk_uuid, ingestion_ts from g join t on alias != '' and contains(lower(content), lower(alias)) and (not regexp_matches(alias, '^[A-Z0-9]{{2,8}}$') or regexp_matches(content, '(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)')))
 select query_id, alias, chunk_uuid, cast(rank as int) as rank from (select *, row_number() over (partition by query_id, alias order by ingestion_ts desc, chunk_uuid) as rank from h) where rank <= 2"""


def aliases(spark, sf):
    w = "split(text, ' ')"
    each = F.expr(f"explode(array(get({w}, 0), get({w}, 1), get({w}, 2) || ' ' || get({w}, 3), upper(replace(get({w}, 1), 'ß', 'ss')), upper(replace(get({w}, 4), 'ß', 'ss'))))")
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), each.alias("alias")).where("alias is not null").distinct()


@register("k4_phrase_indexed", K4_SQL.replace("SOME_CHUNKS", NEWEST))
def k4_indexed(spark, sf):
    return index.phrase_search(phrases(spark, sf), fx.text_index(spark, sf), longest="chunk")


@register("k5_glossary_topk", K5_SQL.replace("SOME_CHUNKS", "chunks"))
def k5(spark, sf):
    return search.glossary_topk(aliases(spark, sf), fx.chunks(spark, sf), "src3", 2).drop("score")


@register("k5_glossary_indexed", K5_SQL.replace("SOME_CHUNKS", NEWEST))
def k5_indexed(spark, sf):
    return index.glossary_search(aliases(spark, sf), fx.text_index(spark, sf), "src3", 2).drop("score")


NORM = "regexp_replace(regexp_replace(lower({c}), '\\.(pdf|md)$', ''), '[^a-z0-9]+', '', 'g')"


@register("k6_doc_scope_topk", f"""with {fx.CHUNKS_SQL}, {INDEX}, q as (select doc_id as query_id, {NORM.format(c="source || '_' || doc_id || '.pdf'")} as want, list_distinct({WORDS.format(c='text')}) as terms from documents),
 n as (select distinct filename, {NORM.format(c='filename')} as name from c1), fi as (select query_id, filename from q join n on contains(name, want) or contains(want, name)),
 t as (select query_id, unnest(terms) as term from q), v as (select * from (select *, row_number() over (partition by chunk_uuid order by ingestion_ts desc) as n from chunks) where n = 1), r as (select query_id, v.chunk_uuid, ingestion_ts from fi join v using (filename)),
 s as (select r.query_id, r.chunk_uuid, sum(tf) * 0.1::double as score from r join idx using (chunk_uuid) join t on t.query_id = r.query_id and t.term = idx.term group by all),
 j as (select r.query_id, r.chunk_uuid, r.ingestion_ts, round(coalesce(s.score, 0.001), 6) as score from r left join s on s.query_id = r.query_id and s.chunk_uuid = r.chunk_uuid)
 select query_id, chunk_uuid, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, ingestion_ts desc, chunk_uuid) as rank from j) where rank <= 80""")
def k6(spark, sf):
    d = fx.documents(spark, sf).select(F.col("doc_id").alias("query_id"), F.concat_ws("", "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("active_doc"), F.array_distinct(search.words(F.col("text"))).alias("terms"))
    c = fx.chunks(spark, sf)
    words = one_version(spark, sf).select("chunk_uuid", "filename", search.words(F.col("content")).alias("w"))
    return search.doc_scope_topk(d, c, lambda ids: words).withColumn("score", F.round("score", 6))


SCAN = "(?i)(^|[^\\p{L}\\p{N}_])(over|the|of)[^\\p{L}\\p{N}_].{0,60}[0-9]"


@register("k7_threshold_scan", f"with {fx.CHUNKS_SQL} select chunk_uuid, 2.5::double as score from chunks where regexp_matches(content, '{SCAN}') order by ingestion_ts desc, chunk_uuid limit 12")
def k7(spark, sf):
    return search.threshold_scan(fx.chunks(spark, sf), ["over", "the", "of"])


COSINE = "list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))"


def topk_sql(extra: str, k: int) -> str:
    return f"""with s as (select q.vec_id as query_id, v.vec_id as chunk_uuid, round({COSINE}, 6) as score from embeddings q, embeddings v where q.vec_id % 50 = 0 {extra})
 select query_id, chunk_uuid, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_uuid) as rank from s) where rank <= {k}"""


def embedded(spark, sf):
    """Queries and vectors; of every third vector there are copies that must not be found: without its last entry, with NaN, with a null, as zeros."""
    e = fx.table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_uuid"), "embedding", F.expr("element_at(array('A', 'B', 'C'), cast(vec_id % 3 as int) + 1)").alias("tier"))
    first = lambda x: f"transform(embedding, (x, i) -> if(i = 0, cast({x} as float), x))"
    bad = v.where("chunk_uuid % 3 = 0").withColumn("bad", F.expr(f"array(slice(embedding, 1, size(embedding) - 1), {first("'NaN'")}, {first('null')}, transform(embedding, x -> float(0)), null)"))
    bad = bad.select("chunk_uuid", F.posexplode("bad").alias("n", "embedding"), "tier").select((-1 - F.col("chunk_uuid") * 5 - F.col("n")).alias("chunk_uuid"), "embedding", "tier")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.unionByName(bad)


@register("k1_vector_topk", topk_sql("", 100))
def k1(spark, sf):
    return search.vector_topk(*embedded(spark, sf), 100, digits=6)


@register("k2_vector_topk_tier", topk_sql("and v.vec_id % 3 = 0", 15))
def k2(spark, sf):
    return search.vector_topk_filtered(*embedded(spark, sf), "A", 15, digits=6)


@register("k1_vector_indexed")
def k1_indexed(spark, sf):
    q, v = embedded(spark, sf)
    made = vectors.build_index(v)
    return vectors.search(made, q, 100, vectors.probes_for(made, 100), digits=6)


@register("k1_vector_all_cells", topk_sql("", 100))
def k1_all_cells(spark, sf):
    q, v = embedded(spark, sf)
    made = vectors.build_index(v)
    return vectors.search(made, q, 100, made.cells, digits=6)


@register("j15_fetch_chunks", f"with {fx.CHUNKS_SQL} select chunk_uuid, trim(content) as payload_text from c1 where trim(content) != ''")
def j15(spark, sf):
    c = one_version(spark, sf)
    return search.fetch_chunks_by_id(c, c.select("chunk_uuid")).select("chunk_uuid", "payload_text")
