"""Queries of fusion, ranking, diversification and packing."""

from pyspark.sql import functions as F

from docmill.operators import fuse
from docmill.plans import fixtures as fx
from docmill.plans.registry import register
from docmill.plans.suites import query as qs
from docmill.plans.suites.search import COSINE

CHANNEL = "(['vector', 'doc_scope', 'phrase', 'text', 'graph', 'expansion'])[cast(l_linenumber % 6 as int) + 1]"


def hits(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 200).alias("query_id"), F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("chunk_uuid"),
        F.expr("element_at(array('vector', 'doc_scope', 'phrase', 'text', 'graph', 'expansion'), cast(l_linenumber % 6 as int) + 1)").alias("channel"), F.col("l_quantity").alias("score"),
        F.concat(F.lit("src"), (F.col("l_partkey") % 5).cast("string"), F.lit(".md")).alias("filename"), (F.col("l_partkey") % 4).cast("int").alias("page"), F.lit("A").alias("tier"),
    )


@register("d1_merge_candidates", f"""with h as (select l_orderkey % 200 as query_id, 'c' || (l_partkey % 40) as chunk_uuid, {CHANNEL} as channel, l_linenumber % 6 as o, l_quantity as score, 'src' || (l_partkey % 5) || '.md' as filename, cast(l_partkey % 4 as int) as page from lineitem),
 o as (select query_id, chunk_uuid, list_sort(list_distinct(list(o))) as os from h group by all)
 select h.query_id, h.chunk_uuid, max(score) filter (channel = 'vector') as vector_score, max(score) filter (channel = 'doc_scope') as doc_scope_score, max(score) filter (channel = 'phrase') as phrase_score, max(score) filter (channel = 'text') as text_score,
 max(score) filter (channel = 'graph') as graph_score, max(score) filter (channel = 'expansion') as expansion_score, min({{'o': o, 'f': filename, 'p': page}}).f as filename, min({{'o': o, 'f': filename, 'p': page}}).p as page, 'A' as tier,
 (select array_to_string(list_transform(os, lambda x: (['vector', 'doc_scope', 'phrase', 'text', 'graph', 'expansion'])[x + 1]), ' + ') from o where o.query_id = h.query_id and o.chunk_uuid = h.chunk_uuid) as provenance from h group by h.query_id, h.chunk_uuid""")
def d1(spark, sf):
    return fuse.merge_candidates(hits(spark, sf))


RRF = f"""{fx.CANDIDATES_SQL}, r as (select *, row_number() over (partition by query_id order by vector_score desc, chunk_uuid) as v, row_number() over (partition by query_id order by text_score desc, chunk_uuid) as t,
 row_number() over (partition by query_id order by graph_score desc, chunk_uuid) as g from cand),
 rrf as (select *, case when vector_score > 0 then 1.0::double / (60 + v) else 0 end + case when text_score > 0 then 1.0::double / (60 + t) else 0 end + case when graph_score > 0 then 1.0::double / (60 + g) else 0 end as rrf from r)"""


@register("w6_rrf", f"with {RRF} select query_id, chunk_uuid, round(rrf, 8) as rrf from rrf")
def w6(spark, sf):
    return fuse.rrf_fuse(fx.candidates(spark, sf)).select("query_id", "chunk_uuid", F.round("rrf", 8).alias("rrf"))


def prepared(df):
    return df.withColumn("rrf", F.round("rrf", 8)).withColumns({"name_hits": F.col("page") * 2, "evidence": F.col("page") == 1, "in_doc": F.col("page") == 2, "on_page": F.col("page") == 3, "intent_type": F.when(F.col("page") == 0, "formula").otherwise("text")})


RANKED = f"""{RRF}, pre as (select query_id, chunk_uuid, filename, page, tier, round(round(rrf, 8) + 0.02 * least(page * 2, 3) + case tier when 'A' then 0.08 when 'B' then 0.04 else case when page = 1 then 0 else -0.015 end end
 + case when page = 2 then 0.2 else 0 end + case when page = 3 then 0.3 else 0 end + case when page = 0 then 0.25 else 0 end, 6) as score from rrf)"""


@register("k8_rank_candidates", f"with {RANKED} select query_id, chunk_uuid, score from pre")
def k8(spark, sf):
    return fuse.rank_candidates(prepared(fuse.rrf_fuse(fx.candidates(spark, sf)))).select("query_id", "chunk_uuid", F.round("score", 6).alias("score"))


@register("w5_diversify", f"""with {fx.CANDIDATES_SQL}, a as (select *, row_number() over (partition by query_id, filename, page order by vector_score desc, chunk_uuid) as n from cand),
 b as (select *, row_number() over (partition by query_id, filename order by vector_score desc, chunk_uuid) as m from a where n <= 1), c as (select *, row_number() over (partition by query_id order by vector_score desc, chunk_uuid) as o from b where m <= 2)
 select query_id, chunk_uuid from c where o <= 4""")
def w5(spark, sf):
    return fuse.diversify(fx.candidates(spark, sf).withColumn("score", F.col("vector_score")), 1, 2, 4).select("query_id", "chunk_uuid")


@register("w4_limit_per_group", f"with {fx.CANDIDATES_SQL} select filename, page, chunk_uuid, query_id from (select *, row_number() over (partition by filename, page order by text_score desc, chunk_uuid, query_id) as n from cand) where n <= 6")
def w4(spark, sf):
    return fuse.limit_per_group(fx.candidates(spark, sf), ["filename", "page"], [F.desc("text_score"), F.col("chunk_uuid"), F.col("query_id")], 6).select("filename", "page", "chunk_uuid", "query_id")


@register("j2_enrich", f"""with {fx.CHUNKS_SQL}, v as (select * from (select *, row_number() over (partition by chunk_uuid order by ingestion_ts desc, content) as n from chunks) where n = 1),
 k as (select l_orderkey as query_id, l_linenumber as ln, l_partkey || '_' || (l_linenumber % 3) as chunk_uuid, case when l_suppkey % 2 = 0 then 'given.md' else '' end as filename, case when l_suppkey % 3 = 0 then 0 else 7 end as page from lineitem)
 select query_id, ln, k.chunk_uuid, case when k.filename = '' then coalesce(v.filename, '') else k.filename end as filename, case when page = 0 then coalesce(v.page_no, 0) else page end as page, content from k left join v using (chunk_uuid)""")
def j2(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("ln"), F.concat_ws("_", F.col("l_partkey").cast("string"), (F.col("l_linenumber") % 3).cast("string")).alias("chunk_uuid"), F.when(F.col("l_suppkey") % 2 == 0, "given.md").otherwise("").alias("filename"), F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(7).alias("page"))
    return fuse.enrich_candidates(c, fx.chunks(spark, sf))


SRC = """src as (select l_orderkey % 100 as query_id, row_number() over (partition by l_orderkey % 100 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos, case when l_partkey % 3 = 0 then '' else 'id' || (l_partkey % 30) end as id,
 case when l_suppkey % 4 = 0 then '' else 'Doc' || (l_suppkey % 4) || '.md' end as filename, cast(l_linenumber % 3 as int) as page, 'text' as type, 'body ' || (l_partkey % 9) || repeat('x', cast(l_quantity as int)) as content, l_extendedprice as score,
 (['DB', 'GRAPH', 'TEXT'])[cast(l_linenumber % 3 as int) + 1] as origin from lineitem)"""


def sources(spark, sf):
    from pyspark.sql import Window

    li = fx.table(spark, sf, "lineitem").withColumn("query_id", F.col("l_orderkey") % 100)
    return li.select(
        "query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long").alias("pos"), F.expr("case when l_partkey % 3 = 0 then '' else 'id' || (l_partkey % 30) end").alias("id"),
        F.expr("case when l_suppkey % 4 = 0 then '' else 'Doc' || (l_suppkey % 4) || '.md' end").alias("filename"), F.expr("cast(l_linenumber % 3 as int)").alias("page"), F.lit("text").alias("type"),
        F.expr("'body ' || (l_partkey % 9) || repeat('x', cast(l_quantity as int))").alias("content"), F.col("l_extendedprice").alias("score"), F.expr("element_at(array('DB', 'GRAPH', 'TEXT'), cast(l_linenumber % 3 as int) + 1)").alias("origin"),
    )


@register("d2_dedupe_sources", f"""with {SRC}, k as (select *, case when id != '' then 'id:' || id else 'content|' || regexp_replace(regexp_replace(lower(filename), '\\.md$', ''), '[^a-z0-9]+', '', 'g') || '|' || page || '|' || type || '|' || lower(content) end as key from src)
 select query_id, min(pos) as pos, arg_min(id, pos) as id, arg_min(filename, pos) filter (filename != '') as filename, arg_min(page, pos) filter (page != 0) as page, arg_min(type, pos) as type, arg_max(content, {{'n': length(content), 'p': -pos}}) as content, max(score) as score,
 array_to_string(list_sort(list_distinct(list(origin))), ' + ') as origin from k group by query_id, key""")
def d2(spark, sf):
    return fuse.dedupe_sources(sources(spark, sf))


@register("d3_compact_sources", f"""with {SRC}, k as (select *, case when origin = 'GRAPH' then 'id:' || id else regexp_replace(regexp_replace(lower(filename), '\\.md$', ''), '[^a-z0-9]+', '', 'g') || '|' || page || '|' || type end as key from src)
 select query_id, pos, id, score from (select *, row_number() over (partition by query_id, key order by score desc, pos) as n from k) where n = 1""")
def d3(spark, sf):
    return fuse.compact_sources(sources(spark, sf)).select("query_id", "pos", "id", "score")


@register("w7_pack_context", f"""with {SRC}, h as (select query_id, pos, '[' || pos || ']' as header, repeat(content, 10) as content from src),
 b as (select *, coalesce(sum(length(header) + length(content) + 2) over (partition by query_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from h),
 f as (select *, before + length(header) + length(content) + 2 <= 16000 as fits, 16000 - before - length(header) - 50 as room from b)
 select query_id, pos, case when fits then content else left(content, cast(room as int)) end as body from f where before <= 16000 and (fits or room > 200)""")
def w7(spark, sf):
    s = sources(spark, sf).select("query_id", "pos", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("header"), F.repeat("content", F.lit(10)).alias("content"))
    return fuse.pack_context(s).select("query_id", "pos", "body")


@register("x22_tier_contexts", f"""with {SRC}, n as (select query_id, origin as tier, pos, '[' || row_number() over (partition by query_id, origin order by pos) || '] ' || content as line from src)
 select query_id, tier, string_agg(line, chr(10) order by pos) as context from n group by all""")
def x22(spark, sf):
    return fuse.tier_contexts(sources(spark, sf).withColumnRenamed("origin", "tier"))


@register("d9_force_tier_a", f"""with {SRC}, s as (select query_id, pos, case when query_id % 5 = 0 then 'A' else 'B' end as tier, content from src),
 a as (select query_id, pos as rank, 'norm ' || content as content from src), l as (select distinct query_id from s where query_id % 2 = 0 and query_id % 5 != 0)
 select query_id, pos, tier, content from s union all select query_id, 0, 'A', string_agg(content, chr(10) order by rank) from a where query_id in (select query_id from l) group by query_id""")
def d9(spark, sf):
    src = sources(spark, sf)
    s = src.select("query_id", F.col("pos").cast("int").alias("pos"), F.when(F.col("query_id") % 5 == 0, "A").otherwise("B").alias("tier"), "content")
    q = src.select("query_id").distinct().withColumn("audit", F.col("query_id") % 2 == 0)
    return fuse.force_tier_a(s, q, src.select("query_id", F.col("pos").alias("rank"), F.concat(F.lit("norm "), "content").alias("content")))


#: What is asked in front of an item's text: two questions for tier A, one of them a checklist, and one for none.
NORM_ASKS = ["which obligations of the directive hold for ", "checklist and crosswalk of the controls of ", ""]
NORM_QUERY = f"(array[{', '.join(qs.quoted(a) for a in NORM_ASKS)}])[cast(item_id % 3 as int) + 1] || text"


@register("d9_search_tier_a", f"""with qn as (select item_id as query_id, {NORM_QUERY} as query, embedding from benchmark join embeddings on vec_id = item_id), ro as ({qs.routes_sql('qn', 'query_id, embedding')}),
 s as (select item_id as query_id, p as pos, case when item_id % 5 = 0 and p = 2 then 'a' else 'B' end as tier, text as content from benchmark, unnest([1, 2]) as t(p)), la as (select query_id, embedding from ro where is_tier_a and not is_checklist and query_id % 5 != 0),
 sc as (select query_id, v.vec_id, round({COSINE}, 6) as score from la q, embeddings v where v.vec_id % 3 = 0), h as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id::varchar || '_0') as r from sc) where r <= 15)
 select query_id, pos, tier, content from s union all select query_id, 0, 'A', string_agg('norm ' || vec_id, chr(10) order by r) from h where vec_id % 7 != 0 group by query_id""")
def d9s(spark, sf):
    b, e = fx.table(spark, sf, "benchmark"), fx.table(spark, sf, "embeddings")
    asks = F.element_at(F.array(*map(F.lit, NORM_ASKS)), (F.col("item_id") % 3).cast("int") + 1)
    q = b.join(e, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.concat(asks, "text").alias("query"), "embedding")
    s = b.select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), F.col("text").alias("content"))
    s = s.withColumn("tier", F.when((F.col("query_id") % 5 == 0) & (F.col("pos") == 2), "a").otherwise("B"))
    chunk = F.concat(F.col("vec_id").cast("string"), F.lit("_0")).alias("chunk_uuid")
    v = e.select(chunk, "embedding", F.when(F.col("vec_id") % 3 == 0, "A").otherwise("B").alias("tier"))
    texts = e.select(chunk, F.when(F.col("vec_id") % 7 == 0, " ").otherwise(F.concat(F.lit("norm "), F.col("vec_id").cast("string"))).alias("content"))
    return fuse.search_tier_a(s, q, v, texts, digits=6)


@register("a6_tier_distribution", f"""with {fx.CANDIDATES_SQL}, t as (select *, case when page = 3 then 'GRAPH' else tier end as t from cand), c as (select l_orderkey as query_id, {", ".join(f"count(*) filter (l_linenumber % 6 = {i}) as {c}_hits" for i, c in enumerate(fuse.CHANNELS))} from lineitem group by 1)
 select query_id, count(*) filter (t = 'A') as n_a, count(*) filter (t = 'B') as n_b, count(*) filter (t = 'C') as n_c, count(*) filter (t = 'GRAPH') as n_graph, count(*) filter (t = 'USER') as n_user, count(*) as n,
 min(vector_score) as min_score, max(vector_score) as max_score, floor(avg(vector_score) * 100 + 0.001) / 100 as avg_score, {", ".join(f"any_value({c}_hits) as {c}_hits" for c in fuse.CHANNELS)} from t join c using (query_id) group by query_id""")
def a6(spark, sf):
    c = fx.candidates(spark, sf).withColumn("score", F.col("vector_score")).withColumn("tier", F.when(F.col("page") == 3, "GRAPH").otherwise(F.col("tier")))
    h = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.element_at(F.array(*map(F.lit, fuse.CHANNELS)), (F.col("l_linenumber") % 6).cast("int") + 1).alias("channel"))
    return fuse.tier_distribution(c, h).withColumn("avg_score", F.floor(F.col("avg_score") * 100 + 0.001) / 100)


@register("w8_tail_turns", """with s as (select * from conversations where role in ('user', 'assistant') and trim(coalesce(text, '')) != ''), l as (select * from (select *, lead(role) over (partition by conv_id order by turn) as nx from s) where nx is null or nx != role),
 t as (select * from (select *, row_number() over (partition by conv_id order by turn desc) as n from l) where n <= 6), f as (select *, row_number() over (partition by conv_id order by turn) as m from t)
 select conv_id, turn, role, text from f where not (m = 1 and role = 'assistant')""")
def w8(spark, sf):
    return fuse.tail_turns(fx.table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")
