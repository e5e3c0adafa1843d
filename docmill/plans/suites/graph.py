"""Queries of the entity and relation operators."""

from pyspark.sql import functions as F

from docmill.operators import graph
from docmill.plans import fixtures as fx
from docmill.plans.registry import register
from docmill.plans.suites.search import one_version

RAW_SQL = """g as (select l_orderkey as doc_id, cast(l_orderkey % 5 as int) as page_no, list({'s': 'S' || l_suppkey, 'r': 'rel ' || l_returnflag || '-' || l_linestatus, 't': 'P' || l_partkey} order by l_linenumber, l_partkey, l_suppkey) as e from lineitem group by 1, 2)"""


def raw_json(spark, sf):
    """Model output: one JSON text for each order, under every alias of its fields; some fenced, some with a trailing comma, some cut off."""
    li = fx.table(spark, sf, "lineitem")
    row = F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("rel "), "l_returnflag", F.lit("-"), "l_linestatus").alias("r"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("t"))
    rows = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("e")))), lambda x: x["e"]).alias("e"))
    each = lambda **f: F.transform("e", lambda e: F.struct(*[v(e).alias(k) for k, v in f.items()]))
    k = F.col("doc_id")
    first = F.struct(
        each(id=lambda e: e["s"], category=lambda e: F.lit("supplier"), description=lambda e: F.lit(" d, \"type\": x "), formula=lambda e: F.concat(F.lit("f"), (k % 5).cast("string")), synonyms=lambda e: F.array(F.lit("s1"), F.lit(" "), F.lit("s2"))).alias("nodes"),
        each(source=lambda e: e["s"], relation=lambda e: e["r"], target=lambda e: e["t"], evidence=lambda e: F.lit("seen")).alias("edges"),
    )
    second = F.struct(
        each(name=lambda e: e["s"], type=lambda e: F.lit("supplier"), synonyms=lambda e: F.lit("one")).alias("entities"),
        each(**{"from": lambda e: e["s"], "type": lambda e: e["r"], "to": lambda e: e["t"], "props": lambda e: F.create_map(F.lit("w"), F.lit(1))}).alias("relationships"),
    )
    third = F.struct(each(label=lambda e: e["s"], properties=lambda e: F.create_map(F.lit("k"), F.lit("v"))).alias("entities"), each(**{"from": lambda e: e["s"], "to": lambda e: e["t"]}).alias("relationships"))
    text = F.when(k % 3 == 0, F.to_json(first)).when(k % 3 == 1, F.to_json(second)).otherwise(F.to_json(third))
    broken = F.when(k % 13 == 0, F.substring(text, F.lit(1), F.char_length(text) - 5)).when(k % 11 == 0, F.regexp_replace(text, r"\]\}$", ",]}")).when(k % 7 == 0, F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```"))).otherwise(text)
    return rows.select("doc_id", (k % 5).cast("int").alias("page_no"), broken.alias("raw"))


def parsed(spark, sf):
    return graph.parse_llm_json(raw_json(spark, sf))


@register("x13_parse_json", "select distinct l_orderkey as doc_id, l_orderkey % 13 != 0 as ok from lineitem")
def x13(spark, sf):
    return parsed(spark, sf).select("doc_id", "ok")


EDGES = f"""{RAW_SQL}, x as (select doc_id, page_no, unnest(e) as e, cast(generate_subscripts(e, 1) - 1 as int) as pos from g where doc_id % 13 != 0), ed as (select doc_id, page_no, pos, e.s as source, case when doc_id % 3 = 2 then 'RELATED_TO' else upper(replace(replace(e.r, ' ', '_'), '-', '_')) end as relation, e.t as target from x)"""


def joined(props):
    return F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@register("x14_graph_edges", f"with {EDGES} select doc_id, page_no, pos, source, relation, target, case when doc_id % 3 = 0 then 'seen' else '' end as evidence, case when doc_id % 3 = 1 then 'w=1' else '' end as props from ed")
def x14(spark, sf):
    return graph.normalize_graph(parsed(spark, sf).where("ok"))[1].withColumn("props", joined("props"))


@register("x14_graph_nodes", f"""with {EDGES} select doc_id, page_no, pos, source as id, case when doc_id % 3 = 2 then 'UNCLASSIFIED' else 'SUPPLIER' end as category, case when doc_id % 3 = 0 then 'd, "type": x' else '' end as description,
 case when doc_id % 3 = 0 then 'f' || (doc_id % 5) else '' end as formula, (['s1,s2', 'one', ''])[cast(doc_id % 3 as int) + 1] as synonyms, case when doc_id % 3 = 2 then 'k=v' else '' end as props from ed""")
def x14n(spark, sf):
    return graph.normalize_graph(parsed(spark, sf).where("ok"))[0].withColumn("props", joined("props")).withColumn("synonyms", F.array_join("synonyms", ","))


@register("d7_sanitize_nodes", f"with {EDGES} select doc_id, page_no, pos, id, case when doc_id % 3 = 2 then 'UNCLASSIFIED' else 'SUPPLIER' end as category from (select doc_id, page_no, min(pos) as pos, source as id, row_number() over (partition by doc_id, page_no order by min(pos)) as n from ed group by doc_id, page_no, source) where n <= 3")
def d7n(spark, sf):
    return graph.sanitize_graph(*graph.normalize_graph(parsed(spark, sf).where("ok")), 3, 2)[0].select("doc_id", "page_no", "pos", "id", "category")


@register("d7_sanitize_edges", f"with {EDGES} select doc_id, page_no, pos, source, relation, target from ed where pos < 2")
def d7e(spark, sf):
    return graph.sanitize_graph(*graph.normalize_graph(parsed(spark, sf).where("ok")), 3, 2)[1].select("doc_id", "page_no", "pos", "source", "relation", "target")


@register("x15_formula_json", """with f as (select p_partkey as doc_id, p_size % 4 as page_no, 'x' || (p_size % 7) || ' + y' as latex, p_size % 3 = 0 as told, p_name from part), n as (select *, 'Formula::P' || page_no || '::' || left(sha256(latex), 10) as id from f)
 select doc_id, page_no, id, 'FORMULA' as category, case when told then 'sum of ' || p_name else 'Formula 1' end as description, latex as formula from n
 union all select doc_id, page_no, 'x' || (doc_id % 9), 'VARIABLE', 'an x', 'x' || (doc_id % 9) from n union all select doc_id, page_no, 'y', 'VARIABLE', '', 'y' from n""")
def x15j(spark, sf):
    return graph.formula_json_nodes(formula_json(spark, sf))[0]


@register("x15_variables", """select p_partkey as doc_id, p_size % 4 as page_no, 'Formula::P' || (p_size % 4) || '::' || left(sha256('x' || (p_size % 7) || ' + y'), 10) as source, 'HAS_VARIABLE' as relation, unnest(['x' || (p_partkey % 9), 'y']) as target from part""")
def x15v(spark, sf):
    return graph.formula_json_nodes(formula_json(spark, sf))[1]


def formula_json(spark, sf):
    """The formulas of a page as a model gives them: LaTeX as a text or a list, variables as objects or texts, one formula without LaTeX."""
    p = fx.table(spark, sf, "part")
    latex = F.concat(F.lit("x"), (F.col("p_size") % 7).cast("string"), F.lit(" + y"))
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('["'), F.concat(F.lit("x"), (F.col("p_size") % 7).cast("string")), F.lit('", "+ y"]'))).otherwise(F.concat(F.lit('"'), latex, F.lit('"')))
    told = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"meaning_it": "sum of '), "p_name", F.lit('", '))).otherwise("")
    raw = F.concat(F.lit('{"formulas": [{'), told, F.lit('"latex": '), said, F.lit(', "variables": [{"name": "x'), (F.col("p_partkey") % 9).cast("string"), F.lit('", "meaning": "an x"}, "y", " "]}, {"description": "none"}]}'))
    return p.select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 4).alias("page_no"), raw.alias("raw"))


CANON = [("REL_A_F", "supplied", "PART", ""), ("REL_N_O", "visits", "", "OPEN"), ("REL_R_F", "establishes", "ORDER", "")]


def edges(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ln"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("rel_"), "l_returnflag", F.lit("__"), "l_linestatus").alias("relation"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"))


@register("j4_canonical_relations", """select l_orderkey as doc_id, l_linenumber as ln, 'S' || l_suppkey as source, 'P' || l_partkey as target, 'REL_' || l_returnflag || '_' || l_linestatus as raw_relation,
 case l_returnflag || l_linestatus when 'AF' then 'SUPPLI' when 'NO' then 'VISIT' when 'RF' then 'ESTABLISH' else 'REL_' || l_returnflag || '_' || l_linestatus end as relation,
 case l_returnflag || l_linestatus when 'AF' then 'PART' when 'NO' then 'PLACE' when 'RF' then 'ORDER' end as canon_object from lineitem""")
def j4(spark, sf):
    canon = spark.createDataFrame(CANON, "raw_relation string, verb string, object string, qualifier string")
    return graph.canonicalize_relations(edges(spark, sf), canon).drop("canon_verb", "qualifier")


@register("j5_collapse_suffix", """with e as (select l_orderkey as doc_id, l_linenumber as ln, l_partkey, l_suppkey, case when l_linenumber % 2 = 0 then 'SUPPLIES' else 'SUPPLIES_' || l_returnflag end as rel from lineitem),
 b as (select distinct doc_id, rel from e), k as (select e.*, case when contains(e.rel, '_') then 'SUPPLIE' end as base from e)
 select k.doc_id, ln, l_partkey, l_suppkey, k.rel as relation, cast(null as varchar) as qualifier from k""")
def j5(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    e = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ln"), "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, "SUPPLIES").otherwise(F.concat(F.lit("SUPPLIES_"), "l_returnflag")).alias("relation"))
    return graph.collapse_relation_suffix(e).select("doc_id", "ln", "l_partkey", "l_suppkey", "relation", "qualifier")


@register("j5_collapse_base", """with e as (select l_orderkey as doc_id, l_linenumber as ln, l_partkey, l_suppkey, case when l_linenumber % 2 = 0 then 'CONTROL' else 'CONTROL_' || l_returnflag end as rel from lineitem), b as (select distinct doc_id from e where rel = 'CONTROL')
 select doc_id, ln, l_partkey, l_suppkey, case when doc_id in (select doc_id from b) then 'CONTROL' else rel end as relation, case when rel != 'CONTROL' and doc_id in (select doc_id from b) then right(rel, 1) end as qualifier from e""")
def j5b(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    e = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ln"), "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, "CONTROL").otherwise(F.concat(F.lit("CONTROL_"), "l_returnflag")).alias("relation"))
    return graph.collapse_relation_suffix(e).select("doc_id", "ln", "l_partkey", "l_suppkey", "relation", "qualifier")


@register("j6_merge_edges", """with n as (select l_suppkey as source, l_returnflag as relation, l_partkey as target, l_shipdate as seen from lineitem where l_suppkey % 10 != 3 and l_partkey % 10 != 3),
 a as (select source, relation, target, count(*) as c, max(seen) as s from n group by all union all select s_suppkey, 'R', s_suppkey % 50, 5, timestamp '1990-01-01' from supplier)
 select source, relation, target, cast(sum(c) as bigint) as count, cast(epoch_us(max(s)) as bigint) as last_seen from a group by all""")
def j6(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("target"), F.col("l_shipdate").cast("timestamp").alias("seen"))
    ids = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id")).unionByName(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))).where("id % 10 != 3")
    old = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), F.lit("R").alias("relation"), (F.col("s_suppkey") % 50).alias("target"), F.lit(5).cast("long").alias("count"), F.lit("1990-01-01").cast("timestamp").alias("last_seen"))
    return graph.merge_edges(li, ids, old).withColumn("last_seen", F.unix_micros("last_seen"))


NODES_SQL = """n as (select l_partkey as id, case when l_linenumber % 3 = 0 then 'UNCLASSIFIED' else 'K' || l_linenumber end as category, 'src' || (l_suppkey % 7) as filename, l_returnflag || l_linenumber as description, {'a': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey, 'q': l_quantity} as seen, 'p' || (l_suppkey % 2) as k, l_orderkey as chunk_uuid from lineitem)"""


def seen_nodes(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") % 3 == 0, "UNCLASSIFIED").otherwise(F.concat(F.lit("K"), F.col("l_linenumber").cast("string"))).alias("category"), F.concat(F.lit("src"), (F.col("l_suppkey") % 7).cast("string")).alias("filename"),
                     F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("description"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("seen"),
                     F.create_map(F.concat(F.lit("p"), (F.col("l_suppkey") % 2).cast("string")), F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("props"), F.col("l_orderkey").alias("chunk_uuid"))


@register("a1_merge_entities", f"""with {NODES_SQL}, f as (select id, filename, min(seen) as first from n group by all), s as (select id, string_agg(filename, ',' order by first, filename) as sources from f group by id),
 p as (select id, k, arg_max(description, seen) as v from n group by all), q as (select id, string_agg(k || '=' || v, ',' order by k) as props from p group by id)
 select n.id, coalesce(arg_max(category, seen) filter (category != 'UNCLASSIFIED'), 'UNCLASSIFIED') as category, any_value(sources) as sources, arg_max(description, seen) as description, any_value(props) as props from n join s using (id) join q using (id) group by n.id""")
def a1(spark, sf):
    return graph.merge_entities(seen_nodes(spark, sf)).withColumn("sources", F.array_join("sources", ",")).withColumn("props", joined("props"))


@register("a1_present_in", "select distinct l_partkey as id, l_orderkey as chunk_uuid from lineitem")
def a1p(spark, sf):
    return graph.present_in(seen_nodes(spark, sf))


@register("a2_structure_nodes", f"""with {fx.CHUNKS_SQL}, v as (select doc_id, page_no, chunk_uuid, left(arg_max(content, ingestion_ts), 1000) as text from chunks group by all)
 select 'Chunk' as label, chunk_uuid as id, text from v union all select distinct 'Page', doc_id || '::' || page_no, null from v union all select distinct 'Document', cast(doc_id as varchar), null from v""")
def a2n(spark, sf):
    return graph.build_structure(fx.chunks(spark, sf))[0]


@register("a2_structure_edges", f"""with {fx.CHUNKS_SQL} select distinct cast(doc_id as varchar) as source, 'HAS_PAGE' as relation, doc_id || '::' || page_no as target from chunks union all select distinct doc_id || '::' || page_no, 'HAS_CHUNK', chunk_uuid from chunks""")
def a2e(spark, sf):
    return graph.build_structure(fx.chunks(spark, sf))[1]


@register("j7_synonyms", """with p as (select l_orderkey as c, lower('Part ' || (l_partkey % 9)) as k, 'PA' || (l_partkey % 9) as s from lineitem union select l_orderkey, lower('PA' || (l_partkey % 9)), 'Part ' || (l_partkey % 9) from lineitem),
 e as (select o_orderkey as c, unnest(['PART 1', 'pa2', 'none']) as id from orders) select e.c as chunk_uuid, e.id, array_to_string(list_sort(list_distinct(list_concat(['old'], list(p.s) filter (p.s is not null)))), ',') as synonyms from e left join p on p.c = e.c and p.k = lower(e.id) group by e.c, e.id""")
def j7(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    n = (F.col("l_partkey") % 9).cast("string")
    pairs = li.select(F.col("l_orderkey").alias("chunk_uuid"), F.concat(F.lit("Part "), n).alias("canonical"), F.concat(F.lit("PA"), n).alias("acronym")).distinct()
    e = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_uuid"), F.explode(F.array(F.lit("PART 1"), F.lit("pa2"), F.lit("none"))).alias("id"), F.array(F.lit("old")).alias("synonyms"))
    return graph.enrich_synonyms(e, pairs).withColumn("synonyms", F.array_join(F.array_sort("synonyms"), ","))


@register("x15_formula_nodes", """select 'Formula::P' || p_partkey as id, 'FORMULA' as category, 'f' || p_size as formula from part where p_size % 3 = 1""")
def x15n(spark, sf):
    return graph.formula_nodes(*formulas(spark, sf))[0]


def formulas(spark, sf):
    p = fx.table(spark, sf, "part")
    e = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 3 == 0, "FORMULA").otherwise("X").alias("category"), F.when(F.col("p_size") % 3 == 2, "").otherwise(F.concat(F.lit("f"), F.col("p_size").cast("string"))).alias("formula"))
    old = p.where("p_partkey % 5 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("source"), F.lit("HAS_FORMULA").alias("relation"), F.concat(F.lit("Formula::P"), F.col("p_partkey").cast("string")).alias("target"))
    return e, old


@register("x15_formula_edges", """select 'P' || p_partkey as source, 'HAS_FORMULA' as relation, 'Formula::P' || p_partkey as target from part where p_size % 3 = 1 and p_partkey % 5 != 0""")
def x15e(spark, sf):
    return graph.formula_nodes(*formulas(spark, sf))[1]


@register("x16_entity_defaults", """select p_partkey as id, case when p_size % 2 = 0 then p_name else '' end as description, '' as formula, case when p_size % 3 = 0 then '' else p_brand end as synonyms from part""")
def x16(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("description"), F.lit(None).cast("string").alias("formula"), F.when(F.col("p_size") % 3 != 0, F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "))).alias("synonyms"))
    return graph.default_entity_props(p).withColumn("synonyms", F.array_join("synonyms", ","))


@register("j3_semantic_gate", """with f as (select 'src' || (vec_id % 20) as filename, label as page, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings), m as (select filename, page, list(x order by d) as m from (select filename, page, d, avg(x) as x from f group by all) group by all),
 a as (select embedding::double[] as a from embeddings where vec_id < 8)
 select filename, page, round(max(list_dot_product(m, a) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(a, a))), 6) as score, max(list_dot_product(m, a) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(a, a))) >= 0.38 as keep from m, a group by filename, page""")
def j3(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    v = e.select(F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("filename"), F.col("label").alias("page"), "embedding")
    anchors = [r.embedding for r in e.where("vec_id < 8").select("embedding").collect()]  # eight
    return graph.semantic_gate(v, anchors).withColumn("score", F.round("score", 6))


@register("j3_gate_texts", """with e as (select 'src' || (vec_id % 20) as filename, vec_id as page, embedding::double[] as m, (vec_id % 4) * 150 as n from embeddings), a as (select embedding::double[] as a from embeddings where vec_id < 8)
 select filename, page, round(max(list_dot_product(m, a) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(a, a))), 6) as score,
 case when page % 2 = 0 then max(list_dot_product(m, a) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(a, a))) >= 0.38 else any_value(n) >= 300 and max(list_dot_product(m, a) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(a, a))) >= 0.2 end as keep from e, a group by filename, page""")
def j3t(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    v = e.select(F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("filename"), F.col("vec_id").alias("page"), "embedding", F.repeat(F.lit("x"), (F.col("vec_id") % 4 * 150).cast("int")).alias("text"))
    anchors = [r.embedding for r in e.where("vec_id < 8").select("embedding").collect()]
    return graph.semantic_gate(v.where("page % 2 = 0").drop("text"), anchors, texts=v).withColumn("score", F.round("score", 6))


MENTIONS = "m as (select distinct l_partkey as e, l_orderkey as c from lineitem join part on p_partkey = l_partkey where p_brand != 'Brand#13'), s as (select l_orderkey % 47 as q, l_orderkey as c from lineitem where l_orderkey % 50 = 0 group by all)"


@register("j8_graph_neighbors", f"""with {MENTIONS}, w as (select distinct q, e from s join m using (c)), h as (select q, m.c, count(*) as shared from w join m using (e) group by all), o as (select * from h where shared >= 2 and not exists (select 1 from s where s.q = h.q and s.c = h.c))
 select q as query_id, c as chunk_uuid, shared, cast(rank as int) as rank from (select *, row_number() over (partition by q order by shared desc, c) as rank from o) where rank <= 4""")
def j8(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_brand") == "Brand#13", "generic").otherwise(F.col("p_type")).alias("category"))
    m = li.join(p, "l_partkey").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_uuid"), "category")
    s = li.where("l_orderkey % 50 = 0").select((F.col("l_orderkey") % 47).alias("query_id"), F.col("l_orderkey").alias("chunk_uuid")).distinct()
    return graph.graph_neighbors(m, s)


def parts(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("description"))


def part_mentions(spark, sf):
    return fx.dealt(spark, sf, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_uuid")).distinct()


def order_chunks(spark, sf):
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_uuid"), (F.col("o_custkey") % 30).alias("page_no"), F.col("o_custkey").alias("chunk_index"), F.col("o_orderpriority").alias("text"))


def tokens(spark):
    return spark.createDataFrame([(1, "cold"), (1, "urgent"), (2, "widget"), (2, "economy"), (3, "low")], "query_id int, token string")


TOK = "tok as (select * from (values (1, 'cold'), (1, 'urgent'), (2, 'widget'), (2, 'economy'), (3, 'low')) as v(query_id, token))"
WORDS = "regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+')"
ENT = f"{TOK}, ent as (select distinct query_id, token, p_partkey as e from part, tok where list_contains({WORDS.format('p_name')}, token) or list_contains({WORDS.format('p_type')}, token)), men as (select distinct l_partkey as e, l_orderkey as c from lineitem)"


@register("j9_search_entities", f"""with {ENT}, chk as (select distinct query_id, o_orderkey as c from orders, tok where list_contains({WORDS.format('o_orderpriority')}, token)),
 f as (select query_id, c, e from (select distinct query_id, e from ent) join men using (e) union select query_id, c, e from chk join men using (c)), n as (select query_id, c, count(distinct e) as n_entities from f group by all)
 select query_id, c as chunk_uuid, n_entities, page_no, chunk_index, cast(rank as int) as rank from (select n.*, o_custkey % 30 as page_no, o_custkey as chunk_index, row_number() over (partition by query_id order by n_entities desc, o_custkey % 30, o_custkey, c) as rank from n join orders on o_orderkey = c) where rank <= 30""")
def j9(spark, sf):
    return graph.search_entities(parts(spark, sf), part_mentions(spark, sf), order_chunks(spark, sf), tokens(spark))


@register("j10_search_formulas", f"""with {ENT}, n as (select e, count(*) as n from men group by e), h as (select distinct query_id, e from ent)
 select query_id, e as formula_id, coalesce(n, 0) as n_mentions, cast(rank as int) as rank from (select query_id, h.e, n.n, row_number() over (partition by query_id order by h.e % 9, h.e % 4, h.e) as rank from h left join n on n.e = h.e) where rank <= 6""")
def j10(spark, sf):
    f = parts(spark, sf).select(F.col("entity_id").alias("formula_id"), "name", F.lit("x").alias("latex"), F.col("description").alias("meaning"), F.lit("f.md").alias("filename"), (F.col("entity_id") % 9).alias("page"), (F.col("entity_id") % 4).alias("chunk_index"))
    return graph.search_formulas(f, part_mentions(spark, sf), tokens(spark)).select("query_id", "formula_id", "n_mentions", "rank")


@register("j11_search_relations", f"""with {ENT}, ed as (select distinct l_suppkey as source, l_returnflag as relation, l_partkey as target from lineitem), h as (select query_id, token, source, relation, target from ed join ent on e = source union select query_id, token, source, relation, target from ed join ent on e = target),
 n as (select query_id, source, relation, target, count(distinct token) as hits from h group by all) select query_id, source, relation, target, hits, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by hits desc, source, relation, target) as rank from n) where rank <= 40""")
def j11(spark, sf):
    e = fx.dealt(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_returnflag").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("target")).distinct()
    return graph.search_relations(e, parts(spark, sf), tokens(spark))


@register("a8_score_relations", f"""with {TOK}, p as (select p_partkey as k, list_concat({WORDS.format('p_name')}, {WORDS.format('p_type')}) as w from part), h as (select query_id, k, count(distinct token) as n from p, tok where list_contains(w, token) group by all), c as (select * from h where query_id = 2)
 select query_id, k as edge_id, n_concepts, n_tokens, cast(row_number() over (partition by query_id order by n_concepts desc, n_tokens desc, k) as int) as rank from (select h.query_id, h.k, coalesce(c.n, 0) as n_concepts, h.n as n_tokens from h left join c on c.query_id = h.query_id and c.k = h.k) where n_concepts >= 1 or n_tokens >= 2""")
def a8(spark, sf):
    rows = parts(spark, sf).select(F.col("entity_id").alias("edge_id"), F.concat_ws(" ", "name", "description").alias("text"))
    t = tokens(spark)
    return graph.score_relations(rows, t.where("query_id = 2"), t)


def spaced(c):
    return f"' ' || array_to_string(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != ''), ' ') || ' '"


#: Sentences of the chunks c1 with the concepts c of a table of query_id and c that are in them, the pairs of a query, and their evidence.
TOGETHER = f"""se as (select chunk_uuid, content, i, {spaced('s')} as t from (select chunk_uuid, content, unnest(regexp_split_to_array(content, '[.;!?][ \\n]+|\\n')) as s, generate_subscripts(regexp_split_to_array(content, '[.;!?][ \\n]+|\\n'), 1) as i from c1)),
 tm as (select distinct c, {spaced('c')} as needle from con), k as (select chunk_uuid, content, i, c from se join tm on contains(t, needle)), p as (select distinct a.query_id, a.c as x, b.c as y from con a join con b on a.query_id = b.query_id and a.c < b.c),
 b as (select x, y, l.chunk_uuid, any_value(l.content) as content, bool_or(l.i = r.i) as same from (select distinct x, y from p) join k l on l.c = x join k r on r.c = y and r.chunk_uuid = l.chunk_uuid group by x, y, l.chunk_uuid),
 s as (select x, y, bool_or(same) as same, count(*) as n, left(arg_min(content, (not same)::int || chunk_uuid), 300) as snippet from b group by all)"""


@register("a7_cooccurrence", f"""with {fx.CHUNKS_SQL}, con as (select item_id % 20 as query_id, lower(case when item_id % 3 = 0 then array_to_string(string_split(text, ' ')[2:3], ' ') else string_split(text, ' ')[2] end) as c from benchmark), {TOGETHER}
 select p.query_id, p.x, p.y, case when left(p.x, 1) = left(p.y, 1) then 'edge' when same then 'strong' when n > 0 then 'weak' else 'not_found' end as evidence, coalesce(n, 0) as n_chunks, coalesce(snippet, '') as snippet from p left join s on s.x = p.x and s.y = p.y""")
def a7(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    c = b.select((F.col("item_id") % 20).alias("query_id"), F.when(F.col("item_id") % 3 == 0, F.expr("array_join(slice(split(text, ' '), 2, 2), ' ')")).otherwise(F.split("text", " ")[1]).alias("concept"))
    low = c.select(F.lower("concept").alias("c"), F.substring(F.lower("concept"), 1, 1).alias("k")).distinct()
    e = low.withColumnRenamed("c", "source").join(low.withColumnRenamed("c", "target"), "k").where("source < target").select(F.upper("source").alias("source"), "target")
    return graph.concept_cooccurrence(c, one_version(spark, sf), e)


@register("j13_attach_formulas", """with o as (select distinct l_partkey as e, l_orderkey as c from lineitem), r as (select distinct c % 40 as q, 'LaTeX: x' || p_size || ' | Plain: ' || p_brand || ' | Meaning: ' || p_type as line from o join part on p_partkey = e join orders on o_orderkey = c)
 select q as query_id, 'GRAPH' as tier, string_agg(line, chr(10) order by line) as content from r group by q""")
def j13(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("formula_id"), F.concat(F.lit("x"), F.col("p_size").cast("string")).alias("latex"), F.col("p_brand").alias("plain"), F.col("p_type").alias("meaning"))
    s = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 40).alias("query_id"), F.col("o_orderkey").alias("chunk_uuid"))
    return graph.attach_formulas(s, part_mentions(spark, sf), p)


@register("j14_attach_entities", """with o as (select c, name, e, row_number() over (partition by c order by name, e) as n from (select distinct l_orderkey as c, l_partkey as e, p_name as name from lineitem join part on p_partkey = l_partkey where p_name not like 'cold%')), l as (select c, string_agg(name, ', ' order by name, e) as entities from o where n <= 3 group by c)
 select o_custkey as query_id, o_orderkey as chunk_uuid, coalesce(entities, '') as entities from orders left join l on c = o_orderkey""")
def j14(spark, sf):
    stop = fx.table(spark, sf, "part").where("p_name like 'cold%'").select(F.col("p_name").alias("name"))
    s = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_uuid"))
    return graph.attach_entities(s, part_mentions(spark, sf), parts(spark, sf), 3, stop)


@register("x23_relation_rows", "select distinct l_suppkey as source, lower(replace('REL_' || l_returnflag, '_', ' ')) as relation, l_partkey as target, 'f' || (l_suppkey % 3) as filename, l_linenumber as page from lineitem")
def x23(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return graph.relation_rows(li.select(F.col("l_suppkey").alias("source"), F.concat(F.lit("REL_"), "l_returnflag").alias("relation"), F.col("l_partkey").alias("target"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("filename"), F.col("l_linenumber").alias("page")))
