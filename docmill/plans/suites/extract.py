"""Queries of tagging and extraction."""

from pyspark.sql import functions as F

from docmill.functions import lexicons as L
from docmill.operators import extract, index
from docmill.plans import fixtures as fx
from docmill.plans.registry import register
from docmill.plans.suites.clean import squeeze
from docmill.plans.suites.search import ALIAS_SQL, NEWEST, aliases

TAX = "tax as (select * from (values " + ", ".join(str(t) for t in L.TAXONOMY) + ") as v(folder, tier, content_type, source_kind))"
MACRO = "(['TIER_A_NORMATIVE', 'TIER_B_GOVERNANCE', 'TIER_C_EVIDENCES', 'other'])[cast(doc_id % 4 as int) + 1]"
FOLDER = "([" + ", ".join(f"'{t[0]}'" for t in L.TAXONOMY) + ", 'unknown'])[cast(doc_id % 23 as int) + 1]"


def filed(spark, sf):
    macro = F.expr("element_at(array('TIER_A_NORMATIVE', 'TIER_B_GOVERNANCE', 'TIER_C_EVIDENCES', 'other'), cast(doc_id % 4 as int) + 1)")
    folder = F.expr("element_at(array(" + ", ".join(f"'{t[0]}'" for t in L.TAXONOMY) + ", 'unknown'), cast(doc_id % 23 as int) + 1)")
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.concat(macro, F.lit("/"), F.when(F.col("doc_id") % 5 == 0, F.lit("Sub_X/")).otherwise(""), folder).alias("path"), F.lit("2024-05-01").alias("ingest_date"))


@register("j1_dispatch", f"""with {TAX}, f as (select doc_id, {MACRO} as macro, doc_id % 5 = 0 as deep, {FOLDER} as folder from documents),
 k as (select f.*, coalesce(t.tier, 'B') as t, coalesce(t.content_type, 'reference') as ct, coalesce(t.source_kind, 'internal') as sk from f left join tax t on t.folder = f.folder),
 o as (select doc_id, case macro when 'TIER_A_NORMATIVE' then 'A' when 'TIER_B_GOVERNANCE' then 'B' when 'TIER_C_EVIDENCES' then 'C' else t end as tier, ct as content_type, sk as source_kind,
 case when macro = 'TIER_C_EVIDENCES' or deep then (case when deep then 'sub_x' else lower(folder) end) else ct end as ontology from k)
 select doc_id, case when doc_id % 9 = 0 then 'B' else tier end as tier, content_type, source_kind, ontology, case when tier = 'C' then '2024-05-01' end as effective_date from o""")
def j1(spark, sf):
    side = fx.table(spark, sf, "documents").where("doc_id % 9 = 0").select("doc_id", F.lit("B").alias("tier"), *[F.lit(None).cast("string").alias(c) for c in ("content_type", "source_kind", "ontology", "effective_date")])
    return extract.dispatch_tiers(filed(spark, sf), extract.taxonomy(spark), side)


TOPICS = [("articles", ["the", "les", "der"]), ("links", ["and", "et", "und"]), ("stems", ["ing", "ment"]), ("rare", ["zqx"])]


def count_sql(patterns):
    return " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in patterns)


@register("a3_topics", f"""with s as (select doc_id, unnest([{", ".join(f"{{'topic': '{t}', 'ord': {i}, 'score': {count_sql(p)}}}" for i, (t, p) in enumerate(TOPICS))}], recursive := true) from documents)
 select doc_id, topic, score, cast(rank as int) as rank from (select *, row_number() over (partition by doc_id order by score desc, ord) as rank from s where score > 0) where rank <= 3""")
def a3(spark, sf):
    return extract.tag_topics(fx.table(spark, sf, "documents"), TOPICS, 3)


EDGE = "[^\\p{L}\\p{N}_]"
DOUBLED = f"' ' || regexp_replace(coalesce(text, ''), '({EDGE})', '\\1\\1', 'g') || ' '"


@register("a4_entity_density", f"""with w as (select doc_id, length(coalesce(text, '')) as n, {DOUBLED} as t from documents),
 e as (select doc_id, n, list_distinct(regexp_extract_all(t, '{EDGE}([A-ZÀ-Ú][a-zà-ú]{{2,}}){EDGE}', 1)) as titles, list_distinct(regexp_extract_all(t, '{EDGE}([a-zà-ú]{{3,}}){EDGE}', 1)) as common,
 list_distinct(regexp_extract_all(t, '(?i){EDGE}(the|and|une|der){EDGE}', 1)) as k from w)
 select doc_id, case when n < 20 then 0 else cast(len(list_filter(titles, lambda x: not list_contains(common, lower(x)))) as int) end as entities, cast(len(k) as int) as keywords from e""")
def a4(spark, sf):
    return extract.entity_density(fx.table(spark, sf, "documents"), ["the", "and", "une", "der"])


COSTS = "coalesce(text, '') || ' cost € 1.250,50 and ' || (doc_id % 90) || ',5% or 1,000.25 USD of ' || doc_id || ' EUR'"


@register("x8_facts", f"""with d as (select doc_id, {COSTS} as text from documents), r as (select doc_id, unnest([{{'kind': 'percent', 'f': list_distinct((regexp_extract_all(substring(coalesce(text, ''), 1, 20000), '{extract.PERCENT}'))[1:20])}},
 {{'kind': 'amount', 'f': list_distinct((regexp_extract_all(substring(coalesce(text, ''), 1, 20000), '{extract.AMOUNT}'))[1:20])}}], recursive := true) from d),
 x as (select doc_id, kind, unnest(f) as fact from r), n as (select *, regexp_replace(regexp_extract(fact, '[0-9][0-9.,]*'), '[.,]$', '') as c from x)
 select doc_id, kind, fact, try_cast(case when contains(c, '.') and contains(c, ',') and instr(reverse(c), ',') < instr(reverse(c), '.') then replace(replace(c, '.', ''), ',', '.') when contains(c, '.') and contains(c, ',') then replace(c, ',', '')
 when contains(c, ',') then replace(c, ',', '.') when regexp_matches(c, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+$') then replace(c, '.', '') else c end as double) as value from n""")
def x8(spark, sf):
    return extract.extract_facts(fx.table(spark, sf, "documents").select("doc_id", F.expr(COSTS).alias("text")))


NAMED = "'Plan ' || source || ' name (' || upper(left(source, 1)) || 'X' || (doc_id % 50) || ') and ' || upper(left(lang, 2)) || 'Q (' || lang || ' language name) (x)'"


@register("x9_acronyms", """select doc_id, 'Plan ' || source || ' name' as canonical, 'SX' || (doc_id % 50) as acronym from documents union all select doc_id, lang || ' language name', upper(lang) || 'Q' from documents""")
def x9(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.expr(NAMED).alias("text"))
    return extract.extract_acronyms(d, "doc_id")


RULED = "coalesce(text, '') || '. the level is at least ' || (doc_id % 7) || ' percent of all; over 5 % ok'"
@register("x10_threshold_rules", rf"""with s as (select doc_id, list_transform(regexp_split_to_array(regexp_replace({RULED}, '([.;!?])[ \t\n\r\f]+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda x: {squeeze(r"regexp_replace(regexp_replace(x, '^`+|`+$', '', 'g'), '^\$+|\$+$', '', 'g')")}) as s from documents),
 r as (select doc_id, list_filter(s, lambda x: regexp_matches(lower(x), '({"|".join(L.THRESHOLD_WORDS)})') and regexp_matches(lower(x), '[0-9]+([.,][0-9]+)? *({L.THRESHOLD_UNITS})') and len(regexp_extract_all(x, '[A-Za-zÀ-ÿ]+')) >= 5) as r from s)
 select doc_id, cast(generate_subscripts(r, 1) - 1 as int) as rank, unnest(r) as rule from r where len(list_distinct(r)) = len(r) and len(r) <= 8 and len(list_filter(r, lambda x: length(x) > 900)) = 0""")
def x10(spark, sf):
    d = fx.documents(spark, sf).select("doc_id", F.expr(RULED).alias("text"))
    return extract.extract_threshold_rules(d, "doc_id")


@register("x21_definitions", """with h as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as ln, (['the', 'ment', 'zqx'])[cast(doc_id % 3 as int) + 1] as alias from documents),
 p as (select *, list_position(list_transform(ln, lambda x: contains(lower(x), alias)), true) as pos from h)
 select doc_id, case when pos > 0 then substring(array_to_string(ln[pos:pos + 4], chr(10)), 1, 900) else substring(t, 1, 900) end as snippet from p""")
def x21(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("element_at(array('the', 'ment', 'zqx'), cast(doc_id % 3 as int) + 1)").alias("alias"))
    return extract.definition_snippets(d).select("doc_id", "snippet")


@register("x21_best_definitions", f"""with {fx.CHUNKS_SQL}, {ALIAS_SQL}, g as (select * from {NEWEST} where contains(lower(filename), 'src3')),
 h as (select distinct query_id, alias, chunk_uuid, filename, page_no, content, ingestion_ts from g join t on alias != '' and contains(lower(content), lower(alias)) and (not regexp_matches(alias, '^[A-Z0-9]{{2,8}}$') or regexp_matches(content, '(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)'))),
 b as (select * from (select *, row_number() over (partition by query_id, alias order by ingestion_ts desc, chunk_uuid) as r from h) where r = 1),
 p as (select t.query_id, t.alias as term, chunk_uuid, filename, page_no as page, content, string_split(content, chr(10)) as ln, list_position(list_transform(string_split(content, chr(10)), lambda x: contains(lower(x), lower(t.alias))), true) as pos, instr(lower(content), lower(t.alias)) as spot from t left join b using (query_id, alias))
 select query_id, term, chunk_uuid, filename, page, case when pos > 0 then substring(array_to_string(ln[pos:pos + 4], chr(10)), 1, 900) when spot > 0 then substring(content, greatest(spot - 160, 1), 1060) else substring(content, 1, 900) end as definition, chunk_uuid is not null as found from p""")
def x21_best(spark, sf):
    idx = fx.text_index(spark, sf)
    t = aliases(spark, sf)
    texts = index.current_docs(idx).select("chunk_uuid", "filename", "page_no").join(index.current_texts(idx), "chunk_uuid")
    return extract.best_definitions(t.withColumn("term", F.col("alias")), index.glossary_search(t, idx, "src3", 1), texts)


def formula_sources(spark, sf):
    """One source for each part, with a line of every kind; every third stands for the graph, every second is a formula source."""
    p = fx.dealt(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    graph = k % 3 == 0
    content = F.concat(F.lit("$$"), "p_brand", F.lit(" + 1$$\nrisk = "), n, F.lit(" * 2\nRTO "), "p_brand", F.lit(" at least "), n, F.lit("% of all recovery targets\nLaTeX: a"), (k % 5).cast("string"), F.lit("\nPlain: b"), (k % 5).cast("string"), F.lit("\nMeaning: total of acts\nname = total\nCoverage index: strong\nMTTD = \\text{mean time to detect "), n, F.lit("}"))
    return p.select(k.alias("id"), F.when(graph, "KG").otherwise(F.concat(F.lit("f"), (k % 7).cast("string"), F.lit(".md"))).alias("filename"), F.when(graph, 0).otherwise(k % 9 + 1).cast("int").alias("page"), F.when(k % 2 == 0, "formula").otherwise("text").alias("type"), content.alias("content"))


FORMULA_SQL = """fa as (select p_partkey as id, case when p_partkey % 3 = 0 then 'KG' else 'f' || (p_partkey % 7) || '.md' end as filename, cast(case when p_partkey % 3 = 0 then 0 else p_partkey % 9 + 1 end as int) as page, unnest([
 {'kind': 'latex', 'name': 'formula recuperata', 'formula': '$$' || p_brand || ' + 1$$', 'meaning': ''}, {'kind': case when p_partkey % 2 = 0 then 'block' end, 'name': 'b' || (p_partkey % 5), 'formula': 'a' || (p_partkey % 5), 'meaning': 'total of acts'},
 {'kind': 'equation', 'name': 'risk', 'formula': 'risk = ' || p_size || ' * 2', 'meaning': ''}, {'kind': 'equation', 'name': 'name', 'formula': 'name = total', 'meaning': ''}, {'kind': 'equation', 'name': 'MTTD', 'formula': 'MTTD = \\text{mean time to detect ' || p_size || '}', 'meaning': ''},
 {'kind': 'metric', 'name': 'Coverage index', 'formula': null, 'meaning': 'metrica/indicatore'}, {'kind': 'metric', 'name': 'MTTD', 'formula': null, 'meaning': 'metrica/indicatore'},
 {'kind': 'threshold', 'name': 'regola soglia', 'formula': 'RTO ' || p_brand || ' at least ' || p_size || '% of all recovery targets', 'meaning': ''}], recursive := true) from part),
 fr as (select * exclude (n) from (select *, row_number() over (partition by filename, page, kind, name, lower(formula) order by id) as n from fa where kind is not null) where n = 1),
 fc as (select id, filename, page, kind, case when kind = 'threshold' then 'Regola soglia' else name end as name, case when kind = 'threshold' or (name = 'risk' and filename != 'KG') then formula end as formula,
  case when kind = 'equation' and name = 'MTTD' then replace(replace(formula, 'MTTD = \\text{', ''), '}', '') when name = 'risk' and filename = 'KG' then replace(formula, 'risk = ', '') else meaning end as meaning,
  case when kind = 'threshold' then 'threshold' when name = 'risk' and filename != 'KG' then 'computational' when name in ('risk', 'MTTD', 'Coverage index') then 'definitional' else 'cited' end as class, filename = 'KG' as from_graph from fr where kind != 'latex')"""


@register("x11_formula_rows", f"with {FORMULA_SQL} select id, filename, page, kind, name, formula, meaning from fr")
def x11(spark, sf):
    return extract.extract_formula_rows(formula_sources(spark, sf))


@register("x12_formula_classes", f"with {FORMULA_SQL} select id, filename, page, kind, name, formula, meaning, class, from_graph from fc")
def x12(spark, sf):
    return extract.classify_formula_rows(extract.extract_formula_rows(formula_sources(spark, sf)))


BEST_SQL = """k as (select *, case when class = 'threshold' then 'threshold:' || substring(lower(formula), 1, 260) else regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') end as key from {rows}),
 o as (select * from (select *, row_number() over (partition by {by} key, class, filename, page order by case when from_graph then 0 else 2 end desc, least(length(meaning), 500) desc, formula nulls first, name, filename, meaning) as n from k) where n = 1),
 s as (select * from o where not from_graph or not exists (select 1 from o b where not b.from_graph and lower(b.name) = lower(o.name) and b.class = o.class {same}))"""
ORDER_SQL = "list_position(['computational', 'threshold', 'definitional', 'cited'], class), filename, page, name, formula nulls first"


@register("d8_formula_rows", f"with {FORMULA_SQL}, {BEST_SQL.format(rows='fc', by='', same='')} select name, class, filename, page, formula, meaning from s order by {ORDER_SQL} limit 200")
def d8(spark, sf):
    return extract.dedupe_formula_rows(extract.classify_formula_rows(extract.extract_formula_rows(formula_sources(spark, sf))), 200).select("name", "class", "filename", "page", "formula", "meaning")


@register("a9_thresholds", f"""with {FORMULA_SQL} select filename, page, 'oltre il ' || regexp_extract(formula, '([0-9]+)%', 1) || '%' as criterion, count(*) as n, array_to_string((list_sort(list_distinct(list(formula))))[1:8], '; ') as scope from fr where kind = 'threshold' group by all""")
def a9(spark, sf):
    rows = extract.extract_formula_rows(formula_sources(spark, sf), kinds=["threshold"]).withColumnRenamed("formula", "rule")
    return extract.aggregate_thresholds(rows)
