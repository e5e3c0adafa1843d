"""Queries of the cleaning, flagging and typing operators."""

from pyspark.sql import functions as F

from docmill.functions import lexicons as L
from docmill.operators import clean
from docmill.plans import fixtures as fx
from docmill.plans.registry import register

B = r"[ \t\n\r\f]"
STRIP = rf"regexp_replace(%s, '^{B}+|{B}+$', '', 'g')"
STRUCT = clean.whole_words(L.STRUCTURAL)
PAGE_WORDS = clean.whole_words(f"{L.STRUCTURAL}|the|une")


def q(text: str) -> str:
    return text.replace("'", "''")


def squeeze(sql: str) -> str:
    return rf"trim(regexp_replace({sql}, '[ \t\n\r\f\x0b]+', ' ', 'g'))"


def contains_any(col: str, marks) -> str:
    return "(" + " or ".join(f"contains({col}, '{q(m)}')" for m in marks) + ")"


def count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, '{q(pattern)}'))"


T = "coalesce(text, '')"
RAW = "chr(10) || chr(10) || chr(10) || '  ' || replace(text, '. ', '.' || chr(9) || '            ')"


@register("p1_normalize_whitespace", f"""select doc_id, {STRIP % "regexp_replace(regexp_replace(replace(replace(raw, chr(9), '    '), 'x0', 'x0'), ' {10,}', '    ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')"} as text
 from (select doc_id, {RAW} as raw from documents)""")
def p1(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("\n\n\n  "), F.replace("text", F.lit(". "), F.lit(".\t            "))).alias("text"))
    return clean.normalize_whitespace(d)


FURNITURE = ", ".join(f"'{x}'" for x in L.PAGE_FURNITURE)


@register("p2_clean_text_lines", f"""select doc_id, {squeeze(f"array_to_string(list_filter(list_transform(string_split({T}, chr(10)), lambda x: {STRIP % 'x'}), lambda x: x != '' and lower(x) not in ({FURNITURE}) and not regexp_matches(x, '^[^\\p{{L}}_]+$')), ' ')")} as text from documents""")
def p2(spark, sf):
    return clean.clean_text_lines(fx.table(spark, sf, "documents").select("doc_id", "text"))


@register("p3_normalize_unicode")
def p3(spark, sf):
    return clean.normalize_unicode(fx.table(spark, sf, "documents").select("doc_id", "text"))


@register("p4_clean_markdown", f"""with m as (select doc_id, replace({T}, '.' || chr(10), '.' || chr(10) || '# ') || chr(10) || '# Index of x' || chr(10) || 'see http://a.b/c or me@x.org' as t from documents),
 p as (select doc_id, string_split(regexp_replace(t, '(' || chr(10) || '#+ [^' || chr(10) || ']*)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as parts from m),
 k as (select doc_id, list_filter(case when len(parts) > 1 and length({STRIP % 'parts[1]'}) < 300 then parts[3:] else parts end, lambda x: not regexp_matches(substring(x, 1, 400), '{STRUCT}')) as kept from p)
 select doc_id, array_to_string(list_transform(kept, lambda x: regexp_replace(regexp_replace(x, 'https?://[^ \\t\\n\\r\\f\\x0b]+', '', 'g'), '[^ \\t\\n\\r\\f\\x0b]+@[^ \\t\\n\\r\\f\\x0b]+', '', 'g')), '') as text from k""")
def p4(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(".\n"), F.lit(".\n# ")), F.lit("\n# Index of x\nsee http://a.b/c or me@x.org")).alias("text"))
    return clean.clean_markdown(d)


@register("p5_structural_pages", f"with {fx.PAGES_SQL} select doc_id, page_no, coalesce(regexp_matches(substring(text, 1, 400), '{PAGE_WORDS}') and page_no != 1, false) as structural from pg")
def p5(spark, sf):
    return clean.flag_structural_pages(fx.pages(spark, sf), PAGE_WORDS).select("doc_id", "page_no", "structural")


@register("p6_garbage", f"select doc_id, length({T}) < 5 or {count(T, '[□�]')} / greatest(length({T}), 1) > 0.1 as garbage, {count(T, '[□�]')} > 0 as garbled from documents")
def p6(spark, sf):
    return clean.flag_garbage(fx.table(spark, sf, "documents")).select("doc_id", "garbage", "garbled")


@register("p7_corrupt_layer", f"""with l as (select doc_id, {T} as t, string_split({T}, chr(10)) as ln from documents)
 select doc_id, {contains_any("t", L.BROKEN_MARKS)} or (len(ln) > 5 and len(list_filter(ln, lambda x: length(x) > 5 and regexp_matches({STRIP % 'x'}, '^[^\\p{{L}}_]+$'))) / len(ln) > 0.4) as corrupt from l""")
def p7(spark, sf):
    return clean.flag_corrupt_layer(fx.table(spark, sf, "documents")).select("doc_id", "corrupt")


@register("p8_math_or_table", f"""with {fx.PAGES_SQL} select doc_id, page_no, contains(t, '(cid:') or contains(t, '2C0D') or {count('t', '•')} > 5 or {count('t', '—')} > 5 or {count('t', '˜')} > 3
 or (length(t) > 100 and {count('t', '[0-9]')} / greatest(length(t), 1) > 0.15) or regexp_matches(lower(t), '{"|".join(L.MATH_WORDS)}') or regexp_matches(t, '[{L.MATH_SYMBOLS}]')
 or regexp_matches(t, '\\b[a-zA-Z0-9_]{{1,4}}[ \\t\\n\\r\\f]*=[ \\t\\n\\r\\f]*[0-9]') as math_or_table from (select *, {T} as t from pg)""")
def p8(spark, sf):
    return clean.flag_math_or_table(fx.pages(spark, sf)).select("doc_id", "page_no", "math_or_table")


WORDS = ["the", "and", "of", "einen", "para", "this"]


# RE2's \\b knows ASCII only, so separators are doubled and matched on either side.
@register("p9_kg_candidates", f"""with w as (select doc_id, length({T}) as len, ' ' || regexp_replace({T}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ' as t from documents),
 n as (select doc_id, len, len(list_distinct(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}_]([A-Z][a-zà-ù]+)[^\\p{{L}}\\p{{N}}_]', 1))) as nouns,
 len(list_distinct(regexp_extract_all(t, '(?i)[^\\p{{L}}\\p{{N}}_]({"|".join(WORDS)})[^\\p{{L}}\\p{{N}}_]', 1))) as found from w)
 select doc_id, len >= 300 and ((nouns >= 1 and found >= 1) or found >= 3) as kg_candidate, found > 0 as keyword_present from n""")
def p9(spark, sf):
    return clean.flag_kg_candidates(fx.table(spark, sf, "documents"), WORDS).select("doc_id", "kg_candidate", "keyword_present")


CHART_SQL = "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(L.CHART_PAGE_WORDS) + ")([^\\p{L}\\p{N}_]|$)"
MARKED = "case doc_id % 9 when 0 then text || ' see the Risk Matrix.' when 1 then 'graphs, ' || text when 2 then text || ' cvss' when 3 then text || ' 1 ≤ 2' else text end"


FORMULA_PAGE_SQL = "(?i)(" + "|".join(p for p in L.FORMULA_PAGE_PATTERNS if "u2200" not in p) + "|[" + chr(0x2200) + "-" + chr(0x22FF) + "])"


@register("p9_page_candidates", f"""select doc_id, coalesce(regexp_matches(t, '{CHART_SQL}'), false) as chart_candidate, coalesce(regexp_matches(t, '{FORMULA_PAGE_SQL}'), false) as formula_candidate from (select doc_id, {MARKED} as t from documents)""")
def p9_pages(spark, sf):
    d = fx.table(spark, sf, "documents").withColumn("text", F.expr(MARKED))
    return clean.flag_page_candidates(d).select("doc_id", "chart_candidate", "formula_candidate")


KIND = "(['formula', 'Chart', 'imagine', 'tabella', 'testo'])[cast(doc_id % 5 as int) + 1]"
RICH = "case when doc_id % 7 = 0 then '![x] ' || text when doc_id % 11 = 0 then '|--- ' || text else text end"


def typed(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.expr("element_at(array('formula', 'Chart', 'imagine', 'tabella', 'testo'), cast(doc_id % 5 as int) + 1)").alias("toon_type"),
        F.expr("case when doc_id % 13 = 0 then doc_id end").alias("image_id"),
        F.expr("case when doc_id % 7 = 0 then '![x] ' || text when doc_id % 11 = 0 then '|--- ' || text else text end").alias("text"),
    )


@register("p10_chunk_type", f"""with c as (select doc_id, lower({KIND}) as k, case when doc_id % 13 = 0 then doc_id end as image_id, coalesce({RICH}, '') as t from documents)
 select doc_id, case when k in ('formula', 'math', 'equation') then 'formula' when image_id is not null then 'image' when {contains_any('t', L.VISUAL_MARKS)} then 'image' when {contains_any('t', L.TABLE_MARKS)} then 'table'
 when k in ('chart', 'grafico', 'chart_analysis') then 'chart' when k in ('image', 'immagine', 'imagine', 'visual', 'screenshot') then 'image' when k in ('table', 'tabella') then 'table' else 'text' end as chunk_type from c""")
def p10(spark, sf):
    return clean.classify_chunk_type(typed(spark, sf)).select("doc_id", "chunk_type")


@register("p11_visual_chunks", f"""with c as (select doc_id, {T} as t, len(regexp_extract_all(' ' || regexp_replace({T}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ', '(?i)[^\\p{{L}}\\p{{N}}_](the|and|une|{L.VISUAL_WORDS})[^\\p{{L}}\\p{{N}}_]')) >= 2 as terms from documents)
 select doc_id, ({contains_any('t', L.VISION_MARKS)} or terms) and not (contains(t, '$$') and not terms) as visual from c""")
def p11(spark, sf):
    return clean.classify_visual_chunks(fx.table(spark, sf, "documents"), f"the|and|une|{L.VISUAL_WORDS}").select("doc_id", "visual")


TYPES = "['Math', 'screenshot', 'diagramma', 'tabella', '', 'audio']"


@register("p12_source_type", f"""select doc_id, case when t = 'math' then 'formula' when t = 'screenshot' then 'image' when t = 'diagramma' then 'chart' when t = 'tabella' then 'table' when t = '' then 'text' else t end as source_type
 from (select doc_id, lower(({TYPES})[cast(doc_id % 6 as int) + 1]) as t from documents)""")
def p12(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.expr("element_at(array('Math', 'screenshot', 'diagramma', 'tabella', '', 'audio'), cast(doc_id % 6 as int) + 1)").alias("source_type"))
    return clean.normalize_source_type(d)


@register("p13_tier", "select doc_id, (['A', 'B', 'C', 'GRAPH', 'USER', 'C', 'X9'])[cast(doc_id % 7 as int) + 1] as tier from documents")
def p13(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.expr("element_at(array('TIER_A_METHODOLOGY', 'b', 'tier_c_evidence', 'graph_db', 'user', '', 'x9'), cast(doc_id % 7 as int) + 1)").alias("tier"))
    return clean.normalize_tier(d)


@register("p14_doc_name", "select doc_id, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') || doc_id as filename from documents")
def p14(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/in box/"), F.initcap("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("_out.PDF")).alias("filename"))
    return clean.normalize_doc_name(d)


@register("p15_requested_doc", f"""with {fx.CANDIDATES_SQL} select query_id, chunk_uuid from cand where query_id % 4 = 3 or filename = 'src' || (query_id % 4) || '.md'""")
def p15(spark, sf):
    c = fx.candidates(spark, sf)
    asked = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.expr("case when o_orderkey % 4 = 3 then '' else 'Src' || (o_orderkey % 4) || '_out.pdf' end").alias("active_doc"))
    return clean.filter_requested_doc(c, asked).select("query_id", "chunk_uuid")


@register("p16_small_assets", "select doc_id, strlen(text) as bytes from documents where strlen(text) >= 2000")
def p16(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("image_data"))
    return clean.filter_small_assets(d).select("doc_id", F.octet_length("image_data").cast("long").alias("bytes"))


@register("p17_embedding_text", f"select doc_id, substring({squeeze(T)}, 1, 1800) as text from documents")
def p17(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" Doc: a | b\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return clean.prep_embedding_text(d)
