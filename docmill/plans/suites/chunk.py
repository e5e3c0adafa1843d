"""Queries of the chunking operators."""

from pyspark.sql import functions as F

from docmill.operators import chunk
from docmill.plans import fixtures as fx
from docmill.plans.registry import register
from docmill.plans.suites.clean import STRIP


@register("x1_chunk_fixed", "select doc_id, cast(b // 600 as int) as pos, substring(text, b + 1, 800) as chunk from (select doc_id, coalesce(text, '') as text, unnest(range(0, greatest(length(coalesce(text, '')), 1), 600)) as b from documents)")
def x1(spark, sf):
    return chunk.chunk_fixed(fx.table(spark, sf, "documents").select("doc_id", "text"))


def paragraphs(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.concat("source", F.lit(".md")).alias("filename"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(".\n"), F.lit(".\n\n")), F.lit("\n\nT"), F.lit("\n# T")).alias("text"))


@register("x2_chunk_paragraphs")
def x2(spark, sf):
    return chunk.chunk_paragraphs(paragraphs(spark, sf).drop("filename"))


@register("x3_chunk_soft")
def x3(spark, sf):
    return chunk.chunk_soft(paragraphs(spark, sf).drop("filename"), 200)


@register("x4_chunk_recursive")
def x4(spark, sf):
    return chunk.chunk_recursive(paragraphs(spark, sf).drop("filename"))


@register("x5_chunk_markdown")
def x5(spark, sf):
    return chunk.chunk_markdown(paragraphs(spark, sf), tokens=150)


@register("x5_markdown_pages")
def x5_pages(spark, sf):
    """Documents that begin with the mark of their second page."""
    d = paragraphs(spark, sf)
    return chunk.chunk_markdown_pages(d.withColumn("text", F.concat(F.lit("# PAGE 2\n\n"), F.coalesce("text", F.lit("")))))


@register("x6_section_hints", f"""with {fx.PAGES_SQL}, l as (select doc_id, page_no, list_filter((list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: {STRIP % 'x'}), lambda x: x != ''))[1:15],
 lambda x: length(x) between 4 and 90 and length(x) - length(replace(x, '.', '')) <= 1 and not ends_with(x, '.')) as good from pg) select doc_id, page_no, coalesce(good[1], '') as section_hint from l""")
def x6(spark, sf):
    return chunk.section_hints(fx.pages(spark, sf)).select("doc_id", "page_no", "section_hint")


@register("x7_chunk_ids", f"""with {fx.CHUNKS_SQL} select doc_id, chunk_index, content as text, substring(sha256(doc_id || '::p' || page_no || '::i' || chunk_index || '::text::' || substring(sha256(content), 1, 16) || case when doc_id % 13 = 0 then '::img' || doc_id else '' end), 1, 32) as chunk_uuid from chunks""")
def x7(spark, sf):
    c = fx.chunks(spark, sf).select("doc_id", "page_no", "chunk_index", F.lit("text").alias("toon_type"), F.col("content").alias("text"), F.expr("case when doc_id % 13 = 0 then doc_id end").alias("image_id"))
    return chunk.chunk_ids(c).select("doc_id", "chunk_index", "text", "chunk_uuid")


@register("w2_context_windows", f"""with {fx.CHUNKS_SQL} select doc_id, chunk_index, coalesce(lag(right(content, 260)) over w, '') as context_prev, coalesce(lead(left(content, 260)) over w, '') as context_next from c1 window w as (partition by doc_id order by chunk_index)""")
def w2(spark, sf):
    c = fx.chunks(spark, sf).where(~F.col("content").endswith(" (rev)")).select("doc_id", "chunk_index", F.col("content").alias("text"))
    return chunk.context_windows(c).drop("text")


@register("w3_page_overlap", f"""with {fx.PAGES_SQL}, b as (select doc_id, filename, page_no, {STRIP % "coalesce(text, '')"} as t from pg),
 p as (select *, coalesce(lag(case when length(t) > 40 then right(t, 250) else '' end) over (partition by doc_id order by page_no), '') as bef from b)
 select doc_id, page_no, 'Doc: ' || filename || ' | Pagina: ' || page_no || chr(10) || case when bef != '' then '... ' || bef || chr(10) else '' end || t as text_sem from p where length(t) > 40""")
def w3(spark, sf):
    return chunk.page_overlap(fx.pages(spark, sf)).select("doc_id", "page_no", "text_sem")


@register("w9_chunk_index", f"with {fx.CHUNKS_SQL} select doc_id, page_no, cast(chunk_index % 3 as int) as pos, cast(row_number() over (partition by doc_id order by page_no, chunk_index % 3) - 1 as int) as chunk_index from c1")
def w9(spark, sf):
    c = fx.chunks(spark, sf).where(~F.col("content").endswith(" (rev)")).select("doc_id", "page_no", (F.col("chunk_index") % 3).alias("pos"))
    return chunk.assign_chunk_index(c)


@register("d4_page_chunks", f"with {fx.CHUNKS_SQL} select doc_id, page_no, pos, text from (select doc_id, page_no, chunk_index as pos, content as text, row_number() over (partition by doc_id, page_no, md5(content) order by chunk_index) as n from c1 where length(content) >= 100) where n = 1")
def d4(spark, sf):
    c = fx.chunks(spark, sf).where(~F.col("content").endswith(" (rev)")).select("doc_id", "page_no", F.col("chunk_index").alias("pos"), F.col("content").alias("text"))
    return chunk.dedupe_page_chunks(c)
