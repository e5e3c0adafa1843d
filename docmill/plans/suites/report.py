"""Queries of metrics, maintenance, sources, streams and model columns."""

from pyspark.sql import functions as F

from docmill.functions.models import with_scorer
from docmill.operators import extract, maintain, report
from docmill.plans import fixtures as fx
from docmill.plans.registry import register
from docmill.sources import files
from docmill.sources.shared import new_folder
from docmill.streaming import ingest, snapshots


def scratch(spark) -> str:
    """A new folder below the session's shared folder."""
    return new_folder(spark, "plan")


@register("a5_ingestion_summary", f"""with {fx.CHUNKS_SQL}, n as (select doc_id, count(*) as n from c1 where doc_id % 6 != 0 group by 1)
 select d.doc_id, case when n is null then 'FAILED' else 'DONE' end as status, coalesce(n, 0) as total_chunks, d.doc_id % 1000 as processing_time_ms, case when n is null then 'No chunks extracted' end as error_message from documents d left join n on n.doc_id = d.doc_id""")
def a5(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.lit("2024-01-01").cast("timestamp").alias("started"), F.expr("timestamp_micros(unix_micros(timestamp '2024-01-01') + (doc_id % 1000) * 1000)").alias("ended"))
    c = fx.chunks(spark, sf).where("doc_id % 6 != 0 and not endswith(content, ' (rev)')")
    return report.ingestion_summary(d, c)


@register("a10_eval_quality", """with l as (select 'm' || (doc_id % 3) as llm_model, least(1.0, quality * 1.2) as f, 1 - toxic / 2 as r, doc_id % 7 = 0 as v, case when doc_id % 11 = 0 then 'FAIL' end as given from labels),
 v as (select *, coalesce(given, case when f >= 0.75 and r >= 0.7 and not v then 'PASS' when f >= 0.55 then 'WARN' else 'FAIL' end) as verdict from l)
 select llm_model, count(*) as n, count(*) filter (verdict = 'PASS') as n_pass, count(*) filter (verdict = 'WARN') as n_warn, count(*) filter (verdict = 'FAIL') as n_fail, round(avg(f), 5)::double as faithfulness, round(avg(r), 5)::double as relevance from v group by llm_model""")
def a10(spark, sf):
    log = fx.table(spark, sf, "labels").select(F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("llm_model"), (F.col("quality") * 1.2).cast("double").alias("faithfulness"), (1 - F.col("toxic") / 2).alias("relevance"), (F.col("doc_id") % 7 == 0).alias("scope_violation"), F.when(F.col("doc_id") % 11 == 0, "FAIL").alias("verdict"))
    return report.eval_quality(log).withColumns({c: F.round(c, 5) for c in ("faithfulness", "relevance")})


@register("a11_control_coverage", "select l_suppkey, count(*) as total, round((count(*) filter (l_linestatus = 'F') + count(*) filter (l_linestatus = 'O') * 0.5) / count(*) * 100, 5)::double as coverage from lineitem group by l_suppkey")
def a11(spark, sf):
    c = fx.table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_linestatus") == "F", "implemented").otherwise("partial").alias("status"))
    return report.control_coverage(c, "l_suppkey").withColumn("coverage", F.round("coverage", 5))


@register("a12_risk_ranking", "select l_partkey, round(risk, 1)::double as risk, cast(rank() over (order by risk desc) as int) as rank from (select l_partkey, sum(cast(l_discount * l_extendedprice as decimal(28, 6))) as risk from lineitem group by l_partkey)")
def a12(spark, sf):
    r = fx.table(spark, sf, "lineitem").select("l_partkey", F.col("l_discount").alias("probability"), F.col("l_extendedprice").alias("impact"))
    return report.risk_ranking(r, "l_partkey").withColumn("risk", F.round("risk", 1))


SLA = [("1-URGENT", 4), ("2-HIGH", 24), ("3-MEDIUM", 72)]


@register("a13_sla_cumulative", """with n as (select o_custkey, o_orderpriority, count(*) as n from orders group by all), h as (select n.*, max_hours from n join (values ('1-URGENT', 4), ('2-HIGH', 24), ('3-MEDIUM', 72)) as s(severity, max_hours) on severity = o_orderpriority)
 select o_custkey, cast(sum(n * max_hours) as bigint) as hours, count(*) as severities from h group by o_custkey having count(*) >= 2""")
def a13(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("severity"))
    return report.sla_cumulative(o, spark.createDataFrame(SLA, "severity string, max_hours int"), "o_custkey")


@register("a14_rosi", """with s as (select o_custkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as c from orders group by 1)
 select o_custkey, c * 8 as ale0, c * 2 as ale1, c * 5 as net, 500.0::double as rosi from s where c > 0""")
def a14(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = fx.table(spark, sf, "orders").select("o_custkey", cents.alias("impact"), F.lit(8).alias("p0"), F.lit(2).alias("p1"), cents.alias("cost"))
    return report.rosi(o, "o_custkey").select("o_custkey", "ale0", "ale1", "net", "rosi")


@register("a15_budget_remainder", """with s as (select c_custkey % 50 as k, sum(c_custkey % 7 + 1) as used, count(*) as n from customer where c_custkey % 11 < 3 group by 1), t as (select c_custkey % 50 as k, sum(c_nationkey) as total from customer group by 1)
 select k, cast(100 - used as bigint) as percent, round(total * (100 - used) / 100, 4)::double as amount from s join t using (k) where n >= 2 and used <= 100""")
def a15(spark, sf):
    c = fx.table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 50)
    shares = c.where("c_custkey % 11 < 3").select("k", (F.col("c_custkey") % 7 + 1).alias("percent"))
    out = report.budget_remainder(shares, c.groupBy("k").agg(F.sum("c_nationkey").alias("total")), "k")
    return out.withColumn("amount", F.round("amount", 4))


@register("a16_deadlines", "select event_id, hours, cast(epoch_us(ts) as bigint) + hours * 3600000000 as deadline, dayname(ts + to_hours(hours)) as weekday, 68 as span_hours from events, (values (4), (24), (72)) as h(hours)")
def a16(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return report.deadline_offsets(e, [4, 24, 72]).withColumn("deadline", F.unix_micros("deadline"))


CHART_SQL = """p as (select cast(event_id // 100 as bigint) as doc_id, event_type, sum(cast(round(value * 100) as bigint)) as v from events group by all),
 n as (select doc_id, count(*) as n, string_agg(' - ' || event_type || ': ' || case when doc_id % 2 = 0 then v || '' else v || ', 1' end, chr(10) order by event_type) as points, array_to_string((list(event_type || '=' || case when doc_id % 2 = 0 then v || '' else v || ', 1' end order by event_type))[1:12], '|') as numbers from p group by 1),
 c as (select *, case when doc_id % 3 = 0 then '' else 'day ' || doc_id end as title, case when doc_id % 5 = 0 then '2024' when doc_id % 5 = 1 then '' else '2023 vs 2024' end as timeframe from n),
 f as (select *, case when doc_id % 7 = 0 then 0.9 else least(0.95, 0.25 + case when title = '' then 0 else 0.15 end + case when doc_id % 4 = 0 then 0.05 else 0 end + case when n >= 2 then 0.25 else 0 end + case when n >= 4 then 0.1 else 0 end + case when timeframe = '' then 0 else 0.1 end) end as confidence from c)"""


@register("x17_chart_json", f"""with {CHART_SQL} select doc_id, 1 as page_no, case when doc_id % 5 = 1 then 'image' else 'bar_chart' end as kind, title, timeframe, cast(n as int) as n_points, round(confidence, 6)::double as confidence, numbers,
 case when title = '' then '' else title || chr(10) end || points as text from f where confidence >= 0.55""")
def x17(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("doc_id", F.expr("event_id div 100"))
    p = e.groupBy("doc_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    k = F.col("doc_id")
    listed = lambda f: F.array_sort(F.collect_list(F.struct(*f)))
    points = p.groupBy("doc_id").agg(listed([F.col("event_type").alias("category"), F.col("v").alias("value")]).alias("one"), listed([F.col("event_type").alias("labels"), F.array("v", F.lit(1)).alias("values")]).alias("two"))
    common = [F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("day "), k.cast("string"))).alias("title"), F.when(k % 4 == 0, "EUR").alias("unit_of_measure"), F.when(k % 7 == 0, 0.9).alias("confidence"), F.lit("NOT READABLE").alias("timeframe")]
    axis = F.when(k % 5 == 0, F.array(F.lit("Q1 2024"))).when(k % 5 > 1, F.array(F.lit("2023"), F.lit("H2 2024")))
    raw = F.when(k % 2 == 0, F.to_json(F.struct(*common, axis.alias("x_axis_labels"), F.col("one").alias("data_points")))).otherwise(F.to_json(F.struct(*common, axis.alias("x-axis_labels"), F.col("two").alias("data_points"))))
    again = F.to_json(F.struct(F.array(F.struct(F.lit("a").alias("category"), F.lit("not_readable").alias("value"))).alias("data_points")))
    both = points.select("doc_id", F.lit(1).alias("page_no"), F.explode(F.array(F.struct(F.lit(1).alias("pass"), raw.alias("raw")), F.struct(F.lit(2).alias("pass"), again.alias("raw")))).alias("r")).select("doc_id", "page_no", "r.pass", "r.raw")
    out = report.normalize_chart_json(both)
    return out.withColumn("numbers", F.array_join(F.transform("numbers", lambda x: F.concat_ws("=", x["label"], x["value"])), "|"))


#: A chart for each customer, of its orders by priority: some categories are qualified by a south.
LABELS = ["1-URGENT South", "Italia sud", "Sudan", "4-NOT SPECIFIED", "5-LOW"]


@register("x17_sanitized", f"""with p as (select o_custkey as k, (array[{", ".join(f"'{x}'" for x in LABELS)}])[cast(left(o_orderpriority, 1) as int)] as l, count(*) as v, min(year(o_orderdate)) as y0, max(year(o_orderdate)) as y1 from orders group by 1, 2),
 c as (select k, min(y0) as y0, max(y1) as y1, count(*) filter (l not in ('1-URGENT South', 'Italia sud')) as n, string_agg(l || '=' || v, '|' order by l) filter (l not in ('1-URGENT South', 'Italia sud')) as numbers from p group by k)
 select k as doc_id, case when k % 4 = 0 then 'NOT READABLE' when y0 = y1 then y0::varchar else y0 || ' vs ' || y1 end as timeframe, cast(n as int) as n_points, coalesce(numbers, '') as numbers from c""")
def x17s(spark, sf):
    o = fx.table(spark, sf, "orders")
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.substring("o_orderpriority", 1, 1).cast("int"))
    p = o.groupBy(F.col("o_custkey").alias("doc_id"), label.alias("category")).agg(F.count("*").alias("value"), F.min(F.year("o_orderdate")).alias("y0"), F.max(F.year("o_orderdate")).alias("y1"))
    c = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("category", "value"))).alias("data_points"), F.min("y0").cast("string").alias("y0"), F.max("y1").cast("string").alias("y1"))
    period = F.when(F.col("doc_id") % 4 == 0, "the last twelve months").otherwise(F.concat(F.lit("FY"), F.lit(" "), "y1", F.lit(" against "), "y0", F.lit(", Q1 "), "y1"))
    raw = F.to_json(F.struct(F.lit(0.9).alias("confidence"), period.alias("timeframe"), "data_points"))
    out = report.normalize_chart_json(c.select("doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("pass"), raw.alias("raw")), sanitize=True)
    return out.select("doc_id", "timeframe", "n_points", F.array_join(F.transform("numbers", lambda x: F.concat_ws("=", x["label"], x["value"])), "|").alias("numbers"))


@register("x17_formula_texts", """select p_partkey as doc_id, 1 as page_no, case when p_size % 2 = 0 then 'about ' || p_brand || chr(10) else '' end || '## ' || case when p_size % 3 = 0 then 'sum' else 'Formula' end || chr(10) || '$$a + ' || p_size || '$$' || chr(10) || 'a: first; b' as text from part""")
def x17f(spark, sf):
    p = fx.table(spark, sf, "part")
    latex = F.concat(F.lit("a + "), F.col("p_size").cast("string"))
    f = F.array(F.struct(F.when(F.col("p_size") % 3 == 0, "sum").otherwise("").alias("description_it"), latex.alias("latex"), F.array(F.lit('{"name": "a", "meaning": "first"}'), F.lit("b")).alias("variables")))
    raw = F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("about "), "p_brand")).alias("summary_it"), f.alias("formulas")))
    return report.formula_texts(p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), raw.alias("raw")))


@register("d5_dedupe_images", """with i as (select doc_id, sha256(text) as h from documents where text is not null), o as (select h, min(doc_id) as o from i group by h), x as (select h, min(doc_id) + 1000000 as e from i where doc_id % 10 = 0 group by h)
 select doc_id as image_id, coalesce(e, o) as canonical_id, e is null and doc_id = o as is_new from i join o using (h) left join x using (h)""")
def d5(spark, sf):
    d = fx.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("image_data"))
    old = d.where("image_id % 10 = 0").select((F.col("image_id") + 1_000_000).alias("image_id"), F.sha2("image_data", 256).alias("image_hash"))
    return maintain.dedupe_images(d, old).select("image_id", "canonical_id", "is_new")


@register("d6_upsert", f"with {fx.CHUNKS_SQL}, n as (select chunk_uuid, content from chunks where doc_id % 10 = 0 and ends_with(content, ' (rev)')) select chunk_uuid, content from c1 where chunk_uuid not in (select chunk_uuid from n) union all select * from n")
def d6(spark, sf):
    c = fx.chunks(spark, sf).select("chunk_uuid", "content")
    new = F.col("content").endswith(" (rev)")
    return maintain.upsert_chunks(c.where(~new), c.where(new))


@register("d10_purge", f"with {fx.CHUNKS_SQL} select 'vectors' as kind, chunk_uuid as id from c1 where doc_id % 7 != 0 union all select 'chunks', chunk_uuid from c1 where doc_id % 7 != 0 union all select 'logs', cast(doc_id as varchar) from documents where doc_id % 7 != 0")
def d10(spark, sf):
    c = fx.chunks(spark, sf).where(~F.col("content").endswith(" (rev)")).withColumn("log_id", F.col("doc_id"))
    logs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), F.concat_ws("", "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_name"))
    left = maintain.purge_documents({"logs": logs, "chunks": c, "vectors": c}, logs.where("log_id % 7 = 0").select(F.col("source_name").alias("filename")))
    row = lambda kind, col: left[kind].select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("id"))
    return row("vectors", "chunk_uuid").unionByName(row("chunks", "chunk_uuid")).unionByName(row("logs", "log_id"))


@register("s2_text_corpus", "select doc_id, length(coalesce(text, '')) as n from documents where text is not null and text != ''")
def s2(spark, sf):
    path = scratch(spark)
    fx.table(spark, sf, "documents").where("text is not null and text != ''").select(F.concat(F.col("doc_id").cast("string"), F.lit("\x01"), F.replace("text", F.lit("\n"), F.lit("\x02"))).alias("value")).write.text(path)
    rows = files.scan_text_corpus(spark, path).select(F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))
    parts = F.split("line", "\x01", 2)
    return rows.where("line != ''").select(parts[0].cast("long").alias("doc_id"), F.char_length(parts[1]).cast("long").alias("n"))


@register("s4_chunks_by_day", f"with {fx.CHUNKS_SQL} select strftime(ingestion_ts, '%Y-%m-%d') as day, count(*) as n from chunks group by 1")
def s4(spark, sf):
    path = scratch(spark)
    files.write_chunks(fx.chunks(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("ingest_date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@register("s5_vectors", f"with {fx.CHUNKS_SQL} select tier, count(distinct chunk_uuid) as n from chunks group by tier")
def s5(spark, sf):
    path = scratch(spark)
    files.write_vectors(fx.chunks(spark, sf), path, [F.desc("ingestion_ts"), F.col("content")])
    return spark.read.parquet(path).groupBy("tier").agg(F.count("*").alias("n"))


@register("s6_graph", "select l_returnflag as relation, count(distinct (l_suppkey, l_partkey)) as n from lineitem group by 1")
def s6(spark, sf):
    path = scratch(spark)
    li = fx.table(spark, sf, "lineitem")
    files.write_graph(li.select(F.lit("Entity").alias("label"), F.col("l_partkey").alias("id")).distinct(), li.select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("target")).distinct(), path)
    return spark.read.parquet(f"{path}/edges").groupBy("relation").agg(F.count("*").alias("n"))


@register("s7_eval_log", "select doc_id % 3 as m, count(*) as n, sum(quality)::double as faithfulness from labels group by 1")
def s7(spark, sf):
    path = scratch(spark)
    rows = fx.table(spark, sf, "labels").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"), F.col("doc_id").cast("string").alias("answer"), F.struct(F.col("quality").cast("double").alias("faithfulness")).alias("metrics"), (F.col("doc_id") % 3).cast("string").alias("llm_model"))
    files.write_eval_log(rows, path)
    back = files.read_eval_log(spark, path).where("length(answer_sha256) = 64")
    return back.groupBy(F.col("llm_model").cast("long").alias("m")).agg(F.count("*").alias("n"), F.sum("metrics.faithfulness").alias("faithfulness"))


@register("s8_audit_log", "select item_id, sha256(text) as prompt_sha256, length(text) as context_size from benchmark")
def s8(spark, sf):
    path = scratch(spark)
    files.write_audit_log(fx.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt")), path)
    return spark.read.schema("item_id long, prompt_sha256 string, context_size long").json(path)


@register("u1_scorer", "select doc_id, length(coalesce(text, ''))::double as score from documents")
def u1(spark, sf):
    def load():
        return lambda s: s.str.len().astype("float64")

    d = fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_scorer(d, load, ["text"], "score", "double").drop("text")


def arriving(rows, least: int, most_rows: int = 5_000) -> int:
    """How many files the rows arrive as: at least so many, a multiple of it, and of about 5,000 documents at most, so that a file, which is one task's, doesn't grow with the table."""
    return least * max(1, -(-rows.count() // (least * most_rows)))


@register("st1_stream_ingest", "select doc_id, count(*) as n from (select doc_id, unnest(range(0, greatest(length(regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), 1), 600)) from documents) group by doc_id")
def st1(spark, sf):
    base = scratch(spark)
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    n = arriving(d, 5)
    d.repartition(n).write.parquet(f"{base}/inbox")
    ingest.drain(ingest.stream_ingest(spark, f"{base}/inbox", f"{base}/out", f"{base}/ck", files_per_trigger=-(-2 * n // 5)))
    return spark.read.parquet(f"{base}/out").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("st1_stream_corpus", "select doc_id, tier, status from (select doc_id, (['A', 'B', 'C'])[cast(doc_id % 3 as int) + 1] as tier, case when length(t) > 40 then 'DONE' else 'FAILED' end as status from (select doc_id, left(trim(regexp_replace(coalesce(text, ''), '[^\\x21-\\x7e]+', ' ', 'g')), 1800) as t from documents))")
def st1_corpus(spark, sf):
    """Documents of printable ASCII, each run of other characters one space, arriving as files of a stream."""
    base = scratch(spark)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7e]+", " "))
    folder = F.element_at(F.array(*map(F.lit, fx.FOLDERS)), (F.col("doc_id") % 3).cast("int") + 1)
    files = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), folder.alias("path"), text.alias("text"), F.lit("2024-05-01").cast("date").alias("ingest_date"), F.lit("2024-05-01").cast("timestamp").alias("ingestion_ts"))
    n = arriving(files, 4)
    files.repartition(n).write.parquet(f"{base}/inbox")
    ingest.drain(ingest.stream_corpus(spark, f"{base}/inbox", f"{base}/table", f"{base}/status", f"{base}/ck", extract.taxonomy(spark), files_per_trigger=n // 2))
    chunks = snapshots.read_table(spark, f"{base}/table", "chunk_uuid", "ingestion_ts").select("doc_id", "tier").distinct()
    states = spark.read.parquet(f"{base}/status").select("doc_id", "status")
    own = fx.table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, "ABC")), (F.col("doc_id") % 3).cast("int") + 1).alias("own"))
    return states.join(chunks, "doc_id", "left").join(own, "doc_id").select("doc_id", F.coalesce("tier", "own").alias("tier"), "status")


def sliced(spark, sf, base):
    """Events as five arriving files, by time."""
    e = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("status"), "value")
    e.repartitionByRange(5, "ts").write.parquet(f"{base}/events")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")


@register("st2_stream_upsert", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc) as n from events) where n = 1")
def st2(spark, sf):
    base = scratch(spark)
    ingest.drain(ingest.stream_upsert(sliced(spark, sf, base), f"{base}/table", f"{base}/ck", "user_id", "ts", compact_after=2))
    return ingest.read_upserted(spark, f"{base}/table", "user_id", "ts").select("user_id", "event_id")


@register("st3_stream_dedupe", "select distinct user_id from events")
def st3(spark, sf):
    base = scratch(spark)
    s = ingest.stream_dedupe(sliced(spark, sf, base), "user_id", delay="3650 days").select("user_id")
    return ingest.run_to_table(spark, s, f"{base}/out", f"{base}/ck")


@register("st4_stream_status", "select status, cast(sum(n) as bigint) as n from (select event_type as status, count(*) as n from events group by 1) group by 1")
def st4(spark, sf):
    base = scratch(spark)
    counts = ingest.stream_status(sliced(spark, sf, base), window="1 hour", delay="3650 days")
    path = f"{base}/status"

    def put(batch, batch_id):
        batch.select(F.col("window.start").alias("start"), "status", "n").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    ingest.drain(counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    whole = spark.read.parquet(path)
    last = whole.agg(F.max("batch").alias("batch"))
    return whole.join(F.broadcast(last), "batch").groupBy("status").agg(F.sum("n").alias("n"))
