"""Fusion, ranking, diversification, de-duplication and packing of retrieved sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.clean import doc_name, squeeze
from docmill.sources.shared import new_folder, stored

#: The order in which channels give a candidate its attributes.
CHANNELS = ["vector", "doc_scope", "phrase", "text", "graph", "expansion"]


def limit_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | Column) -> DataFrame:
    """W-4. n: a number, or a column that is the same throughout a group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def merge_candidates(hits: DataFrame) -> DataFrame:
    """D-1. hits: query_id, chunk_uuid, channel, score, filename, page, tier, and optionally toon_type. One row a query and chunk: the best score of each channel, attributes from the first channel in order, provenance."""
    order = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel"))
    named = [c for c in ("filename", "page", "tier", "toon_type") if c in hits.columns]
    best = [F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"{c}_score") for c in CHANNELS]
    attrs = F.min(F.struct(order.alias("o"), *map(F.col, named))).alias("a")
    rows = hits.groupBy("query_id", "chunk_uuid").agg(*best, attrs, F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col("channel")))).alias("c"))
    return rows.select("query_id", "chunk_uuid", *[f"{c}_score" for c in CHANNELS], *[f"a.{c}" for c in named], F.array_join(F.transform("c", lambda x: x["channel"]), " + ").alias("provenance"))


def rrf_fuse(cands: DataFrame, k: int = 60, channels: tuple[str, ...] = ("vector_score", "text_score", "graph_score")) -> DataFrame:
    """W-6. Sum over channels of 1 / (k + rank) among candidates with a score over 0; ties by chunk_uuid."""
    out, total = cands, F.lit(0.0)
    for c in channels:
        order = Window.partitionBy("query_id").orderBy(F.when(F.col(c) > 0, F.col(c)).desc_nulls_last(), "chunk_uuid")
        out = out.withColumn(f"_{c}", F.when(F.col(c) > 0, F.row_number().over(order)))
        total = total + F.coalesce(1 / (k + F.col(f"_{c}")), F.lit(0.0))
    return out.withColumn("rrf", total).drop(*[f"_{c}" for c in channels])


def rank_candidates(cands: DataFrame, keep: int = 35, rerank: DataFrame | None = None, own_keep: str | None = None) -> DataFrame:
    """K-8. cands: query_id, chunk_uuid, rrf, name_hits, tier, evidence, in_doc, on_page, intent_type. Keeps the best by pre-score; the final score adds a re-ranker's, where there is one (query_id, chunk_uuid, rerank_score). own_keep: a column with a query's own number to keep."""
    tier = F.when(F.col("tier") == "A", 0.08).when(F.col("tier") == "B", 0.04).when((F.col("tier") == "C") & ~F.col("evidence"), -0.015).otherwise(0.0)
    intent = F.when(F.col("intent_type") == "formula", 0.25).when(F.col("intent_type").isin("chart", "table"), 0.20).otherwise(0.0)
    pre = F.col("rrf") + 0.02 * F.least("name_hits", F.lit(3)) + tier + F.when(F.col("in_doc"), 0.20).otherwise(0.0) + F.when(F.col("on_page"), 0.30).otherwise(0.0) + intent
    some = limit_per_group(cands.withColumn("pre_score", pre), ["query_id"], [F.desc("pre_score"), F.col("chunk_uuid")], F.col(own_keep) if own_keep else keep)
    if rerank is None:
        return some.withColumn("score", F.col("pre_score"))
    return some.join(rerank, ["query_id", "chunk_uuid"], "left").withColumn("score", F.coalesce(F.col("rerank_score") + F.col("pre_score"), "pre_score")).drop("rerank_score")


def diversify(cands: DataFrame, max_page: int | Column = 2, max_doc: int | Column = 5, k: int | Column = 8) -> DataFrame:
    """W-5. The greedy choice by score with limits for each page and file, as two chained window filters; limits are numbers, or columns of each query's own."""
    order = [F.desc("score"), F.col("chunk_uuid")]
    by_page = limit_per_group(cands, ["query_id", "filename", "page"], order, max_page)
    return limit_per_group(limit_per_group(by_page, ["query_id", "filename"], order, max_doc), ["query_id"], order, k)


def enrich_candidates(cands: DataFrame, chunks: DataFrame, versions: bool = True) -> DataFrame:
    """J-2. Joins texts last, from the newest versions (versions=False: chunks has only these): the semantic text, else the content. Repairs file, page and, where cands has it, type only where they are unknown; adds the provenance columns that chunks has (ingestion_ts as pg_ingestion_ts, source_name, source_type, log_id, chunk_index)."""
    from docmill.operators.search import latest_versions

    own = chunks.join(cands.select("chunk_uuid").distinct(), "chunk_uuid", "left_semi")
    own = latest_versions(own) if versions else own
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text_sem", "content_semantic", "content_raw", "content") if c in chunks.columns], F.col("content") if "content" in chunks.columns else F.lit(None).cast("string"))
    typed = "toon_type" in cands.columns and "toon_type" in chunks.columns
    said = {"pg_source_name": "source_name", "pg_source_type": "source_type", "pg_log_id": "log_id"}
    extra = [F.col(c).alias(k) for k, c in said.items() if c in chunks.columns]
    own = own.select("chunk_uuid", F.col("filename").alias("_f"), F.col("page_no").alias("_p"), *([F.col("toon_type").alias("_t")] if typed else []), text.alias("content"), *extra)
    unknown = F.coalesce(F.lower("filename").isin("", "unknown", "kg"), F.lit(True))
    out = cands.join(own, "chunk_uuid", "left").withColumn("filename", F.when(unknown, F.coalesce("_f", "filename")).otherwise(F.col("filename")))
    out = out.withColumn("page", F.when(F.coalesce("page", F.lit(0)) == 0, F.coalesce("_p", "page")).otherwise(F.col("page"))).drop("_f", "_p")
    return out.withColumn("toon_type", F.when(F.coalesce("toon_type", F.lit("")).isin("", "graph"), F.coalesce("_t", "toon_type")).otherwise(F.col("toon_type"))).drop("_t") if typed else out


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """D-2. sources: query_id, pos, id, filename, page, type, content, score, origin. Equal ids, or else equal document, page, type and beginning, are one source: longest content, best score, all origins."""
    short = F.substring(F.sha2(F.substring(F.lower(squeeze(F.coalesce("content", F.lit("")))), 1, 900), 256), 1, 16)
    named = F.coalesce(F.col("id"), F.lit(""))
    key = F.when(~named.isin("", "graph", "neo4j_relations"), F.concat(F.lit("id:"), named)).otherwise(F.concat_ws("|", F.lit("content"), doc_name(F.col("filename")), F.coalesce("page", F.lit(0)).cast("string"), F.col("type"), short))
    rows = sources.withColumn("_key", key)
    longest = F.struct(F.char_length("content").alias("n"), (-F.col("pos")).alias("p"))
    return (
        rows.groupBy("query_id", "_key")
        .agg(
            F.min("pos").alias("pos"),
            F.min_by("id", "pos").alias("id"),
            F.min_by("filename", F.when(F.col("filename") != "", F.col("pos"))).alias("filename"),
            F.min_by("page", F.when(F.col("page") != 0, F.col("pos"))).alias("page"),
            F.min_by("type", "pos").alias("type"),
            F.max_by("content", longest).alias("content"),
            F.max("score").alias("score"),
            F.array_join(F.array_sort(F.collect_set("origin")), " + ").alias("origin"),
        )
        .drop("_key")
    )


def compact_sources(sources: DataFrame) -> DataFrame:
    """D-3. One source for each document, page and type, the best; graph and formula sources by id."""
    apart = (F.col("type") == "formula") | (F.col("origin") == "GRAPH")
    key = F.when(apart, F.concat(F.lit("id:"), F.coalesce("id", F.lit("")))).otherwise(F.concat_ws("|", doc_name(F.col("filename")), F.col("page").cast("string"), "type"))
    return limit_per_group(sources.withColumn("_key", key), ["query_id", "_key"], [F.desc("score"), F.col("pos")], 1).drop("_key")


def pack_context(sources: DataFrame, max_chars: int = 16_000, reserve: int = 50, least: int = 200) -> DataFrame:
    """W-7. sources: query_id, pos, header, content. Blocks in order while they fit; the first that does not is cut, or dropped if little would be left, and packing ends. A null header or content is empty."""
    sources = sources.withColumns({c: F.coalesce(c, F.lit("")) for c in ("header", "content")})
    order = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("header") + F.char_length("content") + 2
    before = F.coalesce(F.sum(size).over(order), F.lit(0))
    room = max_chars - F.col("_before") - F.char_length("header") - reserve
    rows = sources.withColumn("_before", before).withColumn("_size", size)
    fits = F.col("_before") + F.col("_size") <= max_chars
    body = F.when(fits, F.col("content")).otherwise(F.substring("content", F.lit(1), F.greatest(room, F.lit(0)).cast("int")))
    kept = rows.where((F.col("_before") <= max_chars) & (fits | (room > least)))
    # Only the first block that overflows may be cut; later ones have a larger sum before them than the limit.
    return kept.withColumn("body", body).drop("_before", "_size")


def tier_contexts(sources: DataFrame) -> DataFrame:
    """X-22. Numbered snippets of each query and tier, joined in order."""
    number = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy("pos"))
    line = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.col("content"))
    parts = sources.withColumn("_line", F.struct(number.alias("n"), line.alias("t"))).groupBy("query_id", "tier").agg(F.array_sort(F.collect_list("_line")).alias("l"))
    return parts.select("query_id", "tier", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("context"))


def force_tier_a(sources: DataFrame, queries: DataFrame, tier_a: DataFrame) -> DataFrame:
    """D-9. queries: query_id, audit. Audit queries without a source of tier A get one, from the rows of tier_a (query_id, rank, content); its pos is 0."""
    lacking = queries.where("audit").select("query_id").join(sources.where("tier = 'A'").select("query_id").distinct(), "query_id", "left_anti")
    joined = tier_a.join(lacking, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("l"))
    made = joined.select("query_id", F.lit(0).alias("pos"), F.lit("A").alias("tier"), F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("content"))
    return sources.select("query_id", "pos", "tier", "content").unionByName(made)


def search_tier_a(sources: DataFrame, queries: DataFrame, vectors: DataFrame, texts: DataFrame, k: int = 15, digits: int | None = None, folder: str | None = None) -> DataFrame:
    """D-9 with its route and its search. sources: query_id, pos, tier, content. queries: query_id, query, embedding. vectors: chunk_uuid, embedding, tier. texts: chunk_uuid, content.

    Questions that X-20 sends to tier A, checklists apart, and that have no source of it get
    one at pos 0: the texts of the k nearest vectors of tier A (K-2), the nearest first, blank
    ones left out. A null query asks for nothing; a query without a usable vector, or whose
    texts are all blank, gets no source. Only lacking questions are searched for. They and
    their hits are written to the shared folder, in `folder`.
    """
    from docmill.operators.query import route_queries
    from docmill.operators.search import vector_topk_filtered

    folder = folder or new_folder(queries.sparkSession, "tier-a")
    routed = route_queries(queries).where("is_tier_a and not is_checklist").select("query_id", "embedding")
    lacking = stored(routed.join(sources.where("upper(tier) = 'A'").select("query_id").distinct(), "query_id", "left_anti"), f"{folder}/lacking")
    hits = stored(vector_topk_filtered(lacking, vectors, "A", k, digits).select("query_id", "chunk_uuid", "rank"), f"{folder}/hits")
    found = hits.join(texts.select("chunk_uuid", "content").where(F.trim("content") != ""), "chunk_uuid").select("query_id", "rank", "content")
    return force_tier_a(sources, lacking.select("query_id", F.lit(True).alias("audit")), found)


def tier_distribution(sources: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """A-6. Sources of each query by tier, and the range of their scores; with hits (query_id, channel) also the candidates of each channel."""
    tiers = [F.count_if(F.col("tier") == t).alias(f"n_{t.lower()}") for t in ("A", "B", "C", "GRAPH", "USER")]
    out = sources.groupBy("query_id").agg(*tiers, F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"))
    if hits is None:
        return out
    counts = hits.groupBy("query_id").agg(*[F.count_if(F.col("channel") == c).alias(f"{c}_hits") for c in CHANNELS])
    return counts.join(out, "query_id", "left").na.fill(0, [f"n_{t}" for t in ("a", "b", "c", "graph", "user")] + ["n"])


def tail_turns(conversations: DataFrame, most: int = 3) -> DataFrame:
    """W-8. The last turns of user and assistant, runs of one role as their last turn, beginning with the user."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = conversations.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    last = said.withColumn("_next", F.lead("role").over(order)).where("_next is null or _next != role").drop("_next")
    late = limit_per_group(last, ["conv_id"], [F.desc("turn")], 2 * most)
    return late.withColumn("_n", F.row_number().over(order)).where("not (_n = 1 and role = 'assistant')").drop("_n")
