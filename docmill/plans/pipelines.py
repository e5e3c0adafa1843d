"""Whole jobs composed of the operators."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators import chunk, clean, extract, fuse, graph, index, maintain, query, report, search
from docmill.sources.shared import new_folder, stored


def pages_of(files: DataFrame, page_chars: int = 1800, repeated: bool = False) -> DataFrame:
    """The first half of C-1. files: doc_id (different for each row, or `repeated` on rows of one name and text), filename, text. Chunks before they are numbered: doc_id, page_no, pos, text, section_hint.

    Markdown files are cleaned and cut by sections; other texts, those without a file name too,
    are normalised, cut into pages of page_chars characters with the end of the page before, and these recursively.
    P-3 leaves single spaces only, where P-1 would find nothing to do.
    """
    markdown = F.coalesce(F.lower("filename").endswith(".md"), F.lit(False))
    rows = files.select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"), "text", markdown.alias("_md"))
    # Each half takes its own rows first, so that no text is dealt out for both; and after the Arrow function, as Spark forgets there how rows were dealt out.
    own = lambda half: half.dropDuplicates(["doc_id"]) if repeated else half
    marked = chunk.chunk_markdown(own(rows.where("_md").drop("_md"))).select("doc_id", F.lit(1).alias("page_no"), F.col("chunk_index").alias("pos"), F.col("chunk").alias("text"), "section_hint")
    plain = own(clean.normalize_unicode(rows.where("not _md").drop("_md")))
    hinted = chunk.section_hints(chunk.overlapping_pages(plain, page_chars))
    cut = chunk.chunk_recursive(hinted.select("doc_id", "page_no", "section_hint", F.col("text_sem").alias("text"))).select("doc_id", "page_no", "pos", F.col("chunk").alias("text"), "section_hint")
    return marked.unionByName(cut)


def ingest_corpus(files: DataFrame, taxonomy: DataFrame, existing: DataFrame | None = None, sidecars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C-1. files: doc_id, filename, path (folders), text, ingest_date, ingestion_ts, and optionally started and ended; of a folder of files see sources.files.scan_text_corpus. Chunks with tier, topics, type and identity, upserted into existing; and the status of each file (doc_id, filename, status, chunks, milliseconds).

    A file is a row: whatever its doc_id and name, null or shared with others, it has chunks,
    windows and a status of its own. Rows that are equal in doc_id, filename, path and text are one file.
    A null doc_id becomes a hash of name, path and text. A file whose pages have no more than 40
    characters, or whose Markdown sections have fewer, has no chunks and is FAILED; without
    started and ended its milliseconds are null.

    What is known of the files besides their texts is kept in the shared folder; texts are dealt
    out once, by file, and stay where they are until their chunks are written.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "filename", "path", "text")]
    keyed = files.withColumn("_file", F.sha2(F.concat_ws("\x01", *said), 256))
    times = [F.col(c) if c in files.columns else F.lit(None).cast("timestamp").alias(c) for c in ("started", "ended")]
    rows = stored(keyed.select("_file", "doc_id", "filename", "path", "ingest_date", "ingestion_ts", *times).dropDuplicates(["_file"]), new_folder(files.sparkSession, "files"))
    own = rows.withColumn("_own", F.col("doc_id")).withColumn("doc_id", F.col("_file"))
    if sidecars is not None:
        sidecars = rows.select("_file", "doc_id").join(sidecars, "doc_id").drop("doc_id").withColumnRenamed("_file", "doc_id")
    placed = extract.dispatch_tiers(own.select("doc_id", "path", "ingest_date"), taxonomy, sidecars)
    scored = own.select("doc_id", F.concat_ws(" ", "filename", F.replace("path", F.lit("/"), F.lit(" "))).alias("text"))
    topics = extract.tag_topics(scored).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda t: t["topic"]), ",").alias("topics"))
    once = chunk.assign_chunk_index(chunk.dedupe_page_chunks(pages_of(keyed.select(F.col("_file").alias("doc_id"), "filename", "text"), repeated=True), 1))
    typed = clean.classify_chunk_type(once.withColumn("toon_type", F.lit("text")).withColumn("image_id", F.lit(None).cast("long")).withColumn("filename", F.lit(""))).drop("toon_type", "filename").withColumnRenamed("chunk_type", "toon_type")
    kept = own.select("doc_id", F.coalesce(F.col("_own").cast("string"), F.substring("_file", 1, 32)).alias("_id"), "_own", "filename", "ingestion_ts")
    full = typed.join(kept.join(placed, "doc_id", "left").join(topics, "doc_id", "left"), "doc_id")
    named = chunk.chunk_ids(full.withColumnRenamed("doc_id", "_file").withColumnRenamed("_id", "doc_id")).drop("doc_id").withColumnRenamed("_own", "doc_id")
    out = stored(named.select("_file", "chunk_uuid", "doc_id", "filename", "page_no", "chunk_index", "toon_type", "section_hint", "tier", "ontology", F.coalesce("topics", F.lit("")).alias("topics"), F.col("text").alias("content"), "ingestion_ts"), new_folder(files.sparkSession, "ingested"))
    chunks = out.drop("_file")
    table = chunks if existing is None else maintain.upsert_chunks(existing, chunks)
    status = report.ingestion_summary(rows.select(F.col("_file").alias("doc_id"), "started", "ended"), out.select(F.col("_file").alias("doc_id")))
    return table, rows.select(F.col("_file"), "doc_id", "filename").join(status.withColumnRenamed("doc_id", "_file"), "_file").drop("_file")


#: What C-2 makes.
GRAPH = ("entities", "mentions", "edges", "nodes", "links", "rejected")


def build_graph(raw: DataFrame, canon: DataFrame, chunks: DataFrame, kept: DataFrame | None = None, formula_json: DataFrame | None = None, parts: tuple[str, ...] = GRAPH) -> dict[str, DataFrame]:
    """C-2. raw: doc_id, page_no, raw JSON of a model. chunks: doc_id, page_no, chunk_uuid, filename, content, ingestion_ts. kept: doc_id, page_no of the pages that passed the gate (J-3). formula_json: doc_id, page_no, raw.

    Returns entities, mentions (entity and chunk), edges, nodes and links of the structure, and
    rejected, the rows that could not be read. What a page says counts for each of its chunks.
    Model output is read once; what was read is kept in the shared folder where more than one
    table is made of it. parts: the tables that are asked for; entities and mentions need no
    edges, so these are not made for them.
    """
    page = ["doc_id", "page_no"]
    gated = raw if kept is None else raw.join(kept.select(*page).distinct(), page, "left_semi")
    spark = raw.sparkSession
    read = graph.parse_llm_json(gated).select(*page, F.when(~F.col("ok"), F.col("raw")).alias("raw"), "ok", "parsed")
    if not {"edges", "rejected"}.isdisjoint(parts):
        read = stored(read, new_folder(spark, "graph-read"))
    nodes, edges = graph.sanitize_graph(*graph.normalize_graph(read.where("ok")))
    nodes = stored(nodes, new_folder(spark, "graph-rows"))
    own = nodes.where("formula != '' and category != 'FORMULA'")
    named = F.concat(F.lit("Formula::"), "id")
    no_props = F.create_map().cast("map<string,string>").alias("props")
    made = own.select(*page, F.lit(1000).alias("pos"), named.alias("id"), F.lit("FORMULA").alias("category"), F.concat(F.lit("Formula of "), "id").alias("description"), "formula", F.array().cast("array<string>").alias("synonyms"), no_props)
    nodes = nodes.unionByName(made.join(nodes.select(*page, "id"), [*page, "id"], "left_anti"))
    if "edges" in parts:
        edges = stored(edges, new_folder(spark, "graph-rows"))
    linked = own.select(*page, F.lit(1000).alias("pos"), F.col("id").alias("source"), F.lit("HAS_FORMULA").alias("relation"), named.alias("target"), F.lit("").alias("evidence"), no_props)
    key = [*page, "source", "relation", "target"]
    edges = edges.unionByName(linked.join(edges.select(*key), key, "left_anti"))
    if formula_json is not None:
        f_nodes, f_edges = graph.formula_json_nodes(formula_json)
        nodes = nodes.unionByName(f_nodes.withColumns({"pos": F.lit(2000), "synonyms": F.array().cast("array<string>"), "props": no_props}))
        edges = edges.unionByName(f_edges.withColumns({"pos": F.lit(2000), "evidence": F.lit(""), "props": no_props}))
    verbs = graph.collapse_relation_suffix(graph.canonicalize_relations(edges, canon).drop("qualifier"))
    there = chunks.select(*page, "chunk_uuid", "filename")
    pairs = extract.extract_acronyms(chunks.select("chunk_uuid", F.col("content").alias("text")))
    each = graph.default_entity_props(nodes).join(graph.with_synonyms(there, pairs), page)
    more = F.coalesce(F.element_at("found", F.lower("id")), F.array().cast("array<string>"))
    each = each.withColumn("synonyms", F.array_union("synonyms", more)).drop("found").withColumn("seen", F.struct(*page, "chunk_uuid", "pos"))
    entities = graph.merge_entities(each)
    extra = F.map_filter(F.create_map(F.lit("evidence"), "evidence", F.lit("object"), "canon_object", F.lit("qualifier"), "qualifier", F.lit("raw_relation"), "raw_relation"), lambda k, v: F.coalesce(v, F.lit("")) != "")
    props = F.map_concat(F.map_filter("props", lambda k, v: ~k.isin("evidence", "object", "qualifier", "raw_relation")), extra)
    counted = verbs.withColumn("props", props).join(there.select(*page, "chunk_uuid"), page).withColumn("seen", F.struct(*page, "chunk_uuid", "pos"))
    merged = graph.merge_edges(counted.select("source", "relation", "target", "props", "seen"), entities)
    structure, links = graph.build_structure(chunks)
    rejected = read.where(~F.col("ok")).select(*page, "raw")
    out = {"entities": entities, "mentions": graph.present_in(each), "edges": merged, "nodes": structure, "links": links, "rejected": rejected}
    return {name: out[name] for name in parts}


def retrieve(queries: DataFrame, corpus: index.TextIndex | DataFrame, vector_hits: DataFrame | None = None, entities: DataFrame | None = None, mentions: DataFrame | None = None, edges: DataFrame | None = None, rerank: DataFrame | None = None, aliases: dict[str, str] | None = None,
             glossary: str = "gloss", text_k: int = 60, phrase_k: int = 40, scope_k: int = 80, entity_k: int = 30, relation_k: int = 40, formula_k: int = 6, digits: int = 9) -> dict[str, DataFrame]:
    """C-3. All channels for all queries in one job.

    queries: query_id, query, optionally active_doc. corpus: the stored index of the newest
    chunks (see operators.index), with the columns chunk_uuid, filename, page_no, chunk_index,
    tier, toon_type, ingestion_ts and texts; or a table of all versions, of which an index is
    made first. vector_hits: query_id, chunk_uuid, score of K-1, as many as the widest limits
    ask for. entities: id, category, description, formula, synonyms; mentions: id, chunk_uuid;
    edges: source, relation, target, optionally props. rerank: query_id, chunk_uuid, rerank_score.

    Questions are understood first (X-18 to X-20, J-12). The channels are vectors, document
    scope (K-6), exact phrases and glossary acronyms, two chunks for each (K-4, K-5), text (K-3),
    and the graph's entities and, for questions about formulas, formulas (J-9, J-10). They are merged (D-1),
    the first ten of a query, by channel and score, are expanded by what shares their entities (J-8), another document
    than the asked one is left out (P-15), and the rest is fused (W-6), boosted and ranked
    (K-8), diversified by each query's own limits (W-5) and joined to texts (J-2). Relations
    (J-11) are looked for four times as widely as they are kept, placed by their first mention,
    narrowed by the question's concepts and tokens (A-8) and to its document.

    Returns sources (the chosen chunks, then one row of the formulas of a query and one of its
    relations), relations (X-23) and tiers (A-6, with the hits of each channel). No text is read
    before J-2, and only the chosen ones then. Questions, hits and choices are written to the
    shared folder, in `folder`, which remove_folder deletes when the rows have been used.
    """
    spark = queries.sparkSession
    folder = new_folder(spark, "retrieve")
    idx = corpus if isinstance(corpus, index.TextIndex) else index.build_index(search.latest_versions(corpus), f"{folder}/index")
    asked = stored(query.understand_queries(queries, aliases), f"{folder}/questions")
    current = index.current_docs(idx)
    terms = asked.select("query_id", F.col("search_terms").alias("terms"), F.col("document").alias("active_doc"))
    attrs = current.select("chunk_uuid", "filename", F.col("page_no").alias("page"), "tier", "toon_type")

    def channel(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", "chunk_uuid", F.lit(name).alias("channel"), F.col("score").cast("double").alias("score"))

    # Channels don't depend on each other, so their jobs are handed to Spark at the same time.
    found = {
        "phrase": lambda: index.phrase_search(asked.select("query_id", F.explode("exact_phrases").alias("phrase")), idx, phrase_k, longest="chunk"),
        "glossary": lambda: index.glossary_search(asked.select("query_id", F.explode("acronyms").alias("alias")), idx, glossary, 2),
        "doc_scope": lambda: search.doc_scope_topk(terms, current, lambda ids: index.chunk_words(idx, ids), scope_k),
        "text": lambda: index.text_search(terms, idx, text_k, digits=digits),
    }
    if vector_hits is not None:
        near = vector_hits.join(asked.select("query_id", "vector_k"), "query_id").withColumn("score", F.round("score", digits))
        found["vector"] = lambda: search.top(near, 140, [F.desc("score"), F.col("chunk_uuid")]).where("rank <= vector_k")
    formulas = wide = None
    if entities is not None:
        tokens = asked.select("query_id", F.explode("graph_tokens").alias("token"))
        named = entities.select(F.col("id").alias("entity_id"), F.col("id").alias("name"), "description", "category", "synonyms")
        held = mentions.select(F.col("id").alias("entity_id"), "chunk_uuid")
        in_heads = lambda: index.head_terms(idx, tokens.select(F.col("token").alias("term")), held).withColumnRenamed("term", "token")
        found["entity"] = lambda: graph.search_entities(named, held, current, tokens, entity_k, in_heads()).withColumn("score", F.col("n_entities"))
        formulas = entities.where("category = 'FORMULA'").select(F.col("id").alias("formula_id"), F.col("id").alias("name"), F.col("formula").alias("latex"), F.lit("").alias("plain"), F.col("description").alias("meaning"))
        wanting = asked.where("is_formula_lookup").select("query_id")
        placed = formulas.join(held.withColumnRenamed("entity_id", "formula_id"), "formula_id").join(current.select("chunk_uuid", F.col("page_no").alias("page"), "chunk_index", "filename"), "chunk_uuid")
        by_chunk = placed.withColumn("formula_id", F.concat_ws("\n", "formula_id", "chunk_uuid"))
        found["formula"] = lambda: graph.search_formulas(by_chunk, held, tokens.join(wanting, "query_id", "left_semi"), formula_k).withColumn("score", F.lit(1.0))
        if edges is not None:
            wide = lambda: stored(graph.search_relations(edges, named, tokens, 4 * relation_k), f"{folder}/relations")
    names = {"glossary": "phrase", "entity": "graph", "formula": "graph"}
    with ThreadPoolExecutor(4) as pool:
        wide = pool.submit(wide) if wide else None
        made = [pool.submit(lambda n=n, f=f: stored(channel(f(), names.get(n, n)), f"{folder}/hits/of={n}")) for n, f in found.items()]
        each, wide = [m.result() for m in made], wide.result() if wide else None
    relations = None
    if wide is not None:
        if "props" in edges.columns:
            wide = wide.join(edges.select("source", "relation", "target", "props"), ["source", "relation", "target"])
        asks = asked.select("query_id", "concepts", F.col("graph_tokens").alias("tokens"), "document")
        relations = graph.narrow_relations(graph.place_relations(wide, held, current), asks, relation_k)
    hits = each[0]
    for more in each[1:]:
        hits = hits.unionByName(more)
    merged = fuse.merge_candidates(hits.join(attrs, "chunk_uuid"))
    if entities is not None:
        scores = [F.col(f"{c}_score") for c in fuse.CHANNELS]
        met = F.coalesce(*[F.when(c.isNotNull(), i) for i, c in enumerate(scores)])
        first = merged.withColumn("_o", met).withColumn("_s", F.coalesce(*scores))
        seeds = fuse.limit_per_group(first, ["query_id"], [F.col("_o"), F.desc("_s"), F.col("chunk_uuid")], 10).select("query_id", "chunk_uuid")
        more = graph.graph_neighbors(mentions.select(F.col("id").alias("entity_id"), "chunk_uuid").join(entities.select(F.col("id").alias("entity_id"), "category"), "entity_id"), seeds, folder=f"{folder}/wanted")
        added = more.join(current.where("not blank").select("chunk_uuid"), "chunk_uuid", "left_semi").join(merged.select("query_id", "chunk_uuid"), ["query_id", "chunk_uuid"], "left_anti")
        new = fuse.merge_candidates(channel(added.withColumn("score", F.lit(1.0)), "expansion").join(attrs, "chunk_uuid"))
        merged = merged.unionByName(new)
    scoped = clean.filter_requested_doc(merged, terms.select("query_id", "active_doc"))
    graph_score = F.greatest("graph_score", "expansion_score")
    fused = fuse.rrf_fuse(scoped.withColumn("graph_score", graph_score).withColumn("text_score", F.greatest("text_score", "phrase_score", "doc_scope_score")))
    facts = asked.select("query_id", "terms", "is_evidence", "is_formula_lookup", "intent", "pages", "rerank_k", "final_k", "max_doc", "max_page")
    kind = fused.join(facts, "query_id").withColumn("toon_type", F.lower(F.coalesce("toon_type", F.lit("text"))))
    boosted = kind.withColumns(
        {
            "name_hits": F.size(F.filter("terms", lambda t: F.contains(F.lower("filename"), t))),
            "evidence": F.col("is_evidence"),
            "in_doc": F.col("doc_scope_score").isNotNull(),
            "on_page": F.array_contains("pages", F.col("page")),
            "intent_type": F.when(F.col("is_formula_lookup") & (F.col("toon_type") == "formula"), "formula").when((F.col("intent") == "chart") & F.col("toon_type").isin("image", "chart"), "chart").when((F.col("intent") == "table") & (F.col("toon_type") == "table"), "table").otherwise("text"),
        }
    )
    ranked = fuse.rank_candidates(boosted, 45, rerank, own_keep="rerank_k").withColumn("score", F.round("score", digits))
    chosen = fuse.diversify(ranked, F.col("max_page"), F.col("max_doc"), F.col("final_k")).select("query_id", "chunk_uuid", "filename", "page", "tier", "toon_type", "provenance", "score")
    texts = attrs.select("chunk_uuid", "filename", F.col("page").alias("page_no"), "toon_type").join(index.current_texts(idx), "chunk_uuid")
    sources = fuse.enrich_candidates(stored(chosen, f"{folder}/chosen"), texts, versions=False).select("query_id", "chunk_uuid", "filename", "page", "tier", "toon_type", "provenance", "score", "content")
    tiers = fuse.tier_distribution(sources.drop("content"), hits)
    if formulas is not None:
        some = graph.attach_formulas(sources.join(wanting, "query_id", "left_semi").select("query_id", "chunk_uuid"), mentions.select(F.col("id").alias("entity_id"), "chunk_uuid"), formulas, formula_k)
        sources = sources.unionByName(some.select("query_id", F.lit("graph").alias("chunk_uuid"), F.lit("KG").alias("filename"), F.lit(0).alias("page"), "tier", F.lit("formula").alias("toon_type"), F.lit("formulas").alias("provenance"), F.lit(0.0).alias("score"), "content"))
    if relations is not None:
        relations = graph.relation_rows(relations, ["query_id"])
        readable = relations
        line = F.concat_ws(" | ", "source", "relation", "target", "filename", F.col("page").cast("string"))
        listed = readable.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))  # at most relation_k lines
        sources = sources.unionByName(listed.select("query_id", F.lit("relations").alias("chunk_uuid"), F.lit("KG").alias("filename"), F.lit(0).alias("page"), F.lit("GRAPH").alias("tier"), F.lit("graph").alias("toon_type"), F.lit("relations").alias("provenance"), F.lit(0.0).alias("score"), "content"))
    return {"sources": sources, "relations": relations, "tiers": tiers, "folder": folder}


def formula_report(queries: DataFrame, sources: DataFrame, chunks: DataFrame | None = None, n: int = 10, extra: int = 18) -> dict[str, DataFrame]:
    """C-4. queries: query_id, query. sources: query_id, pos, id, filename, page, type, content, score, origin, as C-3 finds them. chunks: all versions, for questions that ask for thresholds and whose sources have none: the texts and phrases that are nearest to the question and to the names of thresholds are read too.

    Returns rows (the n best formula, threshold and metric rows of each query), thresholds (its
    threshold rows by criterion) and missing (metrics that it names and no row has).
    """
    q = F.lower(F.coalesce("query", F.lit("")))
    asked = queries.select("query_id", "query", query.metric_aliases(q).alias("aliases"), F.array_contains(query.metric_aliases(q), F.lit("soglia")).alias("wants"))

    def found(some: DataFrame) -> DataFrame:
        once = fuse.dedupe_sources(some)
        return extract.classify_formula_rows(extract.extract_formula_rows(once, ["query_id"]))

    rows = stored(found(sources), new_folder(queries.sparkSession, "formula-rows"))
    if chunks is not None:
        lacking = asked.where("wants").join(rows.where("class = 'threshold'").select("query_id").distinct(), "query_id", "left_anti")
        current = search.latest_versions(chunks)
        terms = lacking.select("query_id", F.array_distinct(F.concat(search.words(F.col("query")), search.words(F.array_join("aliases", " ")))).alias("terms"))
        texts = index.best_texts(terms, current.select("chunk_uuid", search.words(F.col("content")).alias("w")), extra).select("query_id", "chunk_uuid", "score")
        phrases = search.phrase_topk(lacking.select("query_id", F.explode(query.exact_phrases(F.col("query"))).alias("phrase")), current, extra).select("query_id", "chunk_uuid", "score")
        hits = texts.unionByName(phrases).groupBy("query_id", "chunk_uuid").agg(F.max("score").alias("score"))
        some = fuse.limit_per_group(hits, ["query_id"], [F.desc("score"), F.col("chunk_uuid")], extra)
        more = some.join(current.select("chunk_uuid", "filename", F.col("page_no").alias("page"), "content"), "chunk_uuid")
        more = more.select("query_id", F.lit(1000).alias("pos"), F.col("chunk_uuid").alias("id"), "filename", "page", F.lit("text").alias("type"), "content", "score", F.lit("THRESHOLDS").alias("origin"))
        rows = rows.unionByName(found(more))
    best = extract.dedupe_formula_rows(rows, n, ["query_id"])
    rules = rows.where("class = 'threshold'").select("query_id", "filename", "page", F.col("formula").alias("rule"))
    return {"rows": best, "thresholds": extract.aggregate_thresholds(rules, ["query_id"]), "missing": extract.missing_terms(asked, best)}


def relation_report(queries: DataFrame, chunks: DataFrame, edges: DataFrame, n: int = 10, aliases: dict[str, str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """C-5. queries: query_id, query. The n best supported pairs of the concepts that each question names, with a snippet of the strongest evidence; hops: how many concepts it links.

    sources: query_id, chunk_uuid, as C-3 finds them for the same questions; pairs are then
    looked for in a question's own sources, else in all chunks. multi_hop: whether the question
    asks for a chain of relations; unchained: whether it does and fewer than two of its rows
    are edges, so that no chain can be made of them.
    """
    text = F.coalesce("query", F.lit(""))
    named = stored(queries.select("query_id", query.graph_concepts(text, aliases).alias("c"), query.asks_chain(F.lower(text)).alias("multi_hop")), new_folder(queries.sparkSession, "concepts"))
    found = graph.concept_cooccurrence(named.select("query_id", F.explode("c").alias("concept")), chunks, edges, sources=sources)
    strength = F.when(F.col("evidence") == "edge", 0).when(F.col("evidence") == "strong", 1).when(F.col("evidence") == "weak", 2).otherwise(3)
    best = fuse.limit_per_group(found.withColumn("strength", strength), ["query_id"], [F.col("strength"), F.desc("n_chunks"), F.col("x"), F.col("y")], n).drop("strength")
    linked = best.groupBy("query_id").agg(F.count_if(F.col("evidence") == "edge").alias("_edges"))
    flags = named.select("query_id", F.size("c").alias("hops"), "multi_hop").join(linked, "query_id").withColumn("unchained", F.col("multi_hop") & (F.col("_edges") < 2)).drop("_edges")
    return best.join(flags, "query_id")


def quality_report(log: DataFrame, sources: bool = False) -> dict[str, DataFrame]:
    """C-6. log: as read from the evaluation log (S-7). Verdicts and means by model, and where the log holds sources also by their tier and origin."""
    flat = log.select("llm_model", "metrics.faithfulness", "metrics.relevance", F.coalesce("metrics.scope_violation", F.lit(False)).alias("scope_violation"), "metrics.verdict", *(["sources"] if sources else []))
    out = {"model": report.eval_quality(flat.drop("sources"))}
    if sources:
        # An answer counts once for each different tier and origin of its sources.
        for field in ("tier", "db_origin"):
            each = flat.withColumn(field, F.explode(F.array_distinct(F.transform("sources", lambda s: s[field])))).drop("sources")
            out[field] = report.eval_quality(each, field)
    return out
