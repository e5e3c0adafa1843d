"""Tags, facts, acronyms, thresholds and formulas found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import cues as C
from docmill.functions import lexicons as L
from docmill.operators.clean import doc_name, squeeze, strip, whole_words


def dispatch_tiers(files: DataFrame, taxonomy: DataFrame, sidecars: DataFrame | None = None, default: tuple = ("B", "reference", "internal")) -> DataFrame:
    """J-1. files: doc_id, path (folders below the inbox, without the file name), ingest_date. taxonomy: folder, tier, content_type, source_kind; a few dozen rows.

    The deepest folder that the taxonomy knows decides; the first folder overrides the tier;
    sidecars (doc_id with tier, content_type, source_kind, ontology, effective_date, any null)
    come last.
    """
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    rows = files.withColumn("parts", parts)
    known = (
        rows.select("doc_id", F.posexplode("parts").alias("pos", "folder"))
        .join(F.broadcast(taxonomy), "folder")
        .groupBy("doc_id")
        .agg(F.max_by(F.struct("tier", "content_type", "source_kind"), "pos").alias("k"))
    )
    macro = F.upper(F.get("parts", F.lit(0)))
    out = rows.join(known, "doc_id", "left").select(
        "doc_id",
        "parts",
        "ingest_date",
        macro.alias("macro"),
        F.when(macro == "TIER_A_NORMATIVE", "A").when(macro == "TIER_B_GOVERNANCE", "B").when(macro == "TIER_C_EVIDENCES", "C").otherwise(F.coalesce("k.tier", F.lit(default[0]))).alias("tier"),
        F.coalesce("k.content_type", F.lit(default[1])).alias("content_type"),
        F.coalesce("k.source_kind", F.lit(default[2])).alias("source_kind"),
    )
    second = F.lower(F.get("parts", F.lit(1)))
    deep = ((F.col("macro") == "TIER_C_EVIDENCES") & (F.size("parts") >= 2)) | (F.size("parts") >= 3)
    out = out.select("doc_id", "tier", "content_type", "source_kind", F.when(deep, second).otherwise(F.lower("content_type")).alias("ontology"), F.when(F.col("tier") == "C", F.col("ingest_date")).alias("effective_date"))
    if sidecars is None:
        return out
    fields = ["tier", "content_type", "source_kind", "ontology", "effective_date"]
    return out.alias("o").join(sidecars.alias("s"), "doc_id", "left").select("doc_id", *[F.coalesce(f"s.{c}", f"o.{c}").alias(c) for c in fields])


def taxonomy(spark) -> DataFrame:
    return spark.createDataFrame(L.TAXONOMY, "folder string, tier string, content_type string, source_kind string")


def tag_topics(docs: DataFrame, lexicon: list[tuple[str, list[str]]] = L.TOPICS, k: int = 6, col: str = "text") -> DataFrame:
    """A-3. (doc_id, topic, score, rank): matches of each topic's patterns, ignoring case; the k best, ties in the lexicon's order. One row is made for each topic that occurs, within the row's own task."""
    scores = F.array(*[
        F.struct(sum((F.regexp_count(F.col(col), F.lit(f"(?i){p}")) for p in patterns), F.lit(0)).alias("score"), F.lit(-i).alias("ord"), F.lit(topic).alias("topic")) for i, (topic, patterns) in enumerate(lexicon)
    ])
    best = F.slice(F.reverse(F.array_sort(F.filter(scores, lambda s: s["score"] > 0))), 1, k)
    return docs.select("doc_id", F.posexplode(best).alias("rank", "s")).select("doc_id", "s.topic", F.col("s.score").cast("long").alias("score"), (F.col("rank") + 1).cast("int").alias("rank"))


def entity_density(docs: DataFrame, keywords: list[str] = L.KEYWORDS) -> DataFrame:
    """A-4. Title-case words whose lower form is absent from the text, and distinct keywords."""
    text = F.coalesce("text", F.lit(""))
    titles = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-ZÀ-Ú][a-zà-ú]{2,}(?![\p{L}\p{N}_])"), F.lit(0)))
    common = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[a-zà-ú]{3,}(?![\p{L}\p{N}_])"), F.lit(0)))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(keywords) + r")(?![\p{L}\p{N}_])"), F.lit(0)))
    # Title case makes lowering one-to-one, so sets of lower forms can be compared by hash.
    entities = F.size(F.array_except(F.transform(titles, lambda t: F.lower(t)), common))
    return docs.select("doc_id", F.when(F.char_length(text) < 20, 0).otherwise(entities).alias("entities"), F.size(found).alias("keywords"))


def number_value(c: Column) -> Column:
    """X-8: a number as written in Italian or English. Of both marks the last is the decimal one; a comma alone is decimal; dotted groups of three are thousands."""
    dot, comma = F.instr(F.reverse(c), "."), F.instr(F.reverse(c), ",")
    plain = (
        F.when((dot > 0) & (comma > 0) & (comma < dot), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((dot > 0) & (comma > 0), F.replace(c, F.lit(","), F.lit("")))
        .when(comma > 0, F.replace(c, F.lit(","), F.lit(".")))
        .when(c.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(c, F.lit("."), F.lit("")))
        .otherwise(c)
    )
    return plain.try_cast("double")


PERCENT = r"[0-9]+(?:[.,][0-9]+)?[ \t\n]?%"
AMOUNT = r"[€$][ \t\n]?[0-9][0-9.,]*|[0-9][0-9.,]*[ \t\n]?(?:EUR|USD)"


def extract_facts(docs: DataFrame, first: int = 20_000, most: int = 20) -> DataFrame:
    """X-8. (doc_id, kind, fact, value): distinct percentages and amounts among the first of each kind."""
    text = F.substring(F.coalesce("text", F.lit("")), 1, first)
    take = lambda p: F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, most))
    both = docs.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("percent"), F.lit("amount")), F.array(take(PERCENT), take(AMOUNT)))).alias("kind", "facts"))
    return both.select("doc_id", "kind", F.explode("facts").alias("fact")).withColumn("value", number_value(F.regexp_replace(F.regexp_extract("fact", "[0-9][0-9.,]*", 0), "[.,]$", "")))


LETTERS = "A-ZÀ-Úa-zà-ú"
FULL_ACRONYM = rf"([{LETTERS}][{LETTERS}0-9 \-/]{{4,90}}) ?\(([A-Z][A-Z0-9]{{1,15}})\)"
ACRONYM_FULL = rf"\b([A-Z][A-Z0-9]{{1,15}}) ?\(([{LETTERS}][{LETTERS}0-9 \-/]{{4,90}})\)"


def extract_acronyms(chunks: DataFrame, key: str = "chunk_uuid") -> DataFrame:
    """X-9. (key, canonical, acronym): distinct pairs written `Full Name (ABC)` or `ABC (Full Name)`; exactly one side is an acronym."""
    text = squeeze(F.coalesce("text", F.lit("")))
    pairs = F.concat(*[F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("b")) for p in (FULL_ACRONYM, ACRONYM_FULL)])
    tidy = lambda c: F.btrim(c, F.lit(" .,:;"))
    rows = chunks.select(key, F.explode(pairs).alias("p")).select(key, tidy(F.col("p.a")).alias("a"), tidy(F.col("p.b")).alias("b"))
    a, b = F.col("a").rlike("^[A-Z][A-Z0-9]{1,15}$"), F.col("b").rlike("^[A-Z][A-Z0-9]{1,15}$")
    named = rows.where(a != b).select(key, F.when(a, F.col("b")).otherwise(F.col("a")).alias("canonical"), F.when(a, F.col("a")).otherwise(F.col("b")).alias("acronym"))
    return named.where((F.char_length("canonical") >= 4) & (F.char_length("acronym") >= 2)).distinct()


def display(c: Column, most: int = 600) -> Column:
    """A formula or rule as readable text: one line without math marks, text macros and braces, of at most `most` characters and three dots."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\[tnr]", " "), "[\t\n\r]", " ")
    t = F.trim(F.regexp_replace(F.replace(t, F.lit("$$$"), F.lit("$$")), "^`+|`+$", ""))
    t = F.trim(F.regexp_replace(t, r"^\$+|\$+$", ""))
    t = F.regexp_replace(t, r"(^|[^A-Za-z\\])ext\{([^}]*)\}", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"\\text\{([^}]*)\}", "$1"), r"(^|[^\p{L}\p{N}_])text\{([^}]*)\}", "$1$2")
    t = squeeze(F.regexp_replace(F.replace(t, F.lit("\\%"), F.lit("%")), "[{}]", ""))
    t = F.replace(t, F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(t, f"(?s)^(.{{{most}}}).+$", "$1...")


def looks_threshold(c: Column, words: list[str] = L.THRESHOLD_WORDS, units: str = L.THRESHOLD_UNITS) -> Column:
    """Whether a displayed text has a word of thresholds and a number with a unit."""
    t = F.lower(c)
    return t.rlike("|".join(words)) & t.rlike(rf"[0-9]+([.,][0-9]+)?[ \t\n\r\f]*({units})")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that is worked out once for each row, whatever is done with it later."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_threshold_rules(rows: DataFrame, text: Column, words: list[str] = L.THRESHOLD_WORDS, units: str = L.THRESHOLD_UNITS, n: int = 8) -> DataFrame:
    """X-10 within a row: adds _rules, up to n distinct sentences with a threshold word, a number with a unit and five words. Where splitting misses all of them, a window from a word to a number, with some text after it."""
    raw = F.coalesce(text, F.lit(""))
    sentences = F.split(F.regexp_replace(raw, r"([.;!?])[ \t\n\r\f]+", "$1\n"), "[\n\r]+")
    good = F.filter(F.transform(sentences, lambda s: display(s, 900)), lambda s: looks_threshold(s, words, units) & (F.regexp_count(s, F.lit("[A-Za-zÀ-ÿ]+")) >= 5))
    key = lambda s: F.substring(F.lower(s), 1, 260)
    out = once(once(rows, "_good", good), "_keys", F.transform("_good", key))
    first = F.filter("_good", lambda s, i: F.array_position(F.col("_keys"), key(s)) == i + 1)
    window = F.regexp_extract(display(raw, 3000), f"(?i)(?:{'|'.join(words)}).{{0,420}}?(?:[0-9]+(?:[.,][0-9]+)?[ \t]*(?:{units})).{{0,420}}", 0)
    rest = F.when(looks_threshold(display(raw, 1000), words, units), F.filter(F.array(display(window, 900)), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("_rules", F.when(F.size("_good") > 0, F.slice(first, 1, n)).otherwise(rest)).drop("_good", "_keys")


def extract_threshold_rules(chunks: DataFrame, key: str = "chunk_uuid", words: list[str] = L.THRESHOLD_WORDS, units: str = L.THRESHOLD_UNITS, n: int = 8) -> DataFrame:
    """X-10. (key, rank, rule): see with_threshold_rules."""
    return with_threshold_rules(chunks.select(key, "text"), F.col("text"), words, units, n).select(key, F.posexplode("_rules").alias("rank", "rule"))


def definition_snippets(hits: DataFrame) -> DataFrame:
    """X-21. hits: text, alias. The first line with the alias and the next four, up to 900 characters; else a window around it; else the head."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    has = F.transform(lines, lambda ln: F.contains(F.lower(ln), F.lower("alias")))
    at = F.array_position(has, F.lit(True)).cast("int")
    where = F.instr(F.lower(F.coalesce("text", F.lit(""))), F.lower("alias"))
    return hits.withColumn(
        "snippet",
        F.when(at > 0, F.substring(F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), 5), "\n"), 1, 900))
        .when(where > 0, F.substring("text", F.greatest(where - 160, F.lit(1)), F.lit(1060)))
        .otherwise(F.substring("text", 1, 900)),
    )


def best_definitions(terms: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """X-21 by term. terms: query_id, term, and optionally alias (several rows a term; else the term itself). hits: query_id, alias, chunk_uuid, rank of K-5. texts: chunk_uuid, content, filename, page_no, one version of each.

    One row for each term of a query: the best hit of its aliases, by rank, then alias, with the
    definition found there; terms without a hit stay, with found false and no definition. Texts
    are joined to the best hits only.
    """
    named = terms if "alias" in terms.columns else terms.withColumn("alias", F.col("term"))
    best = Window.partitionBy("query_id", "term").orderBy(F.col("rank").asc_nulls_last(), "alias", "chunk_uuid")
    one = named.select("query_id", "term", "alias").distinct().join(hits.select("query_id", "alias", "chunk_uuid", "rank"), ["query_id", "alias"], "left")
    first = one.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "rank")
    told = first.join(texts.select("chunk_uuid", F.col("content").alias("text"), "filename", F.col("page_no").alias("page")), "chunk_uuid", "left")
    found = definition_snippets(told)
    return found.select("query_id", "term", "chunk_uuid", "filename", "page", F.when(F.col("chunk_uuid").isNotNull(), F.col("snippet")).alias("definition"), F.col("chunk_uuid").isNotNull().alias("found"))


LATEX = r"(?s)(?<!\\)(\$\$.*?\$\$|\$[^$\n]{2,300}\$)"
EQUATION = r"(?i)\b([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9_\-/ ]{1,80})\s*=\s*([^;\n]{2,260})"
#: Parts of a key whose first rows are found apart.
PARTS = 64
METRIC_NAME = "^[-*• ]*([A-Za-zÀ-ÿ0-9_/ -]{2,80}) *[:=–-]"


def extract_formula_rows(sources: DataFrame, by: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """X-11. sources: id, filename, page, content, optionally type. Rows (id, filename, page, kind, name, formula, meaning), each once for a file and page, and for each value of the columns `by`. kinds: only these of latex, block, equation, metric and threshold are looked for.

    LaTeX spans; the LaTeX, Plain and Meaning lines of formula sources; equations; lines that
    name a metric; and the threshold rules of X-10. Generic names stand where a source gives none.

    The first row of each key, by id, file, name, formula and meaning, is picked by an aggregate in two
    rounds, of parts by a hash of the id and then of the key: a name that stands in every source
    of a page is in no window or task as a whole.
    """
    text = F.col("_text")
    row = lambda kind, name, formula, meaning: F.struct(F.lit(kind).alias("kind"), name.alias("name"), formula.alias("formula"), meaning.alias("meaning"))
    none = F.lit(None).cast("string")
    latex = F.transform(F.regexp_extract_all(text, F.lit(LATEX), F.lit(1)), lambda f: row("latex", F.lit("formula recuperata"), strip(f), F.lit("")))
    lines = F.col("_lines")
    last = lambda mark: strip(F.regexp_replace(F.coalesce(F.element_at(F.filter(lines, lambda ln: F.lower(ln).startswith(mark)), -1), F.lit("")), "^[^:]*:?", ""))
    is_formula = text.contains("Formula from Knowledge Graph")
    if "type" in sources.columns:
        is_formula = is_formula | F.coalesce(F.lower(F.trim("type")).isin("formula", "math", "equation"), F.lit(False))
    name = F.coalesce(F.nullif(last("plain:"), F.lit("")), F.nullif(last("meaning:"), F.lit("")), F.lit("formula/metric"))
    block = F.when(is_formula, F.array(row("block", name, F.nullif(last("latex:"), F.lit("")), last("meaning:")))).otherwise(F.array().cast("array<struct<kind:string,name:string,formula:string,meaning:string>>"))
    sides = F.arrays_zip(F.regexp_extract_all(text, F.lit(EQUATION), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(EQUATION), F.lit(2)).alias("b"))
    pairs = F.filter(F.transform(sides, lambda s: F.struct(squeeze(s["a"]).alias("a"), squeeze(s["b"]).alias("b"))), lambda s: (F.char_length(s["a"]) >= 2) & (F.char_length(s["b"]) >= 2))
    equations = F.transform(pairs, lambda s: row("equation", s["a"], F.concat(s["a"], F.lit(" = "), s["b"]), F.lit("")))
    told = F.filter(F.transform(lines, squeeze), lambda ln: ln.rlike(whole_words("|".join(L.METRIC_WORDS))))
    named = lambda ln: F.coalesce(F.nullif(strip(F.regexp_extract(ln, METRIC_NAME, 1)), F.lit("")), F.lit("metrica/indicatore citato"))
    metrics = F.transform(told, lambda ln: row("metric", named(ln), none, F.lit("metrica/indicatore")))
    rules = F.transform("_rules", lambda r: row("threshold", F.lit("regola soglia"), r, F.lit("")))
    by = by or []
    read = once(sources.withColumn("_text", F.coalesce("content", F.lit(""))), "_lines", F.transform(F.split("_text", r"\r\n|\n|\r"), strip))
    found = {"latex": latex, "block": block, "equation": equations, "metric": metrics, "threshold": rules}
    some = [v for k, v in found.items() if kinds is None or k in kinds]
    ruled = with_threshold_rules(read, text) if kinds is None or "threshold" in kinds else read
    out = ruled.select(*by, "id", F.coalesce("filename", F.lit("N/D")).alias("filename"), F.coalesce("page", F.lit(0)).alias("page"), F.explode(F.concat(*some)).alias("r"))
    keys = {"_file": F.lower("filename"), "_name": F.lower("name"), "_formula": F.coalesce(F.lower("formula"), F.lit(""))}
    flat = out.select(*by, "id", "filename", "page", "r.kind", "r.name", "r.formula", "r.meaning").withColumns(keys)
    key = [*by, "_file", "page", "kind", "_name", "_formula"]
    told = ["id", "filename", "name", "formula", "meaning"]
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("_part")
    first = flat.groupBy(*key, part).agg(F.min(F.struct(*told)).alias("r")).groupBy(*key).agg(F.min("r").alias("r"))
    return first.select(*by, "r.id", "r.filename", "page", "kind", "r.name", "r.formula", "r.meaning")


def is_computational(formula: Column) -> Column:
    """Whether a formula computes something: an operator of fractions, sums or powers, or an equation whose right side is neither prose nor a bare number but has an operator or a function."""
    prose = whole_words("tempo medio|mean time|necessario per|impiegato per|rilevare|risolvere|incident[ei]?|definizione|definition")
    right = F.trim(F.regexp_replace(F.regexp_replace(formula, "^[^=]*=", ""), r"[\$`]+$", ""))
    equation = formula.rlike(r"^[\s$`]*[^=\s$`][^=]*=") & right.rlike(r"(?i)[+\-*/×÷^]|\\frac|\\sum|\\prod|sqrt|log|exp|min|max|avg|mean") & ~right.rlike(r"^\\?text\{[^}]+\}$") & ~F.lower(right).rlike(prose)
    return ~has_graph_marks(formula) & (formula.rlike(r"\\frac|\\sum|\\prod|[√^×*/÷]") | equation)


def has_graph_marks(c: Column) -> Column:
    """Whether a text is put together from graph nodes."""
    return F.lower(c).rlike("plain:|meaning:|formula::|formule collegate|formula from knowledge graph")


def is_graph_row(filename: Column, page: Column, name: Column, formula: Column, meaning: Column) -> Column:
    low = F.lower(F.trim(filename))
    return low.isin("kg", "neo4j", "neo4j knowledge graph") | ((page == 0) & F.lower(F.trim(name)).isin("formule collegate", "latex")) | has_graph_marks(F.coalesce(formula, F.lit(""))) | has_graph_marks(F.coalesce(meaning, F.lit("")))


def classify_formula_rows(rows: DataFrame) -> DataFrame:
    """X-12. rows: filename, page, name, formula, meaning. Adds class (threshold before computational before definitional before cited) and gives each class its name, formula and meaning; rows that are noise go.

    A threshold's name is its numbered condition, if it has one; a definition's is its left
    side, its meaning the right one, and it has no formula. Noise are rows with a generic name,
    bare numbers, and rows that stand for a whole graph.
    """
    c = F.col
    shown = F.struct(F.coalesce(F.nullif(display(c("name"), 120), F.lit("")), F.lit("elemento recuperato")).alias("n"), F.coalesce("formula", F.lit("")).alias("f"), display(c("meaning"), 700).alias("s"))
    own = once(rows, "_a", shown)
    n, f, s = c("_a.n"), c("_a.f"), c("_a.s")
    right = F.regexp_replace(f, "^[^=]*=", "")
    own = once(own, "_b", F.struct(display(F.concat_ws(" ", n, f, s), 1000).alias("w"), is_computational(f).alias("computes"), is_graph_row(c("filename"), c("page"), c("name"), c("formula"), c("meaning")).alias("graph"), right.alias("right")))
    stated = f.contains("=") & c("_b.right").rlike(r"\\?text\{[^}]+\}")
    definitional = stated | F.lower(s).rlike("tempo medio|mean time|metrica|metric|indicatore|indicator")
    kind = F.when(looks_threshold(c("_b.w")), "threshold").when(c("_b.computes") & ~c("_b.graph"), "computational").when(definitional | c("_b.computes"), "definitional").otherwise("cited")
    own = once(own, "class", kind)
    own = once(own, "_rule", F.when(c("class") == "threshold", display(F.when(f != "", f).otherwise(F.concat_ws(" ", n, f, s)), 700)))
    condition = F.regexp_extract("_rule", r"(?i)\b(condizione\s*[0-9]+)\b", 1)
    rule_name = F.when(condition != "", F.initcap(condition)).when(~F.lower(n).isin([*C.GENERIC_FORMULA_NAMES, "regola soglia"]), n).otherwise("Regola soglia")
    left = F.substring(F.trim(F.regexp_replace(display(F.substring_index(F.regexp_replace(f, r"^\$+|\$+$", ""), "=", 1), 120), "[^A-Za-zÀ-ÿ0-9_/ -]+", "")), 1, 80)
    defined = (c("class") == "definitional") & f.contains("=")
    told = F.struct(
        F.when(c("class") == "threshold", rule_name).when(defined, F.coalesce(F.nullif(left, F.lit("")), n)).otherwise(n).alias("name"),
        F.when(c("class") == "threshold", c("_rule")).when(c("class") == "computational", display(f, 700)).alias("formula"),
        F.when(defined, display(c("_b.right"), 500)).otherwise(s).alias("meaning"),
    )
    own = once(own, "_c", told).withColumns({"name": c("_c.name"), "formula": c("_c.formula"), "meaning": c("_c.meaning"), "from_graph": c("_b.graph")}).drop("_a", "_b", "_c", "_rule")
    some = own.where(~F.lower("name").isin("formule collegate", "latex", "formula from knowledge graph"))
    bare = F.lower(F.coalesce("formula", F.lit(""))).rlike(rf"^[0-9]+([.,][0-9]+)? *({L.THRESHOLD_UNITS})?$")
    return some.where((c("class") == "threshold") | (~F.lower("name").isin(C.GENERIC_FORMULA_NAMES) & ~bare))


CLASSES = ["computational", "threshold", "definitional", "cited"]


def dedupe_formula_rows(rows: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """D-8. rows: name, class, filename, page, formula, meaning, from_graph; by: columns such as query_id, each value of which has rows of its own.

    The best row of each key: a threshold's first 260 characters, else name, with class, file
    and page; best is a row of a real document, then one without marks of the graph, then the
    longest meaning. Graph rows that a document states too go; the first n by class, file, page
    and name stay.
    """
    by, low = by or [], lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    rule = F.substring(F.trim(F.lower(display(F.col("formula"), 1000))), 1, 260)
    own = F.when(F.col("class") == "threshold", F.concat(F.lit("threshold:"), rule)).otherwise(low("name"))
    file = doc_name(F.col("filename"))
    real = ~F.col("from_graph") & ~file.isin("", "kg", "neo4j", "neo4jknowledgegraph", "nd") & (F.col("page") > 0)
    marks = has_graph_marks(F.concat_ws(" ", "name", "formula", "meaning"))
    best = Window.partitionBy(*by, "_key", "class", "_file", "page").orderBy(F.desc(F.when(F.col("_real"), 2).when(F.col("from_graph"), 0).otherwise(1)), "_marks", F.desc("_told"), "formula", "name", "filename", "meaning")
    keyed = once(rows, "_k", F.struct(own.alias("key"), file.alias("file"), marks.alias("marks"), F.least(F.char_length(display(F.col("meaning"), 1000)), F.lit(500)).alias("told"), real.alias("real")))
    picked = keyed.withColumns({"_key": F.col("_k.key"), "_file": F.col("_k.file"), "_real": F.col("_k.real"), "_marks": F.col("_k.marks"), "_told": F.col("_k.told")}).drop("_k").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_key", "_file", "_n", "_marks", "_told")
    named = [*by, "_name", "class"]
    stated = picked.where("_real").select(*by, low("name").alias("_name"), "class").distinct()
    kept = picked.where("not from_graph").unionByName(picked.where("from_graph").withColumn("_name", low("name")).join(stated, named, "left_anti").drop("_name"))
    order = [F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")), F.col("filename"), F.col("page"), F.col("name"), F.col("formula")]
    if by:
        return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n", "_real")
    return kept.orderBy(*order).limit(n).drop("_real")


def threshold_criterion(rule: Column) -> Column:
    """What a rule asks for: its percentage and its absolute number, each with users and the Union where the rule names them; else the rule itself."""
    plain = display(rule, 900)
    users, union = F.lower(plain).rlike(whole_words("utenti")), plain.rlike(r"(?i)nell['’]Unione|Unione\s+europea|\b(UE|EU)\b")
    percent = F.replace(F.regexp_extract(plain, r"(?i)\b(?:oltre|superiore\s+a|maggiore\s+di|almeno|more\s+than|over|above)?\s*(?:il\s*)?([0-9]+(?:[.,][0-9]+)?)\s*%", 1), F.lit(","), F.lit("."))
    count = F.replace(F.regexp_extract(plain, r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:milione|milioni|million|millions)\b", 1), F.lit(","), F.lit("."))
    count = F.regexp_replace(count, r"\.0+$", "")
    tail = F.when(union, " nell'Unione").otherwise("")
    first = F.when(percent != "", F.concat(F.lit("oltre il "), percent, F.lit("%"), F.when(users, " degli utenti").otherwise(""), tail))
    second = F.when(count != "", F.concat(F.lit("oltre "), count, F.when(count == "1", " milione").otherwise(" milioni"), F.when(users, " di utenti").otherwise(""), tail))
    return F.coalesce(F.nullif(F.concat_ws(" oppure ", first, second), F.lit("")), plain)


def threshold_scope(rule: Column) -> Column:
    """The first ten words of a rule without its heading."""
    plain = F.regexp_replace(display(rule, 160), r"(?i)^(condizione|regola|soglia|threshold)\s*[0-9]*\s*:\s*", "")
    parts = F.split(F.trim(plain), " +")
    return F.concat(F.array_join(F.slice(parts, 1, 10), " "), F.when(F.size(parts) > 10, "...").otherwise(""))


def aggregate_thresholds(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A-9. rows: filename, page, rule. Rules of one criterion on a page, its case aside: how many, and up to eight different scopes; for each value of the columns `by`."""
    keys = [*(by or []), "filename", "page"]
    criterion = threshold_criterion(F.col("rule"))
    grouped = rows.select(*keys, criterion.alias("criterion"), F.lower(squeeze(criterion)).alias("_key"), threshold_scope(F.col("rule")).alias("scope")).groupBy(*keys, "_key")
    return grouped.agg(F.min("criterion").alias("criterion"), F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("scope")), 1, 8), "; ").alias("scope")).drop("_key")


def missing_terms(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """C-4: (query_id, term) of the metrics that a question names, or means by their time, and no row of it holds. queries: query_id, query, aliases (see query.metric_aliases). rows: query_id, name, formula, meaning."""
    q = F.lower(F.coalesce("query", F.lit("")))
    asked = F.concat(F.filter(F.array(*map(F.lit, L.REQUESTED_METRICS)), lambda t: F.contains(q, t)), F.filter(F.array(F.lit("MTTD"), F.lit("MTTR")), lambda t: F.array_contains("aliases", t)))
    terms = queries.select("query_id", F.explode(F.array_distinct(asked)).alias("term"))
    found = rows.select("query_id", F.lower(F.concat_ws(" ", "name", "formula", "meaning")).alias("_text"))
    held = terms.join(found, "query_id").where(F.contains("_text", F.lower("term"))).select("query_id", "term").distinct()
    return terms.join(held, ["query_id", "term"], "left_anti")
