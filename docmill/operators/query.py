"""Understanding of questions: routes, limits, facets, concepts and expansions, as columns of a table of queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import cues as C
from docmill.functions import lexicons as L
from docmill.operators.clean import let, squeeze, whole_words
from docmill.operators.search import search_tokens

SIGNS = r"(<=|>=|≤|≥|=|>|<|%|×|\*|/|\\frac|\\times)"


def either(terms: list[str]) -> str:
    """An alternation of terms as they are."""
    return "|".join(map(re.escape, terms))


def has(q: Column, terms: list[str]) -> Column:
    """Whether a lower-case text holds a term, inside a word too."""
    return q.rlike(either(terms))


def has_word(q: Column, terms: list[str]) -> Column:
    return q.rlike(whole_words(either(terms)))


def count_of(q: Column, terms: list[str], test=has) -> Column:
    """How many of the terms a text holds."""
    return sum((test(q, [t]).cast("int") for t in terms), F.lit(0))


def is_calculation(q: Column) -> Column:
    return (has(q, C.CALCULATION_VERBS) & q.rlike(f"[0-9]|{SIGNS}")) | has(q, C.ALGEBRA_TERMS)


def is_regulatory(q: Column) -> Column:
    return (has(q, C.CLASSIFYING_STARTERS) & has(q, C.REGULATORY_WORDS)) | (count_of(q, C.REGULATORY_WORDS) >= 2)


def is_formula_strict(q: Column) -> Column:
    return has(q, C.EXPLICIT_FORMULA) | (~is_regulatory(q) & (has(q, C.STRICT_CALCULATION) | (q.rlike(SIGNS) & has(q, C.OPERATIONAL_VERBS))))


def is_pasted_data(q: Column) -> Column:
    """Whether the question brings data with it: a list, a table, JSON, three lines of separated values or six numbers; and asks for some analysis."""
    shape = (
        q.rlike(r"[\[(][ \t\n\r\f]*[0-9,. \t\n\r\f-]{3,}[ \t\n\r\f]*[\])]")
        | q.rlike(r"\|[\p{L}\p{N}_ \t\n\r\f.-]+\|[\p{L}\p{N}_ \t\n\r\f.-]+\|")
        | q.rlike(r'"[\p{L}\p{N}_]+"[ \t\n\r\f]*:[ \t\n\r\f]*[0-9.]+')
        | (F.regexp_count(q, F.lit(r"(?:^|\n)[\p{L}\p{N}_ \t\n\r\f.-]+[,\t;][\p{L}\p{N}_ \t\n\r\f.,-]+")) >= 3)
    )
    numbers = F.regexp_count(q, F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"))
    return (shape | (numbers >= 6)) & has(q, [*C.DATA_ACTIONS, *C.DATA_MEASURES, *C.DATA_DOMAIN])


def route_queries(queries: DataFrame) -> DataFrame:
    """X-20 with its default rules. queries: query. Adds intent, answer_mode, one flag for each route, and the limits of the retrieval: wide ones for long, many-sided, graph and glossary questions."""
    c, q = F.col, F.col("_q")
    # In steps, so that each test is made once however many routes ask for it.
    rows = queries.withColumn("_q", F.lower(F.coalesce("query", F.lit(""))))
    rows = rows.withColumns({"is_calculation": is_calculation(q), "_norms": is_regulatory(q), "_many": count_of(q, C.MANY_DOCUMENTS, has_word), "_number": q.rlike("[0-9]"), "_sign": q.rlike(SIGNS), "_explicit": has(q, C.EXPLICIT_GRAPH)})
    maths = q.rlike(C.MATH_PATTERN) | (c("_number") & (has_word(q, C.MATH_TERMS) | has(q, C.MATH_SIGNS))) | c("is_calculation")
    rows = rows.withColumns({"_maths": maths, "is_formula_lookup": ~c("is_calculation") & has(q, C.FORMULA_LOOKUP)})
    rows = rows.withColumn("is_glossary", ~c("_maths") & ~has(q, C.REASONING_TERMS) & has(q, C.DEFINITION_TERMS))
    wide = (F.char_length(q) > 300) | (c("_many") >= 2) | has_word(q, C.GRAPH_TERMS) | c("is_glossary")
    weak = has(q, C.WEAK_MATH) & (c("_number") | c("_sign") | has(q, C.AMOUNT_CUES))
    rows = rows.withColumns(
        {
            "intent": F.when(c("_norms"), "audit")
            .when(c("is_calculation") | c("is_formula_lookup") | has(q, C.STRONG_MATH) | weak, "formula")
            .when(has(q, C.TABLE_CUES), "table")
            .when(has(q, C.COMPARISON_CUES), "audit")
            .when(has(q, C.CHART_CUES), "chart")
            .when(has(q, C.AUDIT_CUES), "audit")
            .otherwise("text"),
            "answer_mode": F.when(has_word(q, C.AUDIT_MODE), "audit").otherwise("knowledge"),
            "is_formula_strict": has(q, C.EXPLICIT_FORMULA) | (~c("_norms") & (has(q, C.STRICT_CALCULATION) | (c("_sign") & has(q, C.OPERATIONAL_VERBS)))),
            "is_mixed_glossary": has(q, C.GLOSSARY_NAMES) & has(q, C.MIXED_GLOSSARY),
            "is_graph": ~has(q, C.ABSENCE_CHECKS) & (c("_explicit") | (~has_word(q, C.ANALYSIS_TERMS) & has_word(q, C.RELATION_TERMS))),
            "is_graph_strict": c("_explicit") | (~has(q, C.EXPLANATORY_TERMS) & has(q, C.STRONG_GRAPH)),
            "is_evidence": has(q, C.EVIDENCE_TERMS),
            "is_follow_up": (F.char_length(F.trim(q)) < 140) & has_word(q, C.FOLLOW_UP),
            "is_checklist": has_word(q, C.CHECKLIST_STRONG) | (count_of(q, C.CHECKLIST_WEAK, has_word) >= 2),
            "is_crosswalk": has(q, C.MAPPING_TERMS) & (count_of(q, C.FRAMEWORK_TERMS) >= 2),
            "is_pasted_data": is_pasted_data(q),
            "is_tier_a": ~c("is_glossary") & ~c("_maths") & has_word(q, C.NORM_TERMS),
            "_wide": wide,
        }
    )
    pick = lambda a, b: F.when(c("_wide"), a).otherwise(b)
    limits = {"vector_k": pick(140, 100), "rerank_k": pick(45, 35), "final_k": pick(15, 8), "max_doc": pick(8, 5), "max_page": pick(4, 2)}
    return rows.withColumns(limits).drop("_q", "_norms", "_many", "_number", "_sign", "_explicit", "_maths", "_wide")


def metric_aliases(q: Column) -> Column:
    """J-12: names of time metrics and of notification thresholds that a formula question means without naming them. q: the lower-case question."""
    none = F.array().cast("array<string>")
    lits = lambda terms: F.array(*map(F.lit, terms))
    both = q.rlike(C.DETECTION_RESOLUTION)
    found = F.concat(
        F.when(has(q, C.DETECTION_CUES) | both, lits(C.DETECTION_ALIASES)).otherwise(none),
        F.when(has(q, C.RESOLUTION_CUES) | both, lits(C.RESOLUTION_ALIASES)).otherwise(none),
        F.when(has(q, C.THRESHOLD_CUES), lits(C.THRESHOLD_ALIASES)).otherwise(none),
    )
    return F.when(is_formula_strict(q), found).otherwise(none)


def role_tokens(q: Column) -> Column:
    """J-12: what a role in the question adds to the tokens of a search for relations."""
    return F.filter(F.array(*[F.when(has_word(q, terms), token) for terms, token in C.ROLE_TOKENS]), lambda t: t.isNotNull())


def concept_variants(c: Column) -> Column:
    """J-12: a lower-case concept and its fixed variants in both languages."""
    lits = lambda terms: F.array(*map(F.lit, terms))
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.array(c),
            F.when(c.isin(C.ACCESS_CONTROL), lits(C.ACCESS_CONTROL)).otherwise(none),
            F.when(c.isin(C.PRIVILEGED_ASKED), lits(C.PRIVILEGED)).otherwise(none),
            F.when(has(c, C.UNAUTHORIZED_ASKED), lits(C.UNAUTHORIZED)).otherwise(none),
        )
    )


QUOTED = "[\"“']([^\"”']+)[\"”']"
DOCUMENT = r"(?i)\b(?:documento|file|pdf)\s+"
ENDS = " \t\n\r.,;:!?()[]{}\"'“”‘’`"


def asked_document(query: Column) -> Column:
    """The document that a question names: in quotes, with an extension, or as a technical name; empty without one."""
    found = [F.regexp_extract(query, DOCUMENT + p, 1) for p in ("[\"']([^\"']+)[\"']", r"([A-Za-z0-9_.-]+\.(?:pdf|md|txt|docx|csv|html))\b", r"([A-Za-z0-9]+[_-][A-Za-z0-9_.-]+)\b")]
    return F.btrim(F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit("")), F.lit(" .,:;!?\"'"))


def asked_terms(query: Column) -> Column:
    """Terms to look up: phrases in quotes that are no file names, then compounds like NX-12, and acronyms where there is no compound."""
    quoted = F.filter(F.transform(F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1)), F.trim), lambda t: (F.char_length(t) > 2) & ~F.lower(t).rlike(r"\.(pdf|md|txt|docx|html|csv|xlsx)$"))
    compounds = F.regexp_extract_all(query, F.lit(r"\b[A-Z][A-Z0-9]+(?:[-_/][A-Z0-9]+)+\b"), F.lit(0))
    acronyms = F.regexp_extract_all(query, F.lit(r"\b[A-Z]{2,10}[0-9]{0,3}\b"), F.lit(0))
    return F.array_distinct(F.concat(quoted, F.when(F.size(compounds) > 0, compounds).otherwise(acronyms)))


def exact_phrases(query: Column) -> Column:
    """Phrases to be found as they are, in lower case: quoted ones, acronyms, and the names of metrics that are meant."""
    quoted = F.filter(F.transform(F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1)), lambda t: F.lower(F.trim(t))), lambda t: F.char_length(t) > 2)
    acronyms = F.transform(F.regexp_extract_all(query, F.lit(r"\b[A-Z]{2,8}\b"), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(quoted, acronyms, F.transform(metric_aliases(F.lower(query)), F.lower)))


def graph_tokens(query: Column) -> Column:
    """X-18 for the graph: tokens without stop words, words of instruction, and words of under three letters."""
    return F.filter(search_tokens(query), lambda t: ~t.isin([*L.STOP_WORDS, *C.GRAPH_NOISE]) & (F.char_length(t) >= 3))


def clean_concept(c: Column) -> Column:
    """A concept without marks around it, a leading kind or article, and a trailing conjunction."""
    c = F.btrim(squeeze(c), F.lit(ENDS))
    c = F.regexp_replace(c, "(?i)^(?:funzione|function|concetto|concept|termine|term|voce|entity|entità) +", "")
    c = F.regexp_replace(c, "(?i)^(?:(?:e|ed|and|or|oppure|o|il|lo|la|i|gli|le|un|una|uno|the|a|an) +|(?:l|un)['’])+", "")
    return F.btrim(F.regexp_replace(c, "(?i) +(?:e|ed|and|or|oppure|o)$", ""), F.lit(ENDS))


def split_concepts(segment: Column) -> Column:
    """The concepts of a listing, which ends where the means of the answer begin."""
    kept = F.regexp_replace(F.regexp_replace(segment, "[\n\r]+", " "), r"(?i)\b(?:usando|using|tramite|through|rispetto a|against|return|do not|non usare|non rispondere)\b.*$", "")
    parts = F.split(kept, r"(?i)\s*(?:,|;|\be\b|\bed\b|\band\b|\bo\b|\bor\b|\boppure\b|\bwith\b|\bcon\b|\bversus\b|\bvs\b\.?)\s*")
    return F.filter(F.transform(parts, clean_concept), lambda c: c != "")


def asks_chain(q: Column) -> Column:
    """X-19: whether a lower-case question asks for a chain of relations."""
    return has(q, C.MULTI_HOP)


def graph_concepts(query: Column, aliases: dict[str, str] | None = None, most: int = 8) -> Column:
    """X-19: the concepts of a question about relations, each once under its canonical name (aliases: lower-case name to canonical one), the first `most`.

    Quoted terms, what stands between `between`, `among`, `from ... to`, `through` and the end,
    acronyms and exact phrases; only without any of these the longer tokens.
    """
    every = lambda pattern, group=1: F.regexp_extract_all(query, F.lit(pattern), F.lit(group))
    first = lambda pattern, group=1: F.regexp_extract(query, pattern, group)
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    cleaned = lambda a: F.filter(F.transform(a, clean_concept), lambda c: c != "")
    segments = F.concat(*[every(p) for p in (r"(?i)\b(?:tra|fra)\s+(.+?)(?:[.?]|$)", r"(?i)\bbetween\s+(.+?)(?:[.?]|$)", r"(?i)\bamong\s+(.+?)(?:[.?]|$)")])
    way = r"(?i)\b(?:da|from)\s+(.+?)\s+(?:a|to)\s+(.+?)(?:,|\s+passando\s+per|\s+through|\s+via|[.]|[?]|$)"
    found = F.concat(
        F.filter(cleaned(every("[\"“”'‘’]([^\"“”'‘’]+)[\"“”'‘’]")), lambda c: F.char_length(c) >= 2),
        F.flatten(F.transform(segments, split_concepts)),
        cleaned(F.concat(one(first(way)), one(first(way, 2)))),
        split_concepts(first(r"(?i)\b(?:passando\s+per|through|via)\s+(.+?)(?:[.?]|$)")),
        cleaned(every(r"\b[A-Z]{2,10}(?:[-_/][A-Z0-9]{1,10})?\b", 0)),
        cleaned(exact_phrases(query)),
    )
    acronym = lambda c: c.rlike("^[A-Z]{2,10}([-_/][A-Z0-9]{1,10})?$")
    names = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair]) if aliases else None
    canon = lambda c: F.lower(c) if names is None else F.coalesce(F.element_at(names, F.lower(c)), F.lower(c))
    strong = lambda a: F.filter(a, lambda c: acronym(c) | ~F.lower(c).isin(C.WEAK_CONCEPTS))
    first = lambda own, keys: F.filter(own, lambda c, i: F.array_position(keys, canon(c)) == i + 1)
    every = let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.filter(graph_tokens(query), lambda t: F.char_length(t) >= 4)))
    return F.slice(let(strong(F.array_distinct(every)), lambda own: let(F.transform(own, canon), lambda keys: first(own, keys))), 1, most)


def understand_queries(queries: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """X-18, X-19, X-20 and J-12 together. queries: query_id, query, and optionally active_doc, which holds where the question names no document.

    Adds the columns of route_queries, tokens, terms, pages, acronyms (as search.tokenize_queries
    and search.query_facets), document, asked_terms, exact_phrases, concepts, graph_tokens
    with the tokens of roles, and search_terms: the words of the question and of the metrics it means.
    """
    from docmill.operators.search import query_facets, tokenize_queries, words

    q = F.coalesce("query", F.lit(""))
    named = asked_document(q)
    if "active_doc" in queries.columns:
        named = F.when(named != "", named).otherwise(F.coalesce("active_doc", F.lit("")))
    out = query_facets(tokenize_queries(route_queries(queries))).drop("phrases")
    return out.withColumns(
        {
            "document": named,
            "asked_terms": asked_terms(q),
            "exact_phrases": exact_phrases(q),
            "concepts": graph_concepts(q, aliases),
            "graph_tokens": F.array_distinct(F.concat(graph_tokens(q), role_tokens(F.lower(q)))),
            "search_terms": F.array_distinct(F.concat(words(q), words(F.array_join(metric_aliases(F.lower(q)), " ")))),
        }
    )
