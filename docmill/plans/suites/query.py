"""Queries of the understanding of questions, and their SQL as text that the composed jobs use too."""

import re

from pyspark.sql import functions as F

from docmill.functions import cues as C
from docmill.functions import lexicons as L
from docmill.operators import query
from docmill.operators.clean import whole_words
from docmill.plans import fixtures as fx
from docmill.plans.registry import register


def quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def has(terms):
    return f"regexp_matches(q, {quoted('(' + '|'.join(map(re.escape, terms)) + ')')})"


def word(terms):
    return f"regexp_matches(q, {quoted(whole_words('|'.join(map(re.escape, terms))))})"


def count(terms, test=has):
    return "(" + " + ".join(f"cast({test([t])} as int)" for t in terms) + ")"


SIGN = f"regexp_matches(q, {quoted(query.SIGNS)})"
NUMBER = "regexp_matches(q, '[0-9]')"
#: Columns of a table of questions with q, the question in lower case; later ones use earlier ones.
ROUTES = {
    "is_calculation": f"({has(C.CALCULATION_VERBS)} and ({NUMBER} or {SIGN})) or {has(C.ALGEBRA_TERMS)}",
    "regulatory": f"({has(C.CLASSIFYING_STARTERS)} and {has(C.REGULATORY_WORDS)}) or {count(C.REGULATORY_WORDS)} >= 2",
    "is_formula_lookup": f"not is_calculation and {has(C.FORMULA_LOOKUP)}",
    "is_formula_strict": f"{has(C.EXPLICIT_FORMULA)} or (not regulatory and ({has(C.STRICT_CALCULATION)} or ({SIGN} and {has(C.OPERATIONAL_VERBS)})))",
    "mathematical": f"regexp_matches(q, {quoted(C.MATH_PATTERN)}) or ({NUMBER} and ({word(C.MATH_TERMS)} or {has(C.MATH_SIGNS)})) or is_calculation",
    "is_glossary": f"not mathematical and not {has(C.REASONING_TERMS)} and {has(C.DEFINITION_TERMS)}",
    "is_mixed_glossary": f"{has(C.GLOSSARY_NAMES)} and {has(C.MIXED_GLOSSARY)}",
    "is_graph": f"not {has(C.ABSENCE_CHECKS)} and ({has(C.EXPLICIT_GRAPH)} or (not {word(C.ANALYSIS_TERMS)} and {word(C.RELATION_TERMS)}))",
    "is_graph_strict": f"{has(C.EXPLICIT_GRAPH)} or (not {has(C.EXPLANATORY_TERMS)} and {has(C.STRONG_GRAPH)})",
    "is_evidence": has(C.EVIDENCE_TERMS),
    "is_follow_up": f"length(trim(q)) < 140 and {word(C.FOLLOW_UP)}",
    "is_checklist": f"{word(C.CHECKLIST_STRONG)} or {count(C.CHECKLIST_WEAK, word)} >= 2",
    "is_crosswalk": f"{has(C.MAPPING_TERMS)} and {count(C.FRAMEWORK_TERMS)} >= 2",
    "is_pasted_data": rf"""(regexp_matches(q, '[\[(][ \t\n\r\f]*[0-9,. \t\n\r\f-]{{3,}}[ \t\n\r\f]*[\])]') or regexp_matches(q, '\|[\p{{L}}\p{{N}}_ \t\n\r\f.-]+\|[\p{{L}}\p{{N}}_ \t\n\r\f.-]+\|') or regexp_matches(q, '"[\p{{L}}\p{{N}}_]+"[ \t\n\r\f]*:[ \t\n\r\f]*[0-9.]+')
     or len(regexp_extract_all(q, '(?:^|\n)[\p{{L}}\p{{N}}_ \t\n\r\f.-]+[,\t;][\p{{L}}\p{{N}}_ \t\n\r\f.,-]+')) >= 3 or len(regexp_extract_all(q, '\b[0-9]+(?:\.[0-9]+)?\b')) >= 6) and {has([*C.DATA_ACTIONS, *C.DATA_MEASURES, *C.DATA_DOMAIN])}""",
    "is_tier_a": f"not is_glossary and not mathematical and {word(C.NORM_TERMS)}",
    "intent": f"""case when regulatory then 'audit' when is_calculation or is_formula_lookup or {has(C.STRONG_MATH)} or ({has(C.WEAK_MATH)} and ({NUMBER} or {SIGN} or {has(C.AMOUNT_CUES)})) then 'formula'
     when {has(C.TABLE_CUES)} then 'table' when {has(C.COMPARISON_CUES)} then 'audit' when {has(C.CHART_CUES)} then 'chart' when {has(C.AUDIT_CUES)} then 'audit' else 'text' end""",
    "answer_mode": f"case when {word(C.AUDIT_MODE)} then 'audit' else 'knowledge' end",
    "wide": f"length(q) > 300 or {count(C.MANY_DOCUMENTS, word)} >= 2 or {word(C.GRAPH_TERMS)} or is_glossary",
    "vector_k": "case when wide then 140 else 100 end",
    "rerank_k": "case when wide then 45 else 35 end",
    "final_k": "case when wide then 15 else 8 end",
    "max_doc": "case when wide then 8 else 5 end",
    "max_page": "case when wide then 4 else 2 end",
}


def routes_sql(source: str, keep: str = "query_id, query") -> str:
    """A select of the columns `keep` and all routes of a table `source` with query."""
    return f"select {keep}, {', '.join(f'{v} as {k}' for k, v in ROUTES.items())} from (select *, lower(coalesce(query, '')) as q from {source})"


#: One question of every kind; each is asked about every item of the benchmark.
QUESTIONS = [
    "quali formule sono presenti nel documento \"Piano_Sicurezza\" su", "calcola il 5% del budget di", "which formulas are there about MTTD, detection time and thresholds in", "cosa significa CSIRT-NX, di", "chi sono i soggetti e le categorie di",
    "confronta le normative e i documenti di audit di", "show the relationships between MFA and access control, of", "mostra la matrice crosswalk ISO e NIST Annex per", "what is the penalty amount of 300 EUR for", "nel grafo, da backup a restore passando per server e storage, su",
    "verifica la conformità con evidenze e log di firewall, page 3-5, per", "questo documento, in merito a", "analizza i dati [1, 2, 3.5] con media e totale,", "risk: 1, 2, 3, 4, 5, 6, 7 trend of", "il glossario e i documenti recuperati, collega", "tabella dei controlli e requisiti di",
    "spiega l'amministratore del tenant e l'incidente in", "solve x = 2 * y for", "tempi di rilevamento/risoluzione: quali metriche in", "soglia di utenti impattati e metriche: calcola la formula di", "file report_2024.pdf about", "", "plain words of", "term definition of \"exact words\" and the role of admin for",
]


def questions(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    asked = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("item_id") % len(QUESTIONS)).cast("int") + 1)
    return b.select(F.col("item_id").alias("query_id"), F.concat(asked, F.lit(" "), F.expr("array_join(slice(split(text, ' '), 1, 6), ' ')")).alias("query"))


ASKED = f"asked as (select item_id as query_id, (array[{', '.join(map(quoted, QUESTIONS))}])[cast(item_id % {len(QUESTIONS)} as int) + 1] || ' ' || array_to_string(string_split(text, ' ')[1:6], ' ') as query from benchmark)"


@register("x20_routes", f"with {ASKED}, r as ({routes_sql('asked')}) select * exclude (query, regulatory, mathematical, wide) from r")
def x20_routes(spark, sf):
    return query.route_queries(questions(spark, sf)).drop("query")


ALIASED = f"""case when not is_formula_strict then [] else list_concat(list_concat(case when {has(C.DETECTION_CUES)} or regexp_matches(q, '{C.DETECTION_RESOLUTION}') then [{', '.join(map(quoted, C.DETECTION_ALIASES))}] else [] end,
 case when {has(C.RESOLUTION_CUES)} or regexp_matches(q, '{C.DETECTION_RESOLUTION}') then [{', '.join(map(quoted, C.RESOLUTION_ALIASES))}] else [] end), case when {has(C.THRESHOLD_CUES)} then [{', '.join(map(quoted, C.THRESHOLD_ALIASES))}] else [] end) end"""
ROLES = "list_filter([" + ", ".join(f"case when {word(t)} then '{v}' end" for t, v in C.ROLE_TOKENS) + "], lambda x: x is not null)"


@register("j12_aliases", f"with {ASKED}, r as ({routes_sql('asked', 'query_id, q')}) select query_id, array_to_string({ALIASED}, '|') as aliases, array_to_string({ROLES}, '|') as roles from r")
def j12_aliases(spark, sf):
    q = F.lower("query")
    return questions(spark, sf).select("query_id", F.array_join(query.metric_aliases(q), "|").alias("aliases"), F.array_join(query.role_tokens(q), "|").alias("roles"))


STOPS = ", ".join(map(quoted, sorted({*L.STOP_WORDS, *C.GRAPH_NOISE})))
GRAPH_TOKENS = f"""list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(query, '[A-Za-zÀ-ÿ0-9_-]+'), lambda t: (upper(t) = t and length(t) between 2 and 10) or (regexp_matches(t, '^[A-Za-z]{{1,5}}[0-9]{{0,3}}$') and length(t) between 2 and 10) or length(t) > 3), lambda t: lower(t))),
 lambda t: t not in ({STOPS}) and length(t) >= 3)"""
DOCUMENT = " ".join(["trim(coalesce(" + ", ".join(f"nullif(regexp_extract(query, {quoted('(?i)\\b(?:documento|file|pdf)\\s+' + p)}, 1), '')" for p in ("[\"']([^\"']+)[\"']", r"([A-Za-z0-9_.-]+\.(?:pdf|md|txt|docx|csv|html))\b", r"([A-Za-z0-9]+[_-][A-Za-z0-9_.-]+)\b")) + ", ''), ' .,:;!?\"''')"])
PHRASES = f"list_distinct(list_concat(list_concat(list_filter(list_transform(regexp_extract_all(query, {quoted(query.QUOTED)}, 1), lambda t: lower(trim(t))), lambda t: length(t) > 2), list_transform(regexp_extract_all(query, '\\b[A-Z]{{2,8}}\\b'), lambda t: lower(t))), list_transform({ALIASED}, lambda t: lower(t))))"


@register("x19_asked", f"""with {ASKED}, r as ({routes_sql('asked', 'query_id, query, q')}) select query_id, {DOCUMENT} as document, array_to_string(list_sort({PHRASES}), '|') as exact_phrases, array_to_string(list_sort({GRAPH_TOKENS}), '|') as graph_tokens,
 (array['', '', 'MTTD', 'CSIRT-NX', '', '', 'MFA', 'ISO|NIST', 'EUR', '', '', '', '', '', '', '', '', '', '', '', '', '', '', 'exact words'])[cast(query_id % {len(QUESTIONS)} as int) + 1] as terms from r""")
def x19_asked(spark, sf):
    q = F.col("query")
    # The capitals of the invented prose are set aside: the terms of the question's own words are compared.
    own = F.filter(query.asked_terms(q), lambda t: t.isin("MTTD", "CSIRT-NX", "MFA", "ISO", "NIST", "EUR", "exact words"))
    return questions(spark, sf).select("query_id", query.asked_document(q).alias("document"), F.array_join(F.array_sort(query.exact_phrases(q)), "|").alias("exact_phrases"), F.array_join(F.array_sort(query.graph_tokens(q)), "|").alias("graph_tokens"), F.array_join(F.array_sort(own), "|").alias("terms"))
