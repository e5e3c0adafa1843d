"""Cleaning, quality flags and typing of texts. Every function adds columns to a DataFrame; nothing is shuffled."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import lexicons as L

BLANKS = " \t\n\r\f"
#: Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces, which are most of them, are no match."""
    return F.trim(F.regexp_replace(c, r"(?:[\t\n\r\f\x0b]| (?=[ \t\n\r\f\x0b]))[ \t\n\r\f\x0b]*", " "))


def let(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def any_of(c: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | c.contains(m)
    return out


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def normalize_whitespace(df: DataFrame, col: str = "text") -> DataFrame:
    """P-1. Null is empty; runs of two to nine spaces, which are table columns, stay."""
    c = F.replace(F.coalesce(F.col(col), F.lit("")), F.lit("\x00"), F.lit(" "))
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("    ")), " {10,}", "    ")
    return df.withColumn(col, strip(F.regexp_replace(c, "\n{3,}", "\n\n")))


def clean_text_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """P-2. Drops ghost glyphs, page furniture and lines without a letter; joins the rest with spaces."""
    c = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "[\x95\x96\x97\x98\x81\x80\x8d]", " ")
    lines = F.transform(F.split(c, "\n"), strip)
    kept = F.filter(lines, lambda ln: (ln != "") & ~F.lower(ln).isin(L.PAGE_FURNITURE) & ~ln.rlike(r"^[^\p{L}_]+$"))
    return df.withColumn(col, squeeze(F.array_join(kept, " ")))


MATH_CONTEXT = r"(?i)(formulae\s+sheet|maths\s+tables|cvss|risk\s+score|impact\s*[x×*]\s*likelihood|inherent\s+risk|residual\s+risk|rto|rpo|control\s+effectiveness|maturity\s+score|sla|severity\s+score|2c0d|standard\s+deviation|likelihood|impact|exposure|[∀-⋿]|[∑∏∫√=≈≠≤≥→↔∩∪∞±×÷]|[•–—˜])"


def _only(last: int, keep) -> str:
    """A pattern for texts of no other characters than those up to last that are kept. They are named one by one, which Java looks up in a table, where a chain of ranges is tried in turn."""
    return r"\A[" + "".join(f"\\x{{{i:X}}}" for i in range(min(last, 0xFF) + 1) if keep(chr(i))) + _ranges(0x100, last, keep) + r"]*\z"


def _ranges(first: int, last: int, keep) -> str:
    out, run = "", []
    for i in range(first, last + 2):
        if i <= last and keep(chr(i)):
            run.append(i)
        elif run:
            out, run = out + f"\\x{{{run[0]:X}}}-\\x{{{run[-1]:X}}}", []
    return out


#: A text of these characters, which neither change nor combine, is in NFKC.
IN_NFKC = _only(0x2AF, lambda c: unicodedata.normalize("NFKC", c) == c)
#: A text of these is the same in a mathematical context and out of it.
PLAIN = _only(0x24F, lambda c: c in "\t\n\x0b\f\r" or " " <= c <= "~" or c >= "\xa0")


def normalize_unicode(df: DataFrame, col: str = "text") -> DataFrame:
    """P-3. NFKC, for which Spark has no function: an Arrow UDF that only rows with characters that it may change reach; the rest is expressions.

    Whether a text is mathematical is asked only where its characters make a difference.
    """

    @F.pandas_udf("string")
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.str.normalize("NFKC")

    plain = F.coalesce(F.col(col), F.lit(""))
    beyond = ~plain.rlike(IN_NFKC)
    c = F.when(beyond, nfkc(F.when(beyond, plain))).otherwise(plain)
    out = df.withColumn(col, c)
    c = F.col(col)
    stripped = F.when(c.rlike(PLAIN), c).when(c.rlike(MATH_CONTEXT), F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")).otherwise(F.regexp_replace(c, "[^\\x20-\\x7E\xa0-\xff\u0100-\u017f\u0180-\u024f]+", " "))
    return out.withColumn(col, squeeze(stripped))




def whole_words(words: str) -> str:
    """A pattern for any of the words, given as an alternation, between characters that are no letters, digits or underscores."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])"


STRUCTURAL_PATTERN = whole_words(L.STRUCTURAL)
URL = r"https?://[^ \t\n\r\f\x0b]+"
#: A word with an at sign inside. It begins where no word goes before, so a word without one is passed once.
ADDRESS = r"(?<![^ \t\n\r\f\x0b])[^ \t\n\r\f\x0b][^ \t\n\r\f\x0b@]*+@[^ \t\n\r\f\x0b]+"


def clean_markdown(df: DataFrame, col: str = "text") -> DataFrame:
    """P-4. Headings and bodies are tested apart; a preamble of under 300 characters goes with the first heading."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "(\n#+ [^\n]*)", "\x01$1\x01"), "\x01")
    kept = F.when((F.size(parts) > 1) & (F.char_length(strip(parts[0])) < 300), F.slice(parts, 3, 1 << 30)).otherwise(parts)
    kept = F.filter(kept, lambda p: ~F.substring(p, 1, 400).rlike(STRUCTURAL_PATTERN))
    for mark, pattern in (("://", URL), ("@", ADDRESS)):
        kept = F.transform(kept, lambda p: F.when(p.contains(mark), F.regexp_replace(p, pattern, "")).otherwise(p))
    return df.withColumn(col, F.array_join(kept, ""))


def flag_structural_pages(df: DataFrame, pattern: str = STRUCTURAL_PATTERN) -> DataFrame:
    """P-5. The first page is never structural."""
    return df.withColumn("structural", F.coalesce(F.substring("text", 1, 400).rlike(pattern) & (F.col("page_no") != 1), F.lit(False)))


def flag_garbage(df: DataFrame, threshold: float = 0.10) -> DataFrame:
    """P-6. garbage: under five characters or too many replacement marks; garbled: any such mark."""
    text = F.coalesce("text", F.lit(""))
    bad = count_of(text, "[□�]")
    return df.withColumns({"garbage": (F.char_length(text) < 5) | (bad / F.greatest(F.char_length(text), F.lit(1)) > threshold), "garbled": bad > 0})


def flag_corrupt_layer(df: DataFrame) -> DataFrame:
    """P-7. Marks of a broken layer, or over 40 % numeric lines among more than five."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    numeric = F.size(F.filter(lines, lambda ln: (F.char_length(ln) > 5) & strip(ln).rlike(r"^[^\p{L}_]+$")))
    return df.withColumn("corrupt", any_of(text, L.BROKEN_MARKS) | ((F.size(lines) > 5) & (numeric / F.size(lines) > 0.4)))


def flag_math_or_table(df: DataFrame, words: list[str] = L.MATH_WORDS) -> DataFrame:
    """P-8."""
    text = F.coalesce("text", F.lit(""))
    marks = text.contains("(cid:") | text.contains("2C0D") | (count_of(text, "•") > 5) | (count_of(text, "—") > 5) | (count_of(text, "˜") > 3)
    dense = (F.char_length(text) > 100) & (count_of(text, "[0-9]") / F.greatest(F.char_length(text), F.lit(1)) > 0.15)
    return df.withColumn("math_or_table", marks | dense | F.lower(text).rlike("|".join(words)) | text.rlike(f"[{L.MATH_SYMBOLS}]") | text.rlike(r"\b[a-zA-Z0-9_]{1,4}[ \t\n\r\f]*=[ \t\n\r\f]*[0-9]"))


def keyword_pattern(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def flag_kg_candidates(df: DataFrame, keywords: list[str] = L.KEYWORDS) -> DataFrame:
    """P-9. kg_candidate: 300 characters and a proper noun with a keyword, or three keywords; keyword_present: the plain variant."""
    text = F.coalesce("text", F.lit(""))
    nouns = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zà-ù]+\b"), F.lit(0))))
    found = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(keyword_pattern(keywords)), F.lit(0))))
    return df.withColumns({"kg_candidate": (F.char_length(text) >= 300) & (((nouns >= 1) & (found >= 1)) | (found >= 3)), "keyword_present": found > 0})


def flag_page_candidates(df: DataFrame) -> DataFrame:
    """P-9 for pages. chart_candidate: a word of charts and diagrams stands in the text; formula_candidate: a word or mark of mathematics does, anywhere."""
    text = F.coalesce("text", F.lit(""))
    return df.withColumns({"chart_candidate": text.rlike(keyword_pattern(L.CHART_PAGE_WORDS)), "formula_candidate": text.rlike("(?i)(" + "|".join(L.FORMULA_PAGE_PATTERNS) + ")")})


def classify_chunk_type(df: DataFrame) -> DataFrame:
    """P-10. Reads toon_type, image_id and text."""
    kind, text = F.lower(F.trim(F.coalesce("toon_type", F.lit("")))), F.coalesce("text", F.lit(""))
    return df.withColumn(
        "chunk_type",
        F.when(kind.isin("formula", "math", "equation"), "formula")
        .when(F.col("image_id").isNotNull(), "image")
        .when(any_of(text, L.VISUAL_MARKS), "image")
        .when(any_of(text, L.TABLE_MARKS), "table")
        .when(kind.isin("chart", "grafico", "chart_analysis"), "chart")
        .when(kind.isin("image", "immagine", "imagine", "visual", "screenshot"), "image")
        .when(kind.isin("table", "tabella"), "table")
        .otherwise("text"),
    )


def classify_visual_chunks(df: DataFrame, words: str = L.VISUAL_WORDS) -> DataFrame:
    """P-11."""
    text = F.coalesce("text", F.lit(""))
    terms = count_of(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({words})(?![\p{{L}}\p{{N}}_])") >= 2
    return df.withColumn("visual", (any_of(text, L.VISION_MARKS) | terms) & ~(text.contains("$$") & ~terms))


def normalize_source_type(df: DataFrame, col: str = "source_type") -> DataFrame:
    """P-12. Unknown types stay."""
    t = F.lower(F.trim(F.coalesce(F.col(col), F.lit(""))))
    return df.withColumn(
        col,
        F.when(t.isin("formula", "math", "equation"), "formula")
        .when(t.isin("image", "immagine", "imagine", "visual", "screenshot"), "image")
        .when(t.isin("chart", "grafico", "chart_analysis", "diagram", "diagramma"), "chart")
        .when(t.isin("table", "tabella"), "table")
        .when(t.isin("text", "testo", ""), "text")
        .otherwise(t),
    )


def normalize_tier(df: DataFrame, col: str = "tier") -> DataFrame:
    """P-13. Exact names and endings, so that GRAPH is not taken for A."""
    t = F.upper(F.trim(F.coalesce(F.col(col), F.lit(""))))
    return df.withColumn(
        col,
        F.when(t == "", "C")
        .when(t.startswith("GRAPH"), "GRAPH")
        .when(t.startswith("USER"), "USER")
        .when((t == "A") | t.endswith("_A_METHODOLOGY"), "A")
        .when((t == "B") | t.endswith("_B_REFERENCE"), "B")
        .when((t == "C") | t.contains("EVIDENCE") | t.contains("EVIDENZA"), "C")
        .otherwise(t),
    )


def doc_name(c: Column) -> Column:
    """P-14: base name, lower case, without extension, `_out` and anything but letters and digits."""
    v = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^.*/", "")
    for pattern in (r"\.(pdf|md|txt|docx|html)$", r"[_\-\s]+out$", r"[_\-\s]+output$", r"[^a-z0-9]+"):
        v = F.regexp_replace(v, pattern, "")
    return v


def normalize_doc_name(df: DataFrame, col: str = "filename") -> DataFrame:
    """P-14."""
    return df.withColumn(col, doc_name(F.col(col)))


def filter_requested_doc(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """P-15. queries: query_id, active_doc; one row a query. Without a request every candidate of the query passes."""
    both = cands.join(queries.select("query_id", doc_name(F.col("active_doc")).alias("_want")), "query_id")
    have = doc_name(F.col("filename"))
    return both.where((F.col("_want") == "") | ((have != "") & (have != "unknown") & (F.contains(have, F.col("_want")) | F.contains(F.col("_want"), have)))).drop("_want")


def filter_small_assets(images: DataFrame, min_bytes: int = 2000) -> DataFrame:
    """P-16."""
    return images.where(F.octet_length("image_data") >= min_bytes)


def prep_embedding_text(df: DataFrame, col: str = "text", max_chars: int = 1800) -> DataFrame:
    """P-17. A heading line goes also where no text stands below it. At the ends of the text all of Unicode's spaces go, as DuckDB's trim has it."""
    own = F.regexp_replace(F.ltrim(F.coalesce(F.col(col), F.lit("")), F.lit(BLANKS)), r"^Doc:[ \t\n\r\f\x0b][^\n]*\n", "")
    return df.withColumn(col, F.substring(F.btrim(squeeze(own), F.lit(SPACES)), 1, max_chars))
