"""Chunking of documents, section hints, neighbouring context and chunk identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.clean import clean_markdown, let, normalize_unicode, strip


def windows(text: Column, size: int, overlap: int) -> Column:
    """The texts of fixed windows. The last may lie inside the one before it; an empty or null text has one window, itself.

    One pass over the text: a match goes on by a step and captures a window ahead. Cutting each
    window out by its place would count characters from the beginning again every time.
    """
    pattern, group = (f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}", 1) if overlap else (f"(?s).{{1,{size}}}", 0)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.char_length(text) > 0, found).otherwise(F.array(text))


def chunk_fixed(docs: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """X-1. One row a window: all columns but text, and pos, chunk. A document without text has one empty chunk."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("*", F.posexplode(windows(text, size, overlap)).alias("pos", "chunk")).drop("text")


def _pack(text: Column, size: int, sep: str) -> Column:
    """Runs of pieces between separators, as many as stay within size together; a longer piece stays alone.

    One pass of a regex: the longest stretch within size that ends at a separator or at the
    end, else the shortest one that does.
    """
    end = rf"(?=\Q{sep}\E|\z)"
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{0,{size}}}{end}|.+?{end})(?:\Q{sep}\E|\z)"), F.lit(1))


def chunk_paragraphs(docs: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """X-2. Blank-line paragraphs packed up to size; longer ones are cut as in X-1."""
    pieces = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n"), strip), lambda p: p != "")
    packed = F.filter(_pack(F.array_join(pieces, "\n\n"), size, "\n\n"), lambda p: p != "")
    cut = F.flatten(F.transform(packed, lambda p: F.when(F.char_length(p) <= size, F.array(p)).otherwise(windows(p, size, overlap))))
    return docs.select("*", F.posexplode(cut).alias("pos", "chunk")).drop("text")


def soft_windows(text: Column, tokens: int) -> Column:
    """The texts of windows of four characters a token: each ends at its last blank line, else line end, else space, if that is past its half, and the next begins a tenth of a window before that.

    One pass of a regex that cuts the text at the ends of the windows; a window is such a part and
    the overlap, which lies in the part before. To look for an end from the beginning of the
    window would step over the overlap again at every place tried. A rest within one window is the last.
    """
    size, overlap = 4 * tokens, 4 * tokens // 10
    half = size // 2 + 1
    ends = [(half, size - 2, "(?=\n\n)"), (half, size - 1, "(?=\n)"), (half, size - 1, "(?= )"), (size, size, "")]
    part = lambda before: "|".join([rf".{{1,{size - before}}}+\z", *(f".{{{a - before},{b - before}}}{mark}" for a, b, mark in ends)])
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)\A(?:{part(0)})|(?!\A)(?:{part(overlap)})"), F.lit(0))
    return let(parts, lambda all: F.transform(all, lambda p, i: F.when(i > 0, F.concat(F.right(F.get(all, i - 1), F.lit(overlap)), p)).otherwise(p)))


def chunk_soft(docs: DataFrame, tokens: int = 2000) -> DataFrame:
    """X-3. Windows of four characters a token with a tenth of overlap, cut at soft places. Blank chunks are dropped."""
    cuts = F.filter(F.transform(soft_windows(F.coalesce("text", F.lit("")), tokens), strip), lambda p: p != "")
    return docs.select("*", F.posexplode(cuts).alias("pos", "chunk")).drop("text")


SEPARATORS = ("\n\n", "\n", ". ", " ")
BLANK_LINE = "\ufdd0\ufdd1"  # noncharacters that stand for two line ends; in a run of line ends the first two belong together


def chunk_recursive(docs: DataFrame, size: int = 1200, slack: int = 200) -> DataFrame:
    """X-4. docs: doc_id, text. Texts over size + slack are split at the first separator they hold and packed up to size; what is still too long goes on with the next, and without any is halved.

    Four rounds use up the separators; a separator that a part has been split at can only come
    back through packing, which keeps parts within size. Then parts are halved until all fit: a
    sequence of equal cuts gives the same parts as halving again and again. Each round passes
    once over a part.
    """
    out = docs.withColumn("_parts", F.array(F.coalesce("text", F.lit(""))))

    def splitter(sep: str):
        # A part is split here only if it is too long; earlier rounds have used up the earlier separators.
        def split(p: Column) -> Column:
            if sep == "\n\n":
                packed = F.transform(_pack(F.replace(p, F.lit(sep), F.lit(BLANK_LINE)), size, BLANK_LINE), lambda x: F.replace(x, F.lit(BLANK_LINE), F.lit(sep)))
            else:
                packed = _pack(p, size, sep)
            return F.when((F.char_length(p) <= size + slack) | ~p.contains(sep), F.array(p)).otherwise(packed)

        return split

    for sep in SEPARATORS:
        out = out.withColumn("_parts", F.flatten(F.transform("_parts", splitter(sep))))

    def halves(p: Column) -> Column:
        n = F.char_length(p)
        k = F.greatest(F.lit(0), F.ceil(F.log2(n / float(size + slack)))).cast("int")
        width = F.greatest(F.ceil(n / F.pow(F.lit(2.0), k)).cast("int"), F.lit(1))
        cut = F.regexp_extract_all(p, F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), F.lit(0))
        return F.when(n <= size + slack, F.array(p)).otherwise(cut)

    flat = F.filter(F.transform(F.flatten(F.transform("_parts", halves)), strip), lambda t: t != "")
    return out.select(*[c for c in docs.columns if c != "text"], F.posexplode(flat).alias("pos", "chunk"))


def chunk_markdown(docs: DataFrame, least: int = 40, tokens: int = 1024) -> DataFrame:
    """X-5. docs: doc_id, filename, text. Cleaned Markdown in sections and paragraphs, cut softly, each with a header of document and section."""
    cleaned = clean_markdown(docs)
    sections = F.filter(F.transform(F.split("text", r"\n(?=# )|\n[ \t]*\n"), strip), lambda s: F.char_length(s) >= least)
    rows = cleaned.select("doc_id", "filename", F.posexplode(sections).alias("section", "text"))
    cut = chunk_soft(rows.withColumn("section_hint", F.substring(F.regexp_replace(F.split("text", "\n")[0], "^#+ *", ""), 1, 60)), tokens)
    order = Window.partitionBy("doc_id").orderBy("section", "pos")
    return cut.select(
        "doc_id", "filename", (F.row_number().over(order) - 1).alias("chunk_index"), "section_hint",
        F.concat(F.lit("Doc: "), "filename", F.lit(" | Sezione: "), "section_hint", F.lit("...\n"), "chunk").alias("chunk"),
    )


def chunk_markdown_pages(docs: DataFrame, most: int = 1200, size: int = 1000, overlap: int = 200, carry: bool = True) -> DataFrame:
    """X-5 by virtual pages. docs: doc_id, filename, text. Cleaned Markdown in paragraphs, those over `most` characters in fixed windows: doc_id, filename, page_no, chunk_index, section_hint, text, chunk (with a header of document and beginning).

    A paragraph's page is the number of its own `# PAGE n`, else of the last one before it in the
    document, else 1; with carry=False a paragraph without a mark is on page 1. Null names are
    empty; a null text has no chunks.
    """
    named = docs.select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"), "text")
    parts = F.filter(F.transform(F.split("text", r"\n(?=# PAGE)|\n\n"), strip), lambda s: s != "")
    rows = clean_markdown(named).select("doc_id", "filename", F.posexplode(parts).alias("section", "part"))
    own = F.regexp_extract("part", r"# PAGE ([0-9]+)", 1)
    mark = F.when(own != "", own.try_cast("int"))
    order = Window.partitionBy("doc_id", "filename").orderBy("section")
    page = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) if carry else mark
    paged = rows.withColumn("page_no", F.coalesce(page, F.lit(1)))
    cuts = F.when(F.char_length("part") <= most, F.array("part")).otherwise(windows(F.col("part"), size, overlap))
    each = paged.select("doc_id", "filename", "page_no", "section", F.posexplode(cuts).alias("pos", "text"))
    hinted = section_hints(normalize_unicode(each))
    head = F.concat(F.lit("Doc: "), "filename", F.lit(" | Content: "), F.substring("text", 1, 80), F.lit("...\n"), "text")
    index = F.row_number().over(Window.partitionBy("doc_id", "filename").orderBy("section", "pos")) - 1
    return hinted.select("doc_id", "filename", "page_no", index.alias("chunk_index"), "section_hint", "text", head.alias("chunk"))


def section_hints(pages: DataFrame) -> DataFrame:
    """X-6. The first of the first 15 non-blank lines that looks like a heading; empty without one."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[\r\n]"), strip), lambda ln: ln != "")
    good = F.filter(F.slice(lines, 1, 15), lambda ln: F.char_length(ln).between(4, 90) & (F.regexp_count(ln, F.lit(r"\.")) <= 1) & ~ln.endswith("."))
    return pages.withColumn("section_hint", F.when(F.size(good) > 0, F.get(good, 0)).otherwise(""))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """X-7. Reads doc_id, page_no, chunk_index, toon_type, text, image_id."""
    seed = F.concat(F.col("doc_id").cast("string"), F.lit("::p"), F.col("page_no").cast("string"), F.lit("::i"), F.col("chunk_index").cast("string"), F.lit("::"), "toon_type", F.lit("::"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16))
    seed = F.concat(seed, F.when(F.col("image_id").isNotNull(), F.concat(F.lit("::img"), F.col("image_id").cast("string"))).otherwise(""))
    return chunks.withColumn("chunk_uuid", F.substring(F.sha2(seed, 256), 1, 32))


def context_windows(chunks: DataFrame, n: int = 260) -> DataFrame:
    """W-2. The end of the chunk before and the beginning of the one after, in document order. Reads doc_id, chunk_index, text."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumns({"context_prev": F.coalesce(F.lag(F.right("text", F.lit(n))).over(order), F.lit("")), "context_next": F.coalesce(F.lead(F.substring("text", 1, n)).over(order), F.lit(""))})


def _tail(body: Column, tail: int, least: int) -> Column:
    return F.when(F.char_length(body) > least, F.right(body, F.lit(tail))).otherwise("")


def _semantic(page_no: Column, before: Column, body: Column) -> Column:
    head = F.concat(F.lit("Doc: "), "filename", F.lit(" | Pagina: "), page_no.cast("string"), F.lit("\n"))
    return F.concat(head, F.when(before != "", F.concat(F.lit("... "), before, F.lit("\n"))).otherwise(""), body)


def page_overlap(pages: DataFrame, tail: int = 250, least: int = 40) -> DataFrame:
    """W-3. A page's semantic text: header, the end of the page before, text. Short pages give no row and no tail."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    body = strip(F.coalesce("text", F.lit("")))
    before = F.coalesce(F.lag(_tail(body, tail, least)).over(order), F.lit(""))
    rows = pages.withColumn("_before", before).where(F.char_length(body) > least)
    return rows.withColumn("text_sem", _semantic(F.col("page_no"), F.col("_before"), body)).drop("_before")


def overlapping_pages(docs: DataFrame, page_chars: int = 1800, tail: int = 250, least: int = 40) -> DataFrame:
    """W-3 for texts that are cut into pages here: a page's neighbour is at hand in the row, so nothing is shuffled. docs: doc_id, filename, text. Rows: doc_id, filename, page_no, text (stripped), text_sem."""
    bodies = F.transform(windows(F.coalesce("text", F.lit("")), page_chars, 0), strip)
    each = let(bodies, lambda all: F.transform(all, lambda b, i: F.struct((i + 1).alias("page_no"), b.alias("text"), F.when(i > 0, _tail(F.get(all, i - 1), tail, least)).otherwise("").alias("before"))))
    rows = docs.select("doc_id", "filename", F.explode(F.filter(each, lambda p: F.char_length(p["text"]) > least)).alias("_p"))
    return rows.select("doc_id", "filename", "_p.page_no", "_p.text", _semantic(F.col("_p.page_no"), F.col("_p.before"), F.col("_p.text")).alias("text_sem"))


def assign_chunk_index(chunks: DataFrame) -> DataFrame:
    """W-9. A dense index for each document, by page and position."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "pos")) - 1)


def dedupe_page_chunks(chunks: DataFrame, least: int = 100) -> DataFrame:
    """D-4. Within a page, chunks of at least 100 characters, each text once: that of the lowest position."""
    once = Window.partitionBy("doc_id", "page_no", F.md5("text")).orderBy("pos")
    return chunks.where(F.char_length("text") >= least).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")

