"""What the ingestion job costs: how often texts are dealt out, how often a long word is passed; and that the cheaper patterns give what the plain ones give."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from docmill.operators import chunk, clean
from docmill.plans import pipelines

FILES = "doc_id long, filename string, text string"


def exchanges(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def test_texts_are_dealt_out_once(spark):
    """Only the sections of a Markdown file are numbered by a shuffle; with repeated rows each half is dealt out once, and stays so."""
    files = spark.createDataFrame([(1, "a.md", "x" * 90), (2, "b.txt", "y " * 90), (2, "b.txt", "y " * 90)], FILES)
    assert exchanges(pipelines.pages_of(files)) == 1
    chunks = chunk.assign_chunk_index(chunk.dedupe_page_chunks(pipelines.pages_of(files, repeated=True), 1))
    assert exchanges(chunks) == 2
    assert sorted((r.doc_id, r.chunk_index) for r in chunks.collect()) == [(1, 0), (2, 0)]


def test_a_long_word_beside_an_address(spark):
    """One word of 300,000 characters is passed once, not from each of its characters on."""
    text = "a@b.c " + "x" * 300_000 + " y@ @z d@e@"
    began = time.time()
    assert clean.clean_markdown(spark.createDataFrame([(text,)], "text string")).first().text == " " + "x" * 300_000 + " y@ @z "
    assert time.time() - began < 20


def test_addresses_and_links_against_the_plain_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["@", "a", "b@c", " ", "\n", "\t", "http://", "https://x", "://", ".", "é"]) for _ in range(rng.randrange(0, 14))) for _ in range(600)]
    for r in clean.clean_markdown(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect():
        plain = re.sub(r"https?://[^ \t\n\r\f\x0b]+", "", texts[r.k])
        assert r.text == re.sub(r"[^ \t\n\r\f\x0b]+@[^ \t\n\r\f\x0b]+", "", plain), texts[r.k]


def test_white_space_against_the_plain_pattern(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice([" ", " ", "\t", "\n", "\r", "\f", "\x0b", "a", "é", "\xa0"]) for _ in range(rng.randrange(0, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in df.select("k", clean.squeeze(F.col("text")).alias("text")).collect():
        assert r.text == re.sub(r"[ \t\n\r\f\x0b]+", " ", texts[r.k]).strip(" "), texts[r.k]


def test_characters_that_need_no_library(spark):
    """Every character up to U+02FF alone and beside others: those that the pattern lets pass are in NFKC, also in pairs, and the whole operator gives what the library and the two classes give."""
    kept = [chr(i) for i in range(0x2B0) if unicodedata.normalize("NFKC", chr(i)) == chr(i)]
    assert all(unicodedata.is_normalized("NFKC", a + b) for a in kept for b in kept)
    rng = random.Random(7)
    every = [chr(i) for i in range(0x300)]
    texts = [f"a{c}b" for c in every] + [f"{c} sla" for c in every] + ["".join(rng.choice(every + ["́", "e", "impact"]) for _ in range(6)) for _ in range(500)]
    math = re.compile(clean.MATH_CONTEXT.replace(r"\s", r"[ \t\n\x0b\f\r]"), re.ASCII | re.IGNORECASE)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    flags = {r.k: r.c for r in df.select("k", F.col("text").rlike(clean.IN_NFKC).alias("c")).collect()}
    for r in clean.normalize_unicode(df).collect():
        t = unicodedata.normalize("NFKC", texts[r.k])
        assert flags[r.k] == all(c in kept for c in texts[r.k]), texts[r.k]
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t) if math.search(t) else re.sub("[^\x20-\x7e\xa0-ɏ]+", " ", t)
        assert r.text == re.sub(r"[ \t\n\r\f\x0b]+", " ", t).strip(" "), texts[r.k]


def test_pages_within_a_row_are_those_of_a_table(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word ", "x", "\n", " " * 30, "longerword "]) for _ in range(rng.randrange(0, 120))) for _ in range(80)] + ["", None]
    docs = spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)], FILES)
    table = docs.select("doc_id", "filename", F.posexplode(chunk.windows(F.col("text"), 100, 0)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)
    want = chunk.section_hints(chunk.page_overlap(table, 25)).select("doc_id", "page_no", "text_sem", "section_hint")
    got = chunk.section_hints(chunk.overlapping_pages(docs, 100, 25)).select("doc_id", "page_no", "text_sem", "section_hint")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_soft_windows_of_any_size(spark):
    """Windows of 8 to 400 characters over random texts, characters beyond the first plane among them."""
    from tests.test_golden import soft

    rng = random.Random(9)
    texts = ["".join(rng.choice(["word ", "x", "\n", "\n\n", "longerword ", "😀", "é"]) for _ in range(rng.randrange(0, 300))) for _ in range(60)] + ["", "y" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tokens in (2, 3, 5, 33, 100):
        got = {}
        for r in chunk.chunk_soft(df, tokens).orderBy("doc_id", "pos").collect():
            got.setdefault(r.doc_id, []).append(r.chunk)
        assert all(got.get(i, []) == soft(t, tokens) for i, t in enumerate(texts)), tokens
