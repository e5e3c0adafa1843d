"""The whole ingestion job against plain Python, on files with null and repeated ids and names."""

import hashlib
import random
from collections import Counter

import pytest

from docmill.operators import extract
from docmill.plans import pipelines
from tests.test_golden import recursive


def pieces(name, text):
    """(page, position, text, hint) of one file."""
    if text is None:
        return []
    if (name or "").lower().endswith(".md"):
        sections = [s.strip() for s in text.split("\n\n") if len(s.strip()) >= 40]
        return [(1, i, f"Doc: {name} | Sezione: {s[:60]}...\n{s}", s[:60]) for i, s in enumerate(sections)]
    out, before = [], ""
    text = " ".join(text.split())
    for p in range(0, max(len(text), 1), 1800):
        body, number = text[p : p + 1800].strip(), p // 1800 + 1
        hint = body if 4 <= len(body) <= 90 and body.count(".") <= 1 and not body.endswith(".") else ""
        if len(body) > 40:
            whole = f"Doc: {name or ''} | Pagina: {number}\n" + (f"... {before}\n" if before else "") + body
            out += [(number, i, t, hint) for i, t in enumerate(recursive(whole, 1200, 200))]
        before = body[-250:] if len(body) > 40 else ""
    return out


def plain(rows):
    chunks, status = Counter(), Counter()
    for doc, name, path, text in set(rows):
        said = [v if v is not None else "\x00" for v in (None if doc is None else str(doc), name, path, text)]
        shown = str(doc) if doc is not None else hashlib.sha256("\x01".join(said).encode()).hexdigest()[:32]
        n, seen = 0, set()
        for page, _, content, hint in pieces(name, text):
            if (page, content) in seen:
                continue
            seen.add((page, content))
            key = f"{shown}::p{page}::i{n}::text::{hashlib.sha256(content.encode()).hexdigest()[:16]}"
            chunks[doc, name, page, n, content, hint, hashlib.sha256(key.encode()).hexdigest()[:32]] += 1
            n += 1
        status[doc, name, "DONE" if n else "FAILED", n] += 1
    return chunks, status


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) + "." * (rng.random() < 0.1) for _ in range(n))
    out = []
    for i in range(60):
        name = rng.choice([None, f"f{i}.md", f"f{i}.txt", "same.md", "same.txt", "NAME.MD"])
        text = "\n\n".join(prose(rng.randrange(4, 60)) for _ in range(4)) if (name or "").lower().endswith(".md") else prose(rng.randrange(1, 900))
        out.append((rng.choice([None, i, 1, 2]), name, rng.choice([None, "", "a/b"]), rng.choice([text, text, text, None, ""])))
    return out + [out[0]] * 3 + [(5, "x.txt", "p", "one text of two files that has over forty characters"), (5, "y.txt", "p", "one text of two files that has over forty characters")]


def test_the_job_against_plain_python(spark, rows):
    schema = "doc_id long, filename string, path string, text string"
    files = spark.createDataFrame(rows, schema).selectExpr("*", "date'2024-01-01' as ingest_date", "timestamp'2024-01-01' as ingestion_ts", "timestamp'2024-01-01 00:00:01' as started", "timestamp'2024-01-01 00:00:03.5' as ended")
    table, status = pipelines.ingest_corpus(files, extract.taxonomy(spark))
    chunks, states = plain(rows)
    assert Counter((r.doc_id, r.filename, r.page_no, r.chunk_index, r.content, r.section_hint, r.chunk_uuid) for r in table.collect()) == chunks
    got = status.collect()
    assert Counter((r.doc_id, r.filename, r.status, r.total_chunks) for r in got) == states
    assert {r.processing_time_ms for r in got} == {2500}


def test_ingesting_again_replaces(spark, rows):
    schema = "doc_id long, filename string, path string, text string"
    files = spark.createDataFrame(rows, schema).selectExpr("*", "date'2024-01-01' as ingest_date", "timestamp'2024-01-01' as ingestion_ts")
    once, status = pipelines.ingest_corpus(files, extract.taxonomy(spark))
    twice = pipelines.ingest_corpus(files, extract.taxonomy(spark), existing=once)[0]
    assert sorted(r.chunk_uuid for r in twice.collect()) == sorted(r.chunk_uuid for r in once.collect())
    assert {r.processing_time_ms for r in status.collect()} == {None}
