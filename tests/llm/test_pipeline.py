import importlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docmill.llm import secrets
from tests.llm.test_nearcopies import brute_keep


def test_stages_against_brute_force(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = np.random.default_rng(8)
    words = {"en": ["the", "window", "house", "running"], "de": ["schlange", "ungern", "einig", "überall"]}
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(words[lang], 60))
        if i % 10 == 3:
            text += " token=abcdefgh123"
        if i % 10 == 4:
            text += " <|endoftext|> the end"
        rows.append((i, text, lang, "s", len(text)))
        if i % 3 == 0:
            rows.append((100 + i, text, lang, "s", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "123 --", "de", "s", 6), (7, rows[7][1], "x", "y", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()

    lettered = [(r[0], r[1]) for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    best, group = brute_keep(lettered)
    kept = {(g, doc) for g, (_, doc) in best}
    scanner = secrets.compile_scanner()
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, (doc, text) in enumerate(lettered):
        if (group[i], doc) in kept:
            for a, _, b in reversed(secrets.scan(scanner, text.encode())):
                text = (text.encode()[:a] + b"[secret]" + text.encode()[b:]).decode()
            assert doc not in want
            want[doc] = len(enc.encode(text, add_special_tokens=False).ids) + 1
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_stages_keep_the_columns(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([(1, "the window house", "en", "s", 16), (None, "the house", "en", None, 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_stages_on_hard_tables(spark):
    """Empty tables, very long texts and white space, and extra columns with the names that the operators use."""
    pipeline = importlib.import_module("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, "the window house " * 30 + " " * 1_200_000 + "end", "en", "s", 1), (2, "x" * 3_000_000, "en", "s", 1), (2, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for c in ("fp", "k1", "row", "sim", "spans", "ids", "start", "_nth_of_id", "key"):
            docs = docs.withColumn(c, F.lit("x"))
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, "")
            if name == "packing":
                assert out.count() > 0 or not rows
            else:
                assert out.columns == docs.columns, name
                assert out.count() == (0 if not rows else {"language": 2, "near_dedup": 3, "secrets": 3}[name]), name
