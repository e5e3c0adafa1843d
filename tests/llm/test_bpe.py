import random

import numpy as np
import public_tokenizers
import tiktoken

from docmill.llm import bpe
from docmill.llm.vocab import read_ranks

RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_stitched_chunks_equal_the_whole():
    """Small chunks and overlaps, so that seams fall inside words, contractions, white space and runs without any boundary."""
    enc, rng = library(), random.Random(7)
    bits = ["the", " ", "  ", "\n", "\n\n ", "\t", "don't", "we'll", "'re", "12345", "é", "ß", "日本", "!!", "…", "a" * 40, " " * 30, " ", "<|endoftext|>", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        size, overlap = rng.randrange(1, 60), rng.randrange(0, 40)
        pieces = [bpe.encode_chunk(enc, *c) for c in bpe.chunks(text, size, overlap)]
        assert bpe.stitch(enc, pieces, lambda text=text: text).tolist() == enc.encode_ordinary(text), (text, size, overlap)


def test_seams_meet_in_prose():
    """In ordinary text every seam agrees, so that nothing is encoded twice."""
    enc = library()
    text = "The quick brown fox can't jump over 12 lazy dogs.\n" * 200

    def never():
        raise AssertionError

    pieces = [bpe.encode_chunk(enc, *c) for c in bpe.chunks(text, 700, 100)]
    assert bpe.stitch(enc, pieces, never).tolist() == enc.encode_ordinary(text)


def test_operator(spark):
    enc = library()
    rows = [(1, None), (2, ""), (3, "plain"), (4, "long text, déjà vu. " * 300), (5, "z" * 5000), (None, " x"), (5, "z" * 5000), (6, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'i' as ids", "0 as start")
    out = bpe.decode_documents(bpe.encode_documents(df, RANKS, chunk=100, overlap=60, apart=500), RANKS).collect()
    want = sorted((d or 0, enc.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in out) == want
    assert bpe.encode_documents(df.limit(0), RANKS).count() == 0


def test_numpy_encoding_is_the_library_s():
    enc = library()
    text = "Ünïcode and 123 numbers\n\n  <|endoftext|> 'll"
    assert np.array_equal(enc.encode_to_numpy(text, disallowed_special=()), enc.encode_ordinary(text))


def plain_bpe(piece, ranks):
    """Merges of one pre-token, one after another: the lowest rank first, of equal ones the leftmost."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            break
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
    return [ranks[p] for p in parts]


def plain_ids(text, ranks):
    import regex

    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in plain_bpe(m.group().encode(), ranks)]


def test_runs_of_white_space_against_plain_merges():
    enc, ranks, rng = library(), read_ranks(RANKS), random.Random(9)
    bits = ["the", " ", "\n", " " * 200, "\n" * 130, "\u2003" * 60, " \t" * 90, "été", "'s", "x1", " " * 4096]
    for _ in range(25):
        text = "".join(rng.choice(bits[:10]) for _ in range(rng.randrange(1, 9)))
        for size in (50, 1 << 13):
            assert bpe.encode_here(enc, text, size, 20).tolist() == plain_ids(text, ranks), text
    for around in ("a{}b", "{}b", "a{}", "{}", "\n{}'s"):
        text = around.format(" " * 5000)
        assert bpe.encode_here(enc, text, 1 << 10, 100).tolist() == enc.encode_ordinary(text), around


def test_very_long_runs(spark):
    """Five million spaces: one pre-token, and what follows it."""
    enc = library()
    text = "é" + " " * 5_000_000 + "end" + "\n" * 5000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = bpe.decode_documents(bpe.encode_documents(df, RANKS), RANKS).first()
    want = [*enc.encode_ordinary("é"), *enc._encode_single_piece(" " * 4_999_999), *enc.encode_ordinary(" end" + "\n" * 5000)]
    assert got.ids == want and bytes(got.decoded) == text.encode()
