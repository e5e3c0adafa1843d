from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docmill.llm.packing import pack_documents
from docmill.llm.vocab import added_tokens, encode_with_added, rank_encoding

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ADDED = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def whole(rows, packed):
    """Checks that each id lies in one piece and that windows have no gaps; returns their padding."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows)
    docs, windows = defaultdict(list), defaultdict(list)
    for r in packed:
        assert r.length * 4 == len(r.ids)
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    got = []
    for pieces in docs.values():
        pieces.sort(key=lambda r: r.start)
        at = 0
        ids = []
        for r in pieces:
            assert r.start == at
            ids += np.frombuffer(r.ids, "<u4").tolist()
            at += r.length
        assert all(r.doc_tokens == at for r in pieces)
        got.append(ids)
    assert sorted(got) == want
    pad = 0
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= pieces[0].tier <= 2048
        pad += 0 if at in (1 << k for k in range(12)) else 2048 - at
    groups = defaultdict(int)
    for w, pieces in windows.items():
        groups[pieces[0].step_group] += sum(r.length for r in pieces)
    assert all(n <= 1 << 15 for n in groups.values())
    return pad


def test_whole_documents(spark):
    rng = np.random.default_rng(2)
    words = ["the", "Été", "window", "  ", "\n", "don't", "12", "<|endoftext|>", "zürich"]
    rows = [(1, None), (2, ""), (3, "x"), (4, "a b " * 40000), (5, "same"), (6, "same"), (7, "hello <|endoftext|> world"), (8, " " * 1_500_000 + "x"), (9, "<|endoftext|>")]
    rows += [(10 + i, " ".join(rng.choice(words, int(rng.integers(1, 900))))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids", "5 as start", "7 as length").coalesce(2)
    assert whole(rows, pack_documents(df, RANKS, ADDED).collect()) <= 2 * 2048
    assert whole(rows, pack_documents(df, RANKS, ADDED, held_tokens=3000).collect()) <= 2 * 2048


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (7, "b c"), (7, "b c")], "doc_id long, text string").coalesce(1)
    got = pack_documents(df, RANKS, ADDED).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 2), (7, 3), (7, 3)]
    assert len({r.sequence_id for r in got}) == 1
    assert pack_documents(df.limit(0), RANKS, ADDED).count() == 0


def test_ids_are_the_library_s():
    """Special tokens, cut and whole, and runs of white space around the length at which they are cut out; the library as it comes."""
    tok, enc, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rank_encoding(RANKS), np.random.default_rng(5)
    assert encode_with_added(enc, ADDED, "hello <|endoftext|> world").tolist() == tok.encode("hello <|endoftext|> world", add_special_tokens=False).ids and len(encode_with_added(enc, ADDED, "hello <|endoftext|> world")) == 4
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "the", "été", "'s", " " * 4095, " " * 4096, "\n" * 5000, "\u3000" * 4100, " \t" * 3000, "\x1c", "12"]
    for _ in range(150):
        text = "".join(rng.choice(bits, int(rng.integers(1, 8))))
        assert encode_with_added(enc, ADDED, text).tolist() == tok.encode(text, add_special_tokens=False).ids, text
    for text in (" " * 5_000_000 + "x", "a" + "\n" * 5_000_000):
        assert encode_with_added(enc, ADDED, text).tolist() == tok.encode(text, add_special_tokens=False).ids
