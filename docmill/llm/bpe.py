"""Byte-level BPE of whole texts: overlapping chunks, stitched where their pre-token boundaries meet."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import slices, spread
from docmill.llm.vocab import encode_text, rank_encoding, read_ranks, worker_cache

CHUNK = 1 << 13  # code points that a chunk owns
OVERLAP = 1 << 7  # code points that it sees beyond them, on either side
APART = 1 << 15  # longer texts have their chunks dealt out over all tasks
MARGIN = 8  # a pre-token that ends within this many code points of a cut may end elsewhere in the whole text


class Piece(NamedTuple):
    """What one chunk makes of its text; begin and end count code points of the whole text.

    begin: the first boundary at or after the chunk's start. end: the first at or after its
    stop. ids: of the pre-tokens between. -1: no boundary there is to be trusted.
    """

    begin: int
    end: int
    ids: np.ndarray


def pre_tokens(text: str) -> list[str]:
    """The matches of the public pattern; every code point is in one."""
    import public_tokenizers
    import regex

    if "pattern" not in (held := worker_cache()):
        held["pattern"] = regex.compile(public_tokenizers.PATTERN)
    return held["pattern"].findall(text)


class Ids(dict):
    """The ids of pre-tokens, each encoded when it is first met; emptied when it holds `most`."""

    def __init__(self, encoding, most: int = 300_000):
        super().__init__()
        self.encoding, self.most = encoding, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoding._encode_single_piece(piece))
        if len(piece) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def encode_pieces(encoding, pieces: list[str]) -> np.ndarray:
    key = ("ids", encoding.name)
    if key not in (held := worker_cache()):
        held[key] = Ids(encoding)
    return np.fromiter(chain.from_iterable(map(held[key].__getitem__, pieces)), np.uint32)


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, bool, str]]:
    """(base, start, stop, whether the text ends with it, text with both overlaps) of each chunk; base is where the last begins."""
    for start in range(0, max(len(text), 1), size):
        stop, base = min(len(text), start + size), max(0, start - overlap)
        yield base, start, stop, stop == len(text), text[base : stop + overlap]


def encode_chunk(encoding, base: int, start: int, stop: int, last: bool, text: str) -> Piece:
    """Pre-tokenises a chunk from the beginning of its left overlap on and encodes what it owns.

    Which pre-token follows a boundary depends only on the text after it, so two scans that
    share one boundary share all later ones. A scan that begins in the middle of a pre-token
    has usually met the true one by the chunk's start; stitch() sees whether it has.
    """
    none = np.empty(0, np.uint32)
    found = pre_tokens(text)
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]) + base
    seen_all = base + len(text) == stop and last
    # A slice that ends in white space would be split otherwise there than in the whole text.
    seam = np.array([i == 0 or not text[i - 1].isspace() for i in (ends - base).tolist()], bool)
    seam[-1] |= seen_all
    trusted = ends[seam & (seen_all | (ends < base + len(text) - MARGIN))]
    at = np.searchsorted(trusted, [start, stop])
    if at[0] == len(trusted):
        return Piece(-1, -1, none)
    begin = int(trusted[at[0]])
    if at[1] == len(trusted):
        return Piece(begin, -1, none)
    end = int(trusted[at[1]])
    first, last = np.searchsorted(ends, [begin, end])
    return Piece(begin, end, encode_pieces(encoding, found[first:last]))


def stitch(encoding, pieces: list[Piece], text) -> np.ndarray:
    """The ids of the whole text from its chunks' pieces, in order.

    Each piece must begin where the one before ends. Where one does not, or a boundary is
    missing, the rest of the text (text() gives it whole) is encoded from the last agreed
    boundary on, so the result is exact in any case.
    """
    out, at = [], 0
    for p in pieces:
        if p.begin != at or p.end < 0:
            out.append(encode_text(encoding, text()[at:]))
            break
        out.append(p.ids)
        at = p.end
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def encode_here(encoding, text: str, size: int, overlap: int) -> np.ndarray:
    """The ids of a text whose chunks are encoded one after another. A text of one chunk has no boundary to look for."""
    if len(text) <= size:
        return encode_text(encoding, text)
    return stitch(encoding, [encode_chunk(encoding, *c) for c in chunks(text, size, overlap)], lambda: text)


def _ids(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.empty(0, np.uint32)]).astype(np.int32)))


def encode_documents(docs: DataFrame, ranks: str, chunk: int = CHUNK, overlap: int = OVERLAP, apart: int = APART) -> DataFrame:
    """(doc_id long, ids array<int>) of each whole text of docs, by the vocabulary in the rank file `ranks`.

    docs: doc_id, text and any further columns, which are not read. Each match of the public
    pattern is encoded by itself and special tokens are ordinary text.

    Edge cases: a null or empty text has no ids; equal texts have equal ids; repeated rows and
    null doc_ids keep their rows; very long texts and runs of white space of any length are
    encoded like any other; an empty table gives an empty result.

    Scale: texts of up to `apart` code points are cut into overlapping chunks, encoded and
    stitched where they are read, without a shuffle. The chunks of longer ones are dealt out
    evenly, 4 at a time, and pre-tokenised and encoded apart; only these are shuffled, and one
    text at a time is stitched. Chunks of a text carry the number of their text in its
    partition, whose rows come in the order of its files. A run of white space that is longer
    than a chunk leaves no boundary to agree on: what follows it is encoded where it is
    stitched.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.char_length("text") > apart
    block = 4 * chunk  # of a text that is dealt out

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _ids([encode_here(encoding, t, chunk, overlap) for t in part.column("text").to_pylist()])], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                cols = list(zip(*chunks(text.as_py(), block, overlap), strict=True))
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n), pa.array([doc_id] * n, pa.int64()), *[pa.array(c) for c in cols[:4]], pa.array(cols[4])], ["number", "doc_id", "base", "start", "stop", "last", "text"]
                )
                number += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                out = [encode_chunk(encoding, r["base"], r["start"], r["stop"], r["last"], r["text"]) for r in part.to_pylist()]
                own = [r["text"][r["start"] - r["base"] : r["stop"] - r["base"]] for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("number"), part.column("doc_id"), part.column("start"), pa.array([p.begin for p in out]), pa.array([p.end for p in out]), _ids([p.ids for p in out]), pa.array(own)], ["number", "doc_id", "start", "begin", "end", "ids", "own"]
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, held = rank_encoding(ranks), []

        def out():
            pieces = [Piece(r["begin"], r["end"], np.array(r["ids"], np.uint32)) for r in held]
            ids = stitch(encoding, pieces, lambda: "".join(r["own"] for r in held))
            return pa.RecordBatch.from_arrays([pa.array([held[0]["doc_id"]], pa.int64()), _ids([ids])], ["doc_id", "ids"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["number"] != r["number"]:
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    long = rows.where(is_long).mapInArrow(cut, "number long, doc_id long, base long, start long, stop long, last boolean, text string")
    long = spread(long, "number", "start").mapInArrow(encode, "number long, doc_id long, start long, begin long, end long, ids array<int>, own string")
    long = spread(long, "number").sortWithinPartitions("number", "start").mapInArrow(join, "doc_id long, ids array<int>")
    return rows.where(~is_long).mapInArrow(whole, "doc_id long, ids array<int>").unionByName(long)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes of the ids, concatenated. An id that the vocabulary lacks fails the job; null ids decode to nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("bytes", ranks)
        if key not in (held := worker_cache()):
            held[key] = {rank: token for token, rank in read_ranks(ranks).items()}
        get = held[key].__getitem__
        for batch in batches:
            decoded = [b"".join(map(get, ids.values.to_pylist() if ids.values is not None else [])) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded binary")
