"""Packing of tokenised documents into windows of several lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.vocab import encode_with_added, rank_encoding

TIERS = (256, 512, 1024, 2048)
END_ID = 1


class Pool:
    """Pieces (document, start, length) shorter than the longest window, by length."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple]] = [[] for _ in range(longest + 1)]
        self.there = 0  # bit n is set if a piece of length n is there

    def add(self, piece: tuple) -> None:
        self.by_length[piece[2]].append(piece)
        self.there |= 1 << piece[2]

    def take(self, length: int) -> tuple:
        row = self.by_length[length]
        piece = row.pop()
        if not row:
            self.there ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        """The largest length there that is at most `most`; 0 without one."""
        return (self.there & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.there & ((1 << (most + 1)) - 1) else 0

    def shortest(self, above: int) -> int:
        """The smallest length there that is over `above`; 0 without one."""
        rest = self.there >> (above + 1)
        return above + (rest & -rest).bit_length() if rest else 0


class Packer:
    """Fills windows exactly, longest tier first, and closes what is left when it ends.

    A document goes to full windows of the longest tier as far as it reaches; what is left
    of it goes to the shortest tier that holds it. Each tier packs its own pieces, and a gap
    is filled by the longest whole pieces of shorter tiers that fit; only if none fits, the
    shortest piece there is cut to fill it. So all windows but the last are full.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.pool = Pool(self.tiers[-1])

    def add(self, doc, n: int) -> Iterator[tuple[int, list[tuple]]]:
        most = self.tiers[-1]
        for start in range(0, n - most + 1, most):
            yield most, [(doc, start, most)]
        if n % most:
            self.pool.add((doc, n - n % most, n % most))

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple]]]:
        """Windows (size, pieces) of what the pool holds. Unless last, what can't fill a window stays in the pool."""
        pool, shorter = self.pool, 0
        for tier in reversed(self.tiers):
            shorter = max([0, *(t for t in self.tiers if t < tier)])
            while (length := pool.longest(tier)) > shorter:
                window, free = [pool.take(length)], tier - length
                while free:
                    if length := pool.longest(free):
                        window.append(pool.take(length))
                        free -= length
                    elif length := pool.shortest(free):
                        doc, start, _ = pool.take(length)
                        window.append((doc, start, free))
                        pool.add((doc, start + free, length - free))
                        free = 0
                    else:
                        break
                if free:  # the pool is empty: the window stays open
                    for piece in window:
                        pool.add(piece)
                    if last:
                        yield self.tiers[-1], self.drain()
                    return
                yield tier, window

    def drain(self) -> list[tuple]:
        out = []
        while length := self.pool.longest(self.tiers[-1]):
            out.append(self.pool.take(length))
        return out


class Steps:
    """Numbers step groups so that each holds the same number of tokens, whatever tiers it mixes."""

    def __init__(self, tokens: int):
        self.tokens, self.next, self.open = tokens, 0, {}

    def put(self, size: int) -> int:
        """A group with room for a window of this size: the open one of that size, so that groups fill exactly."""
        group, used = self.open.get(size, (None, self.tokens))
        if used + size > self.tokens:
            group, used, self.next = self.next, 0, self.next + 1
        self.open[size] = (group, used + size)
        return group


def pack_documents(docs: DataFrame, ranks: str, added: dict[str, int] | None = None, tiers: tuple[int, ...] = TIERS, held_tokens: int = 1 << 20, step_tokens: int = 1 << 15) -> DataFrame:
    """Packs all documents into windows of several lengths; one row for each piece.

    docs: doc_id, text and any further columns, which are not read. ranks: path of a byte-level
    vocabulary as ranks; added: tokens beside it, whose strings in a text stand for their ids. Each document is its ids and END_ID. Returns doc_id long, start long
    (ids of the document before the piece), length long, ids binary (little-endian unsigned 32
    bits), doc_tokens long, sequence_id long, offset long (place in its window), tier int (the
    window's size), step_group long (windows of one training step; all of a group have one
    size, and full groups hold step_tokens ids).

    Edge cases: a null or empty text is END_ID alone; equal texts and repeated rows are packed
    one by one; a null doc_id stays null; very long texts and runs of white space are encoded
    like any other and cut over many windows; an empty table gives an empty result.

    Scale: texts are tokenised and packed where they are read, with no shuffle. A task holds
    about held_tokens ids and then packs them; pieces that fill no window wait for the next
    ones, so each task leaves one window that is not full. Ids of windows and groups start with
    the number of the partition, whose rows come in the order of its files: a task that runs
    again gives the same result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks)
        packer, steps = Packer(tiers), Steps(step_tokens)
        part = TaskContext.get().partitionId() << 40
        ids: dict[int, tuple] = {}  # row number: doc_id, ids, ids not yet out
        rows: list[tuple] = []
        number = count = held = 0

        def put(size: int, window: list[tuple]) -> None:
            nonlocal number
            group, offset = part + steps.put(size), 0
            for doc, start, length in window:
                doc_id, own, left = ids[doc]
                rows.append((doc_id, start, length, own[start : start + length].tobytes(), len(own), part + number, offset, size, group))
                offset += length
                if left == length:
                    del ids[doc]
                else:
                    ids[doc] = (doc_id, own, left - length)
            number += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = np.append(encode_with_added(encoding, added or {}, text.as_py() or ""), END_ID).astype("<u4")
                ids[count] = (doc_id, own, len(own))
                held += len(own)
                for window in packer.add(count, len(own)):
                    put(*window)
                count += 1
                if held >= held_tokens:
                    for window in packer.windows(False):
                        put(*window)
                    held = 0
                    yield out()
        for window in packer.windows(True):
            put(*window)
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    )
