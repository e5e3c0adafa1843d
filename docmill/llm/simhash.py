"""SimHash fingerprints of word shingles, and groups of documents whose fingerprints are near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import byte_values, materialize
from docmill.llm.components import connected_components

SEED = 42
BITS = 64


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of `words` words: A-Z lowered, ASCII white space between words, repeats kept."""
    parts = text.lower().split()  # bytes: only A-Z, and only \x20 and \x09 to \x0D
    if not parts:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [digest(joined, SEED)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    return [digest(joined[a:b], SEED) for a, b in zip(begin[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)] if words > 1 else [digest(p, SEED) for p in parts]


def majority_bits(hashes: list[int]) -> int:
    """The 64 bits that are set in over half of the hashes; 0 without any."""
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64)
    one = np.uint64(0x0101010101010101)
    # Each byte lane counts one bit of eight; 255 hashes are added before a lane could overflow.
    count = np.zeros((8, 8), np.int64)  # [shift, byte]
    starts = np.arange(0, len(h), 255)
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & one, starts)
        count[shift] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    on = (2 * count.T > len(h)).reshape(-1)  # little-endian: byte, then shift
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint, as a signed long, of each whole text.

    Reads only doc_id and text, so other columns cannot clash. A null or blank text has
    fingerprint 0. One pass over the rows, no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [majority_bits(shingle_hashes(t or b"", words)) for t in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


def ring(max_distance: int) -> tuple[int, list[int], list[int], list[int]]:
    """Segments of the ring: how many, their first bits, widths, and the most differences of a chain of each length."""
    m = max_distance + 1
    first = [BITS * i // m for i in range(m)]
    width = [b - a for a, b in zip(first, [*first[1:], BITS], strict=True)]
    return m, first, width, [(length * max_distance) // m for length in range(1, m + 1)]


def _segment(fp: np.ndarray, first: int, width: int) -> np.ndarray:
    return (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)


def near_pairs(left: np.ndarray, right: np.ndarray, start: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints within max_distance whose chain from segment `start` keeps its budgets.

    Chains grow one segment at a time; only pairs that keep the proportional budget of every
    length go on, and those that end within the last budget are within the full distance.
    """
    m, first, width, budget = ring(max_distance)
    i = j = np.empty(0, np.int64)
    for length in range(m):
        s = (start + length) % m
        a, b = _segment(left, first[s], width[s]), _segment(right, first[s], width[s])
        if not length:
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= budget[0])
            total = np.bitwise_count(a[i] ^ b[j]).astype(np.int64)
        else:
            total = total + np.bitwise_count(a[i] ^ b[j])
            keep = total <= budget[length]
            i, j, total = i[keep], j[keep], total[keep]
    keep = np.bitwise_count(left[i] ^ right[j]) <= max_distance
    return i[keep], j[keep]


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each linked node and the first node of its component here."""
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if np.array_equal(old, label):
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def fingerprint_links(fps: DataFrame, max_distance: int = 3, block: int = 2048) -> DataFrame:
    """Links (src, dst) whose components are those of all pairs of distinct fps within max_distance.

    Index: two fingerprints within the distance have a segment of the ring from which every
    chain keeps its proportional budget; its first segment is equal and, with more than one
    segment, the next differs in one bit at most, so one of that one's halves is equal too.
    Rows meet on (segment, its bits, half of the next segment); a key held by one fingerprint
    is dropped before the shuffle of pairs. A key with more than `block` fingerprints is
    divided by their hash into blocks and each two blocks meet in a cell of their own: no
    cell holds more than about two blocks, whatever the size of the key, and none is skipped.
    A cell emits a spanning forest of its links, not its pairs.
    """
    m, first, width, _ = ring(max_distance)
    keys = []
    bits = lambda at, n: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
    for s in range(m):
        nxt = (s + 1) % m
        low = width[nxt] // 2
        halves = [(first[nxt], low), (first[nxt] + low, width[nxt] - low)] if m > 1 else [(0, 0)]
        for h, (at, n) in enumerate(halves):
            keys.append(F.struct(F.lit(2 * s + h).alias("slot"), bits(first[s], width[s]).alias("a"), bits(at, n).alias("b")))
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.a", "k.b")
    count = rows.groupBy("slot", "a", "b").agg(F.count("*").alias("n")).where("n > 1")
    placed = (
        rows.join(count, ["slot", "a", "b"])
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("slot", "a", "b", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"), "fp")
    )
    cells = placed.repartition("slot", "a", "b", "x", "y").sortWithinPartitions("slot", "a", "b", "x", "y")

    def meet(slot: int, x: int, y: int, fp: np.ndarray, second: np.ndarray):
        left, right = (fp, fp) if x == y else (fp[~second], fp[second])
        i, j = near_pairs(left, right, slot // 2, max_distance)
        if x != y:
            j = j + len(left)
            return forest(np.concatenate([left, right]), i, j)
        keep = i < j
        return forest(fp, i[keep], j[keep])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(cols):
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:5]], axis=0)) + 1
            at = [0, *change.tolist(), len(cols[0])]
            found = [meet(int(cols[0][a]), int(cols[3][a]), int(cols[4][a]), cols[6][a:b].view(np.uint64), cols[5][a:b]) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 1]
            src, dst = (np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        for batch in batches:
            cols = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
            # The last cell may go on in the next batch.
            same = np.all([c[:] == c[-1] for c in cols[:5]], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield flush([c[:cut] for c in cols])
        if held is not None:
            yield flush(held)

    return cells.mapInArrow(work, "src long, dst long")


def group_by_links(prints: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of prints (doc_id, fp): the smallest doc_id of all fps that links (src, dst) reach."""
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    label = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = label.groupBy("root").agg(F.min("first").alias("component_id"))
    named = label.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """Groups documents whose SimHash fingerprints are linked by at most max_distance differing bits.

    docs: doc_id, text and any further columns, which are not read. Returns (doc_id long,
    fp long, component_id long), one row for each row of docs; component_id is the smallest
    doc_id reachable over links, the document's own included.

    Edge cases: a null, empty or blank text has fingerprint 0 and is linked like any other;
    fewer words than a shingle make one shingle; equal texts and repeated rows share a
    fingerprint; a null doc_id keeps its row and gets its group's smallest id, null if the
    group has none; a very long text counts as a whole, with about 100 bytes of memory a word
    while it does; an empty table gives an empty result.

    Scale: texts are read once and never shuffled. Equal fingerprints are aggregated before
    anything is compared, so a group of copies of any size is one row in the search.
    """
    prints = materialize(with_fingerprints(docs, words), "simhash")
    links = materialize(fingerprint_links(prints.select("fp"), max_distance), "simhash-links")
    return group_by_links(prints, links)
