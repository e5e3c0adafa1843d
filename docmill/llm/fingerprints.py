"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.sharding import NO_ID, range_number

WORDS = 5
BINS = 512  # a power of two
BITS = 8  # low-order bits kept of each bin's minimum
EMPTY = "empty"

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lowered, and the number of words in each text.

    Words are runs of bytes other than \\x20 and \\x09 to \\x0D. A word's hash is that of its
    bytes alone: a polynomial taken from running sums over all texts at once.
    """
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    inside = np.ones(len(data) + 2, bool)
    inside[[0, -1]] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    power = np.cumprod(np.full(len(data), _P))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.cumprod(np.full(len(data) + 1, _P_INVERSE))
    hashes = mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(begin, limits)
    return hashes, np.diff(np.concatenate([[0], upto]))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of the texts, and the index of each one's text. Fewer words make one shingle; none make none."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(words)
    if n >= WORDS:
        full = owner[WORDS - 1 :] == owner[: n - WORDS + 1]
        h = sum((words[i : n - WORDS + 1 + i] * _WORD[i] for i in range(WORDS)), np.uint64(0))[full]
        who = owner[: n - WORDS + 1][full]
    else:
        h, who = np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    with np.errstate(over="ignore"):  # sums are modulo 2^64
        rest = [sum((words[first[d] + i] * _WORD[i] for i in range(counts[d])), np.uint64(counts[d])) for d in few]
    return mix(np.concatenate([h, np.array(rest, np.uint64)])), np.concatenate([who, few])


def _candidates(attempt: int) -> np.ndarray:
    """For each bin, the bin that it copies from in its attempt-th try: the same for all texts."""
    return (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64((attempt + 1) * int(_P) % (1 << 64))) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


_TRIES = np.stack([_candidates(a) for a in range(32)], axis=1)


def densify(minima: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Fills each empty bin from a bin that holds something, drawn by a hash of the empty bin and the number of the try."""
    empty = np.flatnonzero(~there)
    if not len(empty):
        return minima
    out = minima.copy()
    full = np.flatnonzero(there)
    if len(full) == 1:
        out[empty] = minima[full[0]]
        return out
    attempt = 0
    while len(empty):
        tries = _TRIES if not attempt else np.stack([_candidates(attempt + a) for a in range(32)], axis=1)
        hit = there[tries[empty]]
        found = hit.any(axis=1)
        out[empty[found]] = minima[tries[empty[found], hit[found].argmax(axis=1)]]
        empty = empty[~found]
        attempt += 32
    return out


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The low-order bits of the bins of each text, and whether it has any shingle."""
    h, who = shingle_hashes(texts)
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    none = np.uint64((1 << 64) - 1)
    minima = np.full(len(texts) * BINS, none)
    np.minimum.at(minima, who * BINS + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    minima = minima.reshape(-1, BINS)
    any_word = (minima != none).any(axis=1)
    low = np.zeros((len(texts), BINS), np.uint8)
    for d in np.flatnonzero(any_word):
        low[d] = (densify(minima[d], minima[d] != none) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low, any_word


def likeness(a: np.ndarray, a_any: np.ndarray, b: np.ndarray, b_any: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles: the share of equal bins less what equal bits by chance account for.

    Two texts without words are alike (1); one with and one without are not (0).
    """
    chance = 2.0**-BITS
    same = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_any & b_any, same, (a_any == b_any).astype(float))


def pack(low: np.ndarray, any_word: np.ndarray) -> list[str]:
    """Fingerprints as text: base64 of the packed bits."""
    bits = low if BITS == 8 else np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(low), -1), axis=1)
    return [base64.b64encode(b.tobytes()).decode() if w else EMPTY for b, w in zip(bits, any_word, strict=True)]


def with_next(docs: DataFrame, rows_per_part: int = 500, parts_per_task: int = 8, most_parts: int = 32_768) -> DataFrame:
    """(part, tail, key, id, doc_id, text, n): parts of consecutive documents, each followed by the first row of the next part (tail). n: how many equal rows a row stands for.

    Documents are ordered by doc_id, then by a hash of the text. Boundaries are quantiles of
    doc_id, and even steps of the hash within a doc_id that many rows share, so a part has about
    rows_per_part rows, more only beyond most_parts parts. Many equal rows are counted before
    the shuffle and sent once. Several parts share a task, which evens out its size. The driver
    sees a few numbers for each part. Texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("id", F.xxhash64("text"))
    spark = docs.sparkSession
    ids = rows.select("key")
    n = ids.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, min(most_parts, math.ceil(n / rows_per_part)))
    share = max(rows_per_part, math.ceil(n / parts))
    tasks = max(tasks, math.ceil(parts / parts_per_task))
    cuts = ids.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts + 10_000).alias("q")).first().q or []
    hot = ids.groupBy("key").count().where(F.col("count") > 2 * share).collect()  # at most half as many as parts
    inside = {(r.key, -(1 << 63) + (i << 64) // k) for r in hot for k in [math.ceil(r["count"] / share)] for i in range(1, k)}
    part = range_number(sorted({(c, -(1 << 63)) for c in cuts} | inside))
    lowest = sorted((r.part, tuple(r.low)) for r in rows.select("key", "id").withColumn("part", part).groupBy("part").agg(F.min(F.struct("key", "id")).alias("low")).collect())
    before = {low: lowest[i - 1][0] for i, (_, low) in enumerate(lowest)}  # of the first part: the last
    columns = ["part", "tail", "key", "id", "doc_id", "text", "n"]
    own = rows.select(part.cast("int").alias("part"), F.lit(False).alias("tail"), "key", "id", "doc_id", "text", F.lit(1).cast("long").alias("n"))
    if hot:
        equal = [tuple(r) for r in rows.where(F.col("key").isin([r.key for r in hot])).groupBy("key", "id").count().where(F.col("count") > share).select("key", "id").collect()]  # fewer than parts
        if equal:
            many = F.broadcast(spark.createDataFrame(equal, "key long, id long"))
            counted = own.join(many, ["key", "id"], "left_semi").groupBy("part", "tail", "key", "id", "doc_id", "text").agg(F.count("*").alias("n"))
            own = own.join(many, ["key", "id"], "left_anti").select(*columns).unionByName(counted)
    if not before:
        return own
    firsts = spark.createDataFrame([(*k, v) for k, v in before.items()], "key long, id long, part int")
    tails = rows.join(F.broadcast(firsts), ["key", "id"]).groupBy("part", "key", "id", "doc_id").agg(F.min("text").alias("text")).withColumn("tail", F.lit(True)).withColumn("n", F.lit(1).cast("long"))
    return own.select(*columns).unionByName(tails.select(*columns)).repartition(tasks, "part").sortWithinPartitions("part", "tail", "key", "id", "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text of docs (doc_id, text) and of its edited text.

    The edited text is the text with its last floor(n/2) code points replaced by as many (or
    all) of the next document's first ones, in ascending order of doc_id; after the last comes
    the first. Returns doc_id long, n_chars long, edited_sha256 string, fingerprint string,
    edited_fingerprint string, near_edited double, near_next double.

    Edge cases: a null text is empty; null doc_ids come first; rows with one doc_id are ordered
    by a hash of the text, then by text, and equal rows follow each other; a single document is its own next; texts without words have the fingerprint
    `empty`; equal texts have equal fingerprints; an empty table gives an empty result.

    A task holds about a megabyte of texts at a time, or one text of any length and its next,
    and needs no more than one row beyond its part. Many equal rows are worked out as one.
    """
    import hashlib

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(run: list[tuple]) -> pa.RecordBatch:
            """run: (doc_id, text, whether its next is the row after it, for how many rows); the last row only serves as next."""
            texts = [r[1] for r in run]
            plain, has = fingerprints([t.encode() for t in texts])
            at = [i for i, r in enumerate(run) if r[2]]
            edited = []
            for i in at:
                k = len(texts[i]) // 2
                edited.append((texts[i][: len(texts[i]) - k] + texts[i + 1][:k]).encode())
            low, any_word = fingerprints(edited)
            here, nxt = np.array(at, int), np.array(at, int) + 1
            packed = pack(plain, has)
            cols = [
                pa.array([run[i][0] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([packed[i] for i in at], pa.string()),
                pa.array(pack(low, any_word), pa.string()),
                pa.array(likeness(plain[here], has[here], low, any_word), pa.float64()),
                pa.array(likeness(plain[here], has[here], plain[nxt], has[nxt]), pa.float64()),
                pa.array([run[i][3] for i in at], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"])

        run: list[tuple] = []
        size, now, closed = 0, None, False
        for batch in batches:
            for part, tail, doc_id, text, n in zip(batch.column("part").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("n").to_pylist(), strict=True):
                if part != now:
                    now, closed = part, False
                elif closed:
                    continue
                text = text.as_py()
                closed = tail
                if n > 1:  # all but the last are followed by one that is equal
                    run.append((doc_id, text, True, n - 1))
                run.append((doc_id, text, not tail, 1))
                size += len(text) + 64
                if size > 1 << 20 or len(run) > 1000:
                    if len(run) > 1:
                        yield out([*run[:-1], (*run[-1][:2], False, 1)])
                    run, size = ([] if tail else run[-1:]), 0
        if len(run) > 1:
            yield out(run)

    ordered = with_next(docs).select("part", "tail", "doc_id", "text", "n")
    found = ordered.mapInArrow(work, schema)
    # Equal rows have equal results: they are dealt out again in runs.
    runs = found.select("*", F.explode(F.expr("sequence(1L, copies, 4096L)")).alias("run"))
    each = runs.select("*", F.explode(F.expr("sequence(run, least(copies, run + 4095L))")).alias("_copy"))
    return each.drop("copies", "run", "_copy")
