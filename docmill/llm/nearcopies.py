"""Near copies: documents that share most of their five-word shingles, found by SimHash groups and MinHash bands and checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import byte_values, materialize
from docmill.llm.components import connected_components
from docmill.llm.simhash import SEED, fingerprint_links, group_by_links, majority_bits, shingle_hashes

KEY = ["k1", "k2"]

BANDS = 24
ROWS = 5  # minima a band
FACTORS = np.random.default_rng(7).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_id(hashes: np.ndarray) -> int:
    """One number for equal sets, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def bands(hashes: np.ndarray, most: int = 2048) -> list[int]:
    """A number for each band of minima; none of an empty set."""
    if not len(hashes):
        return []
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), most):
        low = np.minimum(low, (FACTORS[:, None] * hashes[None, a : a + most]).min(axis=1))
    return [int(np.uint64(xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k)).view(np.int64)) for k in range(BANDS)]


def row_keys(columns: list[Column]) -> list[Column]:
    """128 bits that stand for a row: rows that differ in any column have different ones, nulls included."""
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in columns])
    return [F.xxhash64(F.lit(i), nulls, *columns).alias(k) for i, k in enumerate(KEY)]


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(k1, k2, row): each row of docs as a struct of its columns, under its key."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*row_keys(columns), F.struct(*columns).alias("row"))


def with_sets(rows: DataFrame, words: int) -> DataFrame:
    """(k1, k2, doc_id, fp, sim, size, bands) of rows (k1, k2, row): of each text its set's id, its SimHash fingerprint, its set's size and its bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_hashes = [shingle_hashes(t or b"", words) for t in byte_values(batch.column("text"))]
            sim = np.array([majority_bits(h) for h in all_hashes], np.uint64).view(np.int64)
            sets = [np.unique(np.array(h, np.uint64)) for h in all_hashes]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*KEY, "doc_id")), pa.array([set_id(s) for s in sets], pa.int64()), pa.array(sim), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))],
                [*KEY, "doc_id", "fp", "sim", "size", "bands"],
            )

    texts = rows.select(*KEY, F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return texts.mapInArrow(work, "k1 long, k2 long, doc_id long, fp long, sim long, size long, bands array<long>")


def set_hashes(texts: DataFrame, words: int) -> DataFrame:
    """(fp, hashes): the id and the shingle hashes of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t or b"", words), np.uint64)) for t in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])

    return texts.mapInArrow(work, "fp long, hashes binary")


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is `similarity` or more.

    Breadth first: a set that has been reached meets only those not reached yet, so a group
    of near copies costs about its size and not its square.
    """
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    code = [flat[b - n : b] for b, n in zip(ends, size, strict=True)]
    mark = np.zeros(int(flat.max()) + 1, bool)
    left = np.argsort(size, kind="stable")  # sets that nothing has reached, by size
    out: list[tuple[int, int]] = []
    reached: list[int] = []
    while len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
        at = reached.pop()
        near = left[np.searchsorted(size[left], similarity * size[at] - 1e-9) : np.searchsorted(size[left], size[at] / similarity + 1e-9, "right")]
        if not len(near):
            continue
        mark[code[at]] = True
        both = np.add.reduceat(mark[np.concatenate([code[k] for k in near])], np.cumsum([0, *size[near][:-1]]), dtype=np.int64)
        mark[code[at]] = False
        hit = near[both >= similarity * (size[near] + size[at] - both) - 1e-9]
        out += [(at, int(k)) for k in hit]
        reached += hit.tolist()
        left = left[~np.isin(left, hit)]
    return out


def similar_links(prints: DataFrame, rows: DataFrame, words: int, similarity: float, max_distance: int = 3, block: int = 2048, block_size: int = 1 << 20) -> DataFrame:
    """Links (src, dst) of distinct sets that are candidates and whose exact similarity is enough; prints: as of with_sets, rows: as of keyed_rows.

    Sets are candidates where they share a band or a group of SimHash fingerprints, which
    pigeonring filtering finds; the group is one band more. The rows of a band meet; bands with the same members meet once. A band of more than
    `block` sets, or more than block_size shingles, is divided by hash into blocks that meet
    pairwise; none is skipped. A cell emits a spanning forest of its links, not its pairs.
    """
    once = prints.groupBy("fp").agg(F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    groups = connected_components(materialize(fingerprint_links(prints.select(F.col("sim").alias("fp")), max_distance), "near-fingerprints"))
    some = once.where("size > 0").select("fp", "size", "sim")
    by_group = some.join(groups.withColumnRenamed("node", "sim"), "sim").select("fp", "size", F.lit(BANDS).alias("slot"), F.col("component").alias("key"))
    alike = some.groupBy("sim").agg(F.count("*").alias("n")).where("n > 1").select("sim")  # different sets with one fingerprint
    by_print = some.join(alike, "sim").select("fp", "size", F.lit(BANDS + 1).alias("slot"), F.col("sim").alias("key"))
    keys = materialize(once.select("fp", "size", F.posexplode("bands").alias("slot", "key")).unionByName(by_group).unionByName(by_print), "near-bands")
    h = F.xxhash64("fp")
    count = keys.groupBy("slot", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(h).alias("members"), F.sum(F.shiftright(h, 8)).alias("more")
    ).where("n > 1")
    cells = count.groupBy("n", "members", "more").agg(F.min(F.struct("slot", "key", "total")).alias("k")).select(
        "k.slot", "k.key", F.ceil(F.greatest(F.col("n") / block, F.col("k.total") / block_size)).cast("int").alias("blocks")
    )
    placed = (
        keys.join(cells, ["slot", "key"])
        .withColumn("mine", F.pmod(h, "blocks").cast("int"))
        .withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("mine")))))
        .select("slot", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp")
    )
    placed = materialize(placed, "near-cells")
    first = prints.groupBy("fp").agg(F.min(F.struct(*KEY)).alias("k"))  # one row of each set
    asked = first.join(placed.select("fp").distinct(), "fp").select("k.*")
    sets = materialize(set_hashes(rows.select(*KEY, F.col("row.text").cast("string").alias("text")).join(asked, KEY, "left_semi").select("text"), words).dropDuplicates(["fp"]), "near-sets")
    met = placed.join(sets, "fp").select("slot", "key", "x", "y", "fp", "hashes").repartition("slot", "key", "x", "y").sortWithinPartitions("slot", "key", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fps, held = None, [], []

        def flush() -> pa.RecordBatch:
            found = similar_forest(held, similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([fps[a] for a, _ in found], pa.int64()), pa.array([fps[b] for _, b in found], pa.int64())], ["src", "dst"])

        for batch in batches:
            *named, fp, hashes = (c.to_pylist() for c in batch.columns)
            for now, f, x in zip(zip(*named, strict=True), fp, hashes, strict=True):
                if now != cell:
                    if cell is not None:
                        yield flush()
                    cell, fps, held = now, [], []
                fps.append(f)
                held.append(np.frombuffer(x, np.uint64))
        if cell is not None:
            yield flush()

    return met.mapInArrow(work, "src long, dst long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups documents that are linked by a Jaccard similarity of their word shingles of `similarity` or more.

    docs: doc_id, text and any further columns. Returns (doc_id long, fp long, component_id
    long), one row for each row of docs, as simhash.near_duplicates does; fp stands for the
    set of shingles. Candidates are the groups of SimHash fingerprints of the same shingles,
    and what shares a MinHash band: texts at a similarity of 0.8 differ in about 10 of 64
    bits, where no SimHash search is selective any more. Every link is checked on the whole
    sets, those within a SimHash group too. Of pairs at a similarity of 0.8, 24 bands of 5
    minima leave (1 - 0.8^5)^24 = 7 in 100,000 unmet, fewer above it.

    Edge cases: null, empty and blank texts have the empty set and form one group; fewer words
    than a shingle make one shingle; rows without a doc_id are grouped like others, and a group
    of such rows alone has a null component_id; very long texts count as a whole; an empty
    table gives an empty result.

    Scale: equal sets are one row in the search. Only the texts of sets that are candidates
    are read again, and only their hashes are shuffled.
    """
    rows = keyed_rows(docs)
    prints = materialize(with_sets(rows, words), "near-prints")
    return group_by_links(prints.select("doc_id", "fp"), materialize(similar_links(prints, rows, words, similarity), "near-links"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies (see near_copies), with all its columns.

    The smallest doc_id stays, one without doc_id only where the group has none; of rows that
    share it, one by a hash of the row. So rows with one doc_id and different texts are told
    apart, each stays for its own group, and of rows that are equal in every column one stays.

    Rows are joined to the chosen ones by their 128-bit key, so whole texts are shuffled once.
    """
    rows = keyed_rows(docs)
    prints = materialize(with_sets(rows, words), "near-prints")
    links = materialize(similar_links(prints, rows, words, similarity), "near-links")
    firsts = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("s"))
    roots = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    chosen = firsts.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("s").alias("s")).select("s.k1", "s.k2")
    kept = rows.join(chosen, KEY, "left_semi").groupBy(*KEY).agg(F.first("row").alias("row"))  # equal rows are one
    return kept.select("row.*")
