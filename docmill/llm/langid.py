"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UNKNOWN = "und"
GRAMS = (1, 2, 3)
BITS = 15
BLOCK = 1024  # buckets in a row of counts


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray  # one for each bucket
    weights: np.ndarray  # sparse: [bucket, language], zero where the penalty won
    bias: np.ndarray
    temperature: float


def gram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a lower-cased text, with their counts.

    A run of white space counts as one space; digits count as one kind.
    """
    words = " ".join(text.lower().split())
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)
    total = np.zeros(1 << bits, np.int64)
    for n in GRAMS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        total += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text: sublinear counts times idf, of length 1."""
    at, n = gram_counts(text, int(len(idf)).bit_length() - 1)
    x = (1 + np.log(n)) * idf[at]
    norm = float(np.sqrt(x @ x))
    return at, x / norm if norm else x


def bucket_frequencies(texts: DataFrame) -> np.ndarray:
    """The number of texts in which each bucket occurs, over all rows of texts (text); and the number of texts at the end.

    Each task adds up its own counts and sends them once, in blocks that Spark then sums.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + BLOCK, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total[gram_counts(text.as_py() or "")[0]] += 1
                total[1 << BITS] += 1
        rows = total.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["block", "n"])

    found = (
        texts.select(F.col("text").cast("string"))
        .mapInArrow(work, "block long, n array<long>")
        .select("block", F.posexplode("n").alias("at", "n"))
        .where("n > 0")
        .groupBy((F.col("block") * BLOCK + F.col("at")).alias("bucket"))
        .agg(F.sum("n").alias("n"))
    )
    total = np.zeros((1 << BITS) + BLOCK, np.int64)
    for r in found.collect():  # at most a number for each bucket, whatever the input
        total[r.bucket] = r.n
    return total[: (1 << BITS) + 1]


def sample_features(labelled: DataFrame, idf: np.ndarray, per_language: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, order, buckets, weights) of about per_language different texts of each language, drawn by a hash of doc_id and text. Rows that are equal in these are one, so the draw is bounded whatever is repeated."""
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 40))
    counts = {r.lang: r["count"] for r in labelled.select("lang", drawn.alias("drawn")).distinct().groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, per_language / n) * (1 << 40)))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "", idf) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("drawn"), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())], ["lang", "drawn", "at", "x"]
            )

    rows = (
        labelled.withColumn("drawn", drawn)
        .where(F.col("drawn") < share[F.col("lang")])
        .groupBy("lang", "drawn")
        .agg(F.min("text").alias("text"))
        .mapInArrow(work, "lang string, drawn long, at binary, x binary")
        .collect()
    )
    return sorted(((r.lang, r.drawn, np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(float)) for r in rows), key=lambda r: (r[1], r[0]))


def train_ftrl(rows: list, languages: list[str], size: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, one row at a time, with an l1 and an l2 penalty on each weight.

    Every weight is the minimiser of the penalised linearised past loss, so one whose summed
    gradient stays within l1 is exactly zero. The bias carries no penalty.
    """
    k = len(languages)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    code = {lang: i for i, lang in enumerate(languages)}
    penalty1, penalty2 = np.full((size + 1, 1), l1), np.full((size + 1, 1), l2)
    penalty1[size] = penalty2[size] = 0

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * penalty1[at]) / ((beta + np.sqrt(ni)) / alpha + penalty2[at])
        return np.where(np.abs(zi) <= penalty1[at], 0.0, w)

    for _ in range(epochs):
        for lang, _, at, x in rows:
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            p = np.exp((s := x @ w) - s.max())
            p /= p.sum()
            p[code[lang]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def calibrate(rows: list, languages: list[str], weights: np.ndarray, bias: np.ndarray) -> float:
    """The temperature that makes the rows' labels most likely, by golden-section search on its logarithm."""
    if not rows:
        return 1.0
    logits = np.array([x @ weights[at] + bias for _, _, at, x in rows])
    label = np.array([languages.index(r[0]) for r in rows])

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        top = s.max(1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(s)), label]).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, labelled: Column, per_language: int = 600, epochs: int = 3) -> Model:
    """Learns from the rows of docs (doc_id, text, lang) where `labelled` holds and lang is not null.

    Document frequencies come from all those rows. The regression is fitted on about
    per_language texts of each language, its documented bound; a fifth of these is kept out
    of the fit for the temperature. Without any labelled row the model has no languages and
    everything is unknown.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequency = bucket_frequencies(rows)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    drawn = sample_features(rows, idf, per_language)
    languages = sorted({r[0] for r in drawn})
    if not languages:
        return Model([], idf, np.zeros((len(idf), 0)), np.zeros(0), 1.0)
    kept = [r for i, r in enumerate(drawn) if i % 5 == 4]
    weights, bias = train_ftrl([r for i, r in enumerate(drawn) if i % 5 != 4], languages, len(idf), epochs)
    return Model(languages, idf, weights, bias, calibrate(kept, languages, weights, bias))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_text(model: Model, text: str | None) -> tuple[str, float]:
    """The likeliest language and its calibrated probability; unknown and 0 for a text that is null or has no letter."""
    if not text or not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    at, x = features(text, model.idf)
    s = (x @ model.weights[at] + model.bias) / model.temperature
    p = np.exp(s - s.max())
    p /= p.sum()
    best = int(p.argmax())  # of equal ones the first by name
    return model.languages[best], float(p[best])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id long, lang_pred string, score double) for each row of docs, from its whole text alone.

    Reads only doc_id and text. A text that is null or has no letter is `und` with score 0;
    equal texts get equal results; a null doc_id keeps its row; a very long text is counted as
    a whole, with about 30 bytes of memory a character while it is; an empty table gives an
    empty result. The model has 32,768 buckets for each different lang and goes out with the
    job, so languages must be a bounded set, as they are; one pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain values: tasks need no copy of the package

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            found = [predict_text(model, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document never serves to learn: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def reject_unknown(docs: DataFrame, model: Model, least: float = 0.3, chance: float = 1.2) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`; all their columns stay as they are.

    With many languages a score of `chance` times that of an even spread is enough, so that
    the bound doesn't rise against a text as more languages are learnt. A model without
    languages, as of docs without any labelled row, cannot reject: every text with a letter stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))
    bound = min(least, chance / max(1, len(model.languages)))

    def known(model: Model, text: str | None) -> bool:
        if not model.languages:
            return bool(text) and has_letter(text)
        return predict_text(model, text)[1] >= bound

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([known(model, t.as_py()) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
