"""Document scores by masked pseudo-likelihood: a window network predicts every word from both sides."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize, slices, spread

SIDE = 2  # words seen on either side
SIZE = 16  # numbers that stand for a word of the context
HIDDEN = 32
CLASSES = 64
LEARNER = 4_000_000  # positions that one learner goes through before parameters are averaged
BUCKET = 1 << 16  # positions that are scored side by side, about
BLOCK = 4096
FIXED = 1 << 32  # parameters are averaged as multiples of 1 / FIXED, so that sums don't hang on their order


class Vocabulary(NamedTuple):
    """ids of the frequent words, by rank; other words share buckets by crc32 as context and are one outcome, number len(words), as target.

    first: the first outcome of each class, classes being runs of ranks, and the number of
    outcomes. spelling: log probability of a byte of a rare word after another one, a space
    standing for either end.
    """

    words: dict[bytes, int]
    buckets: int
    first: np.ndarray
    spelling: np.ndarray

    @property
    def outside(self) -> int:
        """The context id of what lies outside a text."""
        return len(self.words) + self.buckets

    @property
    def outcomes(self) -> int:
        return len(self.words) + 1

    def ids(self, text: bytes) -> tuple[np.ndarray, float]:
        """Context ids of a text's words, and the log probability of the spelling of those that are not in the vocabulary."""
        (ids,), (spelt,) = self.encoded(pa.array([text], pa.binary()), pa.array(list(self.words), pa.binary()))
        return ids, spelt

    def encoded(self, texts: pa.Array, words: pa.Array) -> tuple[list[np.ndarray], list[float]]:
        """ids of each of the texts. words: those of the vocabulary in their order."""
        flat, ends = split_words(texts)
        ids = pc.index_in(flat, words).fill_null(-1).to_numpy(zero_copy_only=False)
        rare = ids < 0
        others = flat.filter(pa.array(rare)).dictionary_encode()
        bucket = [len(words) + zlib.crc32(w) % self.buckets for w in others.dictionary.to_numpy(zero_copy_only=False)]
        out = ids.astype(np.uint16)
        out[rare] = np.array(bucket, np.uint16)[others.indices.to_numpy()]
        # The rare words of each text in a line, a space at either end of each.
        upto = np.concatenate([[0], np.cumsum(rare)])[ends].astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), others.dictionary_decode()), pa.scalar(b" ", others.type.value_type))
        spelling, spelt = self.spelling.ravel(), []
        for line, n in zip(lines.to_pylist(), np.diff(upto).tolist(), strict=True):
            each = np.frombuffer(b" " + line + b" ", np.uint8).astype(np.uint16)
            spelt.append(float(spelling.take(each[:-1] * 256 + each[1:]).sum()) if n else 0.0)
        return np.split(out, ends[1:-1]), spelt


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in their order, A-Z lowered, and where each text's begin and the last one's end. A word is a run of bytes other than ASCII white space; a null has none."""
    said = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(as_text(said)))
    flat = lists.flatten()
    flat = flat.view(pa.large_binary() if pa.types.is_large_string(flat.type) else pa.binary())
    some = pc.greater(pc.binary_length(flat), 0)  # nothing stands before white space at the beginning, and after that at the end
    begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(some), np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[begins]


def as_text(values: pa.Array) -> pa.Array:
    """Strings of the same bytes, valid UTF-8 or not: the functions for ASCII ask for strings, but read bytes."""
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return values
    return values.view(pa.large_string() if pa.types.is_large_binary(values.type) else pa.string())


def word_counts(docs: DataFrame, most_held: int = 200_000) -> DataFrame:
    """(word binary, n long) over all whole texts. A task adds up its own counts and sends them on when it holds most_held words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            each = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return each.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = split_words(part.column("text"))[0].value_counts()
                held.append(pa.table({"word": found.field(0).cast(pa.binary()), "n": found.field(1)}))
                if sum(t.num_rows for t in held) > 2 * most_held:
                    held[:] = [added()]
                    if held[0].num_rows > most_held:
                        yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    return docs.select(F.col("text").cast("string")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_counts(counts: DataFrame, known: frozenset[bytes]) -> np.ndarray:
    """How often a byte follows another in the words of counts (word, n) that are not known, each counted n times: 65,536 numbers at most on the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True) if w not in known]
            if rows:
                line = np.frombuffer(b" " + b" ".join(w for w, _ in rows) + b" ", np.uint8).astype(np.int64)
                times = np.repeat([n for _, n in rows], [len(w) + 1 for w, _ in rows])
                np.add.at(total, line[:-1] * 256 + line[1:], times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(1 << 16)
    for r in counts.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out.reshape(256, 256)


def build_vocabulary(docs: DataFrame, words: int = 8192, buckets: int = 1024, classes: int = CLASSES) -> Vocabulary:
    """The `words` most frequent words of all docs (at most 60,000, as ids have 16 bits), `buckets` for the others, and classes of about equal root mass, the others being one of their own."""
    if not 0 < words <= 60_000 or not 0 < buckets <= 5_000:
        raise ValueError("ids have 16 bits: at most 60,000 words and 5,000 buckets")
    counts = materialize(word_counts(docs), "word-counts")
    top = [(bytes(r.word), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]  # words rows
    ids = {w: i for i, (w, _) in enumerate(top)}
    total = counts.agg(F.sum("n")).first()[0] or 0
    mass = np.sqrt(np.array([n for _, n in top] + [max(total - sum(n for _, n in top), 0)]) + 0.5)
    upto = np.cumsum(mass)
    edges = np.searchsorted(upto - mass / 2, upto[-1] * np.arange(classes) / classes)
    edges = np.append(edges, len(top))  # what is not in the vocabulary is a class of its own
    followed = spelling_counts(counts, frozenset(ids)) + 0.1
    return Vocabulary(ids, buckets, np.unique(np.append(edges, len(mass))), np.log(followed / followed.sum(axis=1, keepdims=True)))


def shapes(v: Vocabulary) -> list[tuple[int, ...]]:
    """Embeddings, the hidden layer, the layer of classes, and the layer of outcomes within their class."""
    n = len(v.first) - 1
    return [(v.outside + 1, SIZE), (2 * SIDE * SIZE, HIDDEN), (HIDDEN,), (HIDDEN, n), (n,), (v.outcomes, HIDDEN), (v.outcomes,)]


def unpack(flat: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(vocabulary):
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def first_parameters(vocabulary: Vocabulary, seed: int = 3) -> np.ndarray:
    """Random embeddings and hidden layer; the output layers begin at zero, with all outcomes of a layer equally likely."""
    rng = np.random.default_rng(seed)
    scale = [0.5, 1 / math.sqrt(2 * SIDE * SIZE), 0, 0, 0, 0, 0]
    return np.concatenate([(rng.standard_normal(s) * k).ravel() for k, s in zip(scale, shapes(vocabulary), strict=True)]).astype(np.float32)


def windows(docs: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts [position, 2 * SIDE] and targets of all positions of the texts, one text after another."""
    pad = np.full(SIDE, outside, np.int32)
    line = np.concatenate([pad, *[x for d in docs for x in (d, pad)]], dtype=np.int32, casting="same_kind")
    inside = np.ones(len(line), bool)  # all but what stands between texts
    ends = SIDE + np.cumsum([len(d) + SIDE for d in docs], dtype=np.int64) - SIDE
    for o in range(SIDE):
        inside[o] = False
        inside[ends + o] = False
    at = np.flatnonzero(inside)
    context = np.empty((len(at), 2 * SIDE), np.int32)
    for k, o in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        line.take(at + o, out=context[:, k], mode="clip")
    return context, line.take(at)


def by_class(first: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of the targets by class, their classes in that order, and (class, begin, end) of each class that is there."""
    order = np.argsort(target.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    classes = np.searchsorted(first, target[order], side="right") - 1
    edges = [0, *(np.flatnonzero(np.diff(classes)) + 1).tolist(), len(order)]
    return order, classes, [(int(classes[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def reach(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A bound of each outcome's number, either sign, as hidden numbers lie between -1 and 1. weights: [outcome, HIDDEN]."""
    return np.abs(weights) @ np.ones(weights.shape[1], weights.dtype) + np.abs(bias)


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by an exponential, which numpy takes several times faster in single precision."""
    x += x
    with np.errstate(over="ignore"):  # beyond that it is 1
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def log_probabilities(parts: list[np.ndarray], first: np.ndarray, context: np.ndarray, target: np.ndarray, exps: type = np.float64) -> np.ndarray:
    """The log probability of each target outcome: that of its class, and its own within the class, both from the words around it.

    exps: the type in which exponentials are taken. Products have the type of parts. With parts
    in double precision and exps in single the result is off by about 1e-7, but does not hang
    on which positions are worked out together; with all in single it may, by about 1e-6.
    """
    e, w1, b1, w2, b2, u, d = parts
    order, classes, groups = by_class(first, target)
    x = e.take(context.take(order, axis=0), axis=0).reshape(len(order), -1) @ w1
    x += b1
    h = tanh(x.astype(exps, copy=False)).astype(x.dtype, copy=False)
    rows = np.arange(len(order))
    ones = np.ones(max(np.diff(first).max(), len(b2)), exps)

    def share(s: np.ndarray, bias: np.ndarray, most: float, at: np.ndarray) -> np.ndarray:
        s += bias
        if not most < 60:  # else no exponential is too large or too small
            s -= s.max(axis=1, keepdims=True)
        own = s.reshape(-1).take(rows[: len(s)] * s.shape[1] + at)
        each = s.astype(exps, copy=False)
        np.exp(each, out=each)
        total = each @ ones[: s.shape[1]] if s.dtype == exps else np.einsum("ij->i", each, dtype=np.float64)
        return own - np.log(total)

    each = share(h @ w2, b2, reach(w2.T, b2).max(), classes)
    most = np.maximum.reduceat(reach(u, d), first[:-1])
    for c, a, b in groups:
        low, high = first[c], first[c + 1]
        if high - low > 1:
            each[a:b] += share(h[a:b] @ u[low:high].T, d[low:high], most[c], target[order[a:b]] - low)
    out = np.empty(len(order), each.dtype)
    out[order] = each
    return out


def descend(parts: list[np.ndarray], squares: list[np.ndarray], first: np.ndarray, context: np.ndarray, target: np.ndarray, rate: float) -> float:
    """One step on a batch, each number at a rate that falls with its own past gradients. Changes parts and squares; returns the loss before."""
    e, w1, b1, w2, b2, u, d = parts
    order, classes, groups = by_class(first, target)
    context, target, n = context.take(order, axis=0), target[order], len(order)
    inner = target - first[classes]
    ones, rows = np.ones(max(n, len(d)), d.dtype), np.arange(n)
    x = e.take(context, axis=0).reshape(n, -1)
    h = x @ w1
    h += b1
    tanh(h)
    loss = 0.0

    def slopes(s: np.ndarray, bias: np.ndarray, most: float, at: np.ndarray) -> np.ndarray:
        """Turns s into the gradient of the mean loss by s + bias, but for a factor of each row, which is returned: the row's exponentials, less their sum at the target."""
        nonlocal loss
        s += bias
        if not most < 60:  # else no exponential is too large or too small
            s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        total = s @ ones[: s.shape[1]]
        at = rows[: len(s)] * s.shape[1] + at
        flat = s.reshape(-1)
        own = flat.take(at)
        loss -= float(np.log(own / total + 1e-30).sum())
        flat[at] = own - total
        total *= n
        return (1 / total)[:, None]

    def step(part: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        square += grad * grad
        grad *= rate
        grad /= np.sqrt(square)
        part -= grad

    most = np.maximum.reduceat(reach(u, d), first[:-1]).tolist()
    p = h @ w2
    scale = slopes(p, b2, reach(w2.T, b2).max(), classes)
    gh = p @ w2.T
    gh *= scale
    scaled = h * scale
    gw2, gb2 = scaled.T @ p, scale[:, 0] @ p
    for c, a, b in groups:
        low, high = int(first[c]), int(first[c + 1])
        if high - low == 1:
            continue
        own, out = h[a:b], u[low:high]
        q = own @ out.T
        scale = slopes(q, d[low:high], most[c], inner[a:b])
        back = q @ out
        back *= scale
        gh[a:b] += back
        step(out, squares[5][low:high], q.T @ (own * scale))
        step(d[low:high], squares[6][low:high], scale[:, 0] @ q)
    gh *= 1 - h * h
    dx = (gh @ w1.T).reshape(-1, SIZE)
    flat = context.astype(np.uint16).ravel()
    place = np.argsort(flat, kind="stable")
    seen = flat[place]
    heads = np.concatenate([[0], np.flatnonzero(seen[1:] != seen[:-1]) + 1])
    de = np.add.reduceat(dx.take(place, axis=0), heads, axis=0)
    step(w2, squares[3], gw2)
    step(b2, squares[4], gb2)
    step(w1, squares[1], x.T @ gh)
    step(b1, squares[2], ones[:n] @ gh)
    seen = seen[heads]
    squares[0][seen] += de * de
    e[seen] -= rate * de / np.sqrt(squares[0][seen])
    return loss / n


def outcome(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    return np.minimum(ids, len(v.words))


BLOCKS = "root long, block long, x binary"  # x: BLOCK little-endian longs


def sent_blocks(sums: np.ndarray, root: int) -> pa.RecordBatch:
    """A task's sums as rows of BLOCKS."""
    rows = [x.tobytes() for x in sums.astype("<i8").reshape(-1, BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array([root] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["root", "block", "x"])


def block_sum(rows: pa.Table) -> pa.Table:
    """One row of BLOCKS with the sum of all rows of a group."""
    total = np.zeros(BLOCK, np.int64)
    for x in rows.column("x"):
        total += np.frombuffer(x.as_buffer(), "<i8")
    return pa.table({"root": rows.column("root")[:1], "block": rows.column("block")[:1], "x": pa.array([total.tobytes()], pa.binary())})


def train(ids: DataFrame, vocabulary: Vocabulary, rounds: int = 1, parts_per_round: int = 2, batch: int = 8192, rate: float = 0.1, learner: int = LEARNER) -> np.ndarray:
    """Parameters fitted to the texts of ids (doc_id, ids binary, h1 long), by rounds of descent and averaging.

    A round goes through all positions of all texts, in parts: each text lies in one part of
    each round, and there with one learner, by hashes. A learner has about `learner` positions,
    which it goes through in the order of its texts' hashes; after each part Spark averages the
    learners' parameters in fixed-point sums, by blocks of 4,096 numbers in two levels, so that
    no task holds more than a block for the square root of the number of tasks; only the
    average, whose size is the model's, comes to the driver. Neither learners nor sums depend
    on how the table is partitioned, so the result doesn't either.
    """
    flat = first_parameters(vocabulary)
    spark = ids.sparkSession
    total = ids.agg(F.sum(F.octet_length("ids") / 2)).first()[0] or 0
    n_learners = max(1, round(total / parts_per_round / learner))
    tasks = min(n_learners, 100_000)
    roots = math.isqrt(tasks)
    placed = ids.select(F.pmod(F.xxhash64("h1", "doc_id"), F.lit(n_learners)).alias("learner"), F.xxhash64("doc_id", "h1").alias("at"), "h1", "ids")
    own_part = F.pmod(F.xxhash64(F.lit("part"), "at"), F.lit(parts_per_round))
    size = -(-(len(flat) + 1) // BLOCK) * BLOCK
    for turn in range(rounds * parts_per_round):
        sent = spark.sparkContext.broadcast((flat, tuple(vocabulary)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, v = sent.value[0], Vocabulary(*sent.value[1])
            sums, own = np.zeros(size, np.int64), None
            now, held, waiting = None, [], 0

            def learn() -> None:
                nonlocal waiting
                context, target = windows(held, v.outside)
                held.clear()
                waiting = 0
                for a in range(0, len(target), batch):
                    descend(parts, squares, v.first, context[a : a + batch], outcome(v, target[a : a + batch]), rate)

            def end() -> None:
                if held:
                    learn()
                sums[: len(start)] += np.rint(own.astype(np.float64) * FIXED).astype(np.int64)
                sums[len(start)] += 1

            for b in batches:
                for key, row in zip(b.column("learner").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    if key != now:
                        if now is not None:
                            end()
                        now, own = key, start.copy()
                        parts = unpack(own, v)
                        squares = [np.full_like(p, 1e-3) for p in parts]
                    if row:
                        held.append(np.frombuffer(row, "<u2"))
                        waiting += len(row) // 2
                        if waiting >= 32 * batch:
                            learn()
            if now is not None:
                end()
                yield sent_blocks(sums, now % roots)

        learnt = placed.where(own_part == turn % parts_per_round).repartition(tasks, "learner").sortWithinPartitions("learner", "at", "h1").select("learner", "ids").mapInArrow(work, BLOCKS)
        if roots > 1:
            learnt = learnt.groupBy("root", "block").applyInArrow(block_sum, BLOCKS)
        sums = np.zeros(size, np.int64)
        for r in learnt.groupBy("block").applyInArrow(block_sum, BLOCKS).collect():  # a number for each parameter
            sums[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.x, "<i8")
        if sums[len(flat)]:
            flat = (sums[: len(flat)] / (FIXED * sums[len(flat)])).astype(np.float32)
    return flat


def score_texts(parts: list[np.ndarray], vocabulary: Vocabulary, docs: list[np.ndarray], most: int = 16384, exps: type = np.float64) -> np.ndarray:
    """The sum over each text of the log probabilities of its words' outcomes, given the words around them."""
    context, target = windows(docs, vocabulary.outside)
    each = np.empty(len(target))
    for a in range(0, len(target), most):
        each[a : a + most] = log_probabilities(parts, vocabulary.first, context[a : a + most], outcome(vocabulary, target[a : a + most]), exps)
    ends = np.cumsum([0, *map(len, docs)])
    sums = np.concatenate([[0.0], np.cumsum(each)])
    return sums[ends[1:]] - sums[ends[:-1]]


def score_documents(docs: DataFrame, words: int = 8192, rounds: int = 1) -> DataFrame:
    """(doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double).

    docs: doc_id, text and any further columns, which are not read. A word is a run of bytes
    other than ASCII white space, A-Z lowered. The network sees two words on either side, never
    the word itself, and gives the probability of the word's class and of the word within it.
    Words outside the vocabulary are one outcome, times the probability of their spelling by a
    model of byte pairs of all such words of the corpus, so that gibberish is less likely than
    a rare word.

    Edge cases: a null, empty or blank text has no tokens, sum 0 and a null mean; equal texts
    have equal scores; a null doc_id keeps its row; a very long text is scored as a whole; an
    empty table gives an empty result. Log probabilities are worked out in single precision
    (about 1e-6 each), summed in double precision and rounded to six decimals. Which texts are
    worked out together follows from their hashes and the size of the table, not from its
    partitions, so reruns agree.

    Scale: counts cover all words of all texts; texts are read twice and kept as two bytes a
    word in the shared folder. Each round, of which one is the default, shuffles these once, to the learners; distinct texts
    are scored once, and their scores joined back by a 128-bit hash.
    """
    vocabulary = build_vocabulary(docs, words)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(tuple(vocabulary))  # plain values: tasks need no copy of the package

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*known.value)
        words = pa.array(list(v.words), pa.binary())
        for batch in batches:
            for part in slices(batch, "text"):
                own, spelt = v.encoded(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype("<u2").tobytes() for x in own], pa.binary()), pa.array(spelt, pa.float64()), part.column("h1"), part.column("h2")], ["doc_id", "ids", "spelt", "h1", "h2"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"))
    ids = materialize(rows.mapInArrow(encode, "doc_id long, ids binary, spelt double, h1 long, h2 long"), "word-ids")
    sent = spark.sparkContext.broadcast(train(ids.select("doc_id", "ids", "h1"), vocabulary, rounds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*known.value)
        parts = unpack(sent.value, v)
        held, now = [], None

        def score() -> pa.RecordBatch:
            own = [np.frombuffer(r["ids"], "<u2") for r in held]
            total = np.round(score_texts(parts, v, own, exps=np.float32) + [r["spelt"] for r in held], 6)
            out = [pa.array([r[k] for r in held], pa.int64()) for k in ("h1", "h2")]
            held.clear()
            return pa.RecordBatch.from_arrays([*out, pa.array([len(x) for x in own], pa.int64()), pa.array(total)], ["h1", "h2", "n_tokens", "pseudo_log_likelihood"])

        words = 0
        for batch in batches:
            for part in slices(batch, "ids"):
                for r in part.to_pylist():
                    if held and (r["bucket"] != now or words >= 2 * BUCKET):
                        yield score()
                        words = 0
                    now = r["bucket"]
                    held.append(r)
                    words += len(r["ids"]) // 2
        if held:
            yield score()

    total = ids.agg(F.sum(F.octet_length("ids") / 2)).first()[0] or 0
    once = ids.groupBy("h1", "h2").agg(F.first("ids").alias("ids"), F.first("spelt").alias("spelt")).withColumn("bucket", F.pmod("h1", F.lit(max(1, round(total / BUCKET)))))
    scored = spread(once, "bucket").sortWithinPartitions("bucket", "h1", "h2").select("h1", "h2", "bucket", "ids", "spelt").mapInArrow(work, "h1 long, h2 long, n_tokens long, pseudo_log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")).alias("mean_log_probability")
    return ids.select("doc_id", "h1", "h2").join(scored, ["h1", "h2"]).select("doc_id", "n_tokens", "pseudo_log_likelihood", mean)
