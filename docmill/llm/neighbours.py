"""Approximate nearest neighbours: low-dimensional stable projections, a kd-tree, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import materialize, spread

DIMENSIONS = 12  # of the projection; even, so that the chi-square law has a closed form
CERTAINTY = 0.95  # chance that a nearer vector would have been met before the search stops
BLOCK = 16  # leaves that share a task's memory; a query is sent once to a block, whatever leaves of it it visits
NEAR = 48  # leaves that are visited before the bound is drawn in for the others


def chi_square_quantile(p: float, dof: int) -> float:
    """The value below which a chi-square variable with an even number of degrees of freedom falls with chance p."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(dof // 2))
        low, high = (mid, high) if 1 - tail < p else (low, mid)
    return high


class Tree(NamedTuple):
    """A kd-tree over projected vectors; leaves carry numbers and boxes.

    Node i splits axis[i] at cut[i]; its children are left[i] and right[i], of which a negative
    one, -1 - n, is leaf n. A tree of one leaf has no node.
    """

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray  # [leaf, axis]: the box in which the leaf's points lie
    high: np.ndarray

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if len(self.axis) else np.full(len(points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, self.axis[node]] < self.cut[node], self.left[node], self.right[node])
        return -1 - at

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to the box of each leaf."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


def build_tree(points: np.ndarray, leaves: int) -> Tree:
    """Halves the largest leaf at the median of its widest axis until there are enough. Boxes are the cells, open at the outside."""
    dims = points.shape[1] if points.ndim == 2 else 1
    axis, cut, left, right = [], [], [], []
    cells = [(points, np.full(dims, -np.inf), np.full(dims, np.inf), None)]
    done = []
    import heapq

    heap = [(-len(points), 0)]
    while heap and len(heap) + len(done) < leaves:
        _, i = heapq.heappop(heap)
        own, low, high, parent = cells[i]
        wide = int(np.ptp(own, axis=0).argmax()) if len(own) > 1 else 0
        at = float(np.median(own[:, wide])) if len(own) > 1 else 0.0
        side = own[:, wide] < at if len(own) > 1 else np.zeros(len(own), bool)
        if len(own) < 2 or side.all() or not side.any():
            done.append(i)
            continue
        node = len(axis)
        axis.append(wide)
        cut.append(at)
        left.append(0)
        right.append(0)
        if parent is not None:
            (left if parent[1] else right)[parent[0]] = node
        for is_left, part in ((True, own[side]), (False, own[~side])):
            lo, hi = low.copy(), high.copy()
            (hi if is_left else lo)[wide] = at
            cells.append((part, lo, hi, (node, is_left)))
            heapq.heappush(heap, (-len(part), len(cells) - 1))
    final = done + [i for _, i in heap]
    for n, i in enumerate(final):
        parent = cells[i][3]
        if parent is not None:
            (left if parent[1] else right)[parent[0]] = -1 - n
    return Tree(np.array(axis, int), np.array(cut), np.array(left, int), np.array(right, int), np.array([cells[i][1] for i in final]), np.array([cells[i][2] for i in final]))


class Space(NamedTuple):
    """Turns the largest inner product into the smallest distance, and projects.

    A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest length; a query q becomes
    (q M / |q|, 0). Their squared distance is 2 M^2 - 2 M (q x) / |q|, so the order is that of
    the inner product.
    """

    largest: float
    projection: np.ndarray  # [dimensions + 1, DIMENSIONS], standard normal

    def vectors(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.largest**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest]) @ self.projection

    def queries(self, q: np.ndarray) -> np.ndarray:
        length = np.sqrt((q * q).sum(axis=1, keepdims=True))
        return (q * (self.largest / length)) @ self.projection[:-1]

    def squared(self, q: np.ndarray, products: np.ndarray) -> np.ndarray:
        return np.maximum(0, 2 * self.largest * (self.largest - products / math.sqrt(float(q @ q))))


class Leaf(NamedTuple):
    """The vectors of a leaf in the cells of a small kd-tree of their own, cell after cell, with the cells' tight boxes."""

    vectors: np.ndarray
    projected: np.ndarray
    ids: list[list[int]]
    count: np.ndarray  # vec_ids that each vector stands for
    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray


def make_leaf(space: Space, vectors: np.ndarray, ids: list[list[int]], cell: int = 128) -> Leaf:
    projected = space.vectors(vectors)
    at = build_tree(projected, max(1, len(vectors) // cell)).leaf(projected)
    order = np.argsort(at, kind="stable")
    at, projected = at[order], projected[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
    low = np.minimum.reduceat(projected, edges[:-1]) if len(at) else projected
    high = np.maximum.reduceat(projected, edges[:-1]) if len(at) else projected
    return Leaf(vectors[order], projected, [ids[i] for i in order], np.array([len(ids[i]) for i in order], int), edges, low, high)


def search(space: Space, q: np.ndarray, leaf: Leaf, k: int, bound: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the inner products and places of a leaf's best vectors, best first (-inf and -1 where there are fewer), and the new bounds.

    Every query goes through the cells in ascending projected distance. Of a cell it verifies
    the vectors whose projected distance is within reach, and it stops when the test holds: the
    next cell is so far that a vector nearer than the k-th best would have come before with the
    given certainty. bound: squared distance of the k-th best known from elsewhere.
    """
    p, reach, bound = space.queries(q), limit * bound, bound.copy()
    length = np.sqrt((q * q).sum(axis=1))
    products, places = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    cells = len(leaf.edges) - 1
    if not cells:
        return products, places, bound
    gap = np.maximum(0, np.maximum(leaf.low[None] - p[:, None], p[:, None] - leaf.high[None]))
    far = np.einsum("qcd,qcd->qc", gap, gap)
    order = np.argsort(far, axis=1)
    own = (p * p).sum(axis=1)
    for step in range(cells):
        cell = order[:, step]
        going = np.flatnonzero(far[np.arange(len(q)), cell] <= reach)
        if not len(going):
            break
        for c in np.unique(cell[going]):
            rows = going[cell[going] == c]
            a, b = leaf.edges[c], leaf.edges[c + 1]
            there = leaf.projected[a:b]
            near = own[rows, None] + (there * there).sum(axis=1) - 2 * p[rows] @ there.T
            found = np.where(near <= reach[rows, None] * (1 + 1e-9), q[rows] @ leaf.vectors[a:b].T, -np.inf)
            both = np.concatenate([products[rows], found], axis=1)
            where = np.concatenate([places[rows], np.broadcast_to(np.arange(a, b), found.shape)], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :k]
            products[rows] = np.take_along_axis(both, top, 1)
            places[rows] = np.where(np.isfinite(products[rows]), np.take_along_axis(where, top, 1), -1)
            held = np.cumsum(np.where(places[rows] >= 0, leaf.count[places[rows]], 0), axis=1)
            enough = held[:, -1] >= k
            last = products[rows, (held >= k).argmax(axis=1)]
            known = np.maximum(0, 2 * space.largest * (space.largest - np.where(enough, last, 0) / length[rows]))
            bound[rows] = np.where(enough, np.minimum(bound[rows], known), bound[rows])
            reach[rows] = limit * bound[rows]
    return products, places, bound


def usable(embedding: Column, dimensions: int) -> Column:
    """Whether a vector takes part: not null, of the table's dimension, finite throughout and not zero."""
    wrong = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dimensions) & ~wrong & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column | str, k: int = 20, sample: int = 20_000, leaf_rows: int = 1024, most_leaves: int = 4096, big_leaf: int = 1 << 18, seed: int = 11) -> DataFrame:
    """The k nearest found of each query, by inner product: (query_id long, rank int, vec_id long, score double).

    vectors: vec_id, embedding (an array of numbers) and any further columns, which are not
    read. Queries are the rows where is_query (a column or SQL) holds; candidates are all rows but the query's
    own. Scores are exact inner products in double precision; ties go to the smaller vec_id.

    Edge cases: vectors that are null, zero, of another length than the commonest (of equally
    common ones the longest), or that hold null or non-finite components take no part; nor do
    rows without vec_id; with fewer candidates than k all are found; repeated rows are
    candidates each; an empty table gives an empty result.

    Method: vectors and queries are mapped so that the nearest has the largest inner product,
    and projected by normal (2-stable) weights. A kd-tree built on a sample of at most about
    `sample` projected vectors deals all vectors out to leaves of about leaf_rows (up to
    most_leaves leaves; beyond that leaves grow to big_leaf and then their number grows again).
    A query first searches its own leaf, which gives a bound, then the nearest 48 leaves whose
    boxes fail the chi-square test at that bound, which draws it in, then all others that still
    fail it; it stops in each as soon as the test holds.

    Scale: equal vectors are searched once: of each the k + 1 smallest vec_ids are all that can
    be in a result, and equal queries share one search. So a vector that fills a third of the
    table is one row. A task holds a block of 16 leaves; queries stream past it, and each is
    sent once to a block, with the list of the leaves that it visits there.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), (F.expr(is_query) if isinstance(is_query, str) else is_query).alias("q"))
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    sizes = plain.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    valid = plain.where(usable(F.col("v"), sizes.d) & F.col("vec_id").isNotNull())
    few = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    unique = materialize(
        valid.withColumn("n", few).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors"
    )
    asked = valid.where(F.coalesce("q", F.lit(False))).select("vec_id", "v")
    lookups = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("key")), "queries")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, largest = unique.agg(F.count("*"), F.max(length)).first()
    if not n:
        return spark.createDataFrame([], schema)
    space = Space(largest, np.random.default_rng(seed).standard_normal((sizes.d + 1, DIMENSIONS)))
    leaves = max(32, math.ceil(n / leaf_rows))
    if leaves > most_leaves:
        leaves = max(most_leaves, math.ceil(n / big_leaf))
    drawn = unique.where(F.pmod(F.xxhash64(F.element_at("ids", 1), F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    points = np.array([r.v for r in drawn.select("v").collect()]).reshape(-1, sizes.d)
    tree = build_tree(space.vectors(points), min(leaves, max(1, len(points))))
    limit = chi_square_quantile(CERTAINTY, DIMENSIONS)
    sent = spark.sparkContext.broadcast((tuple(space), tuple(tree)))  # plain values: tasks need no copy of the package
    row = "block long, kind int, leaf long, leaves array<long>, key long, v array<double>, ids array<long>, bound double"

    def _rows(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors get their leaf, queries that they visit first."""
        space, tree = Space(*sent.value[0]), Tree(*sent.value[1])
        for b in batches:
            if b.num_rows:
                v, kind = _rows(b.column("v")), b.column("kind").to_numpy()
                at = tree.leaf(np.where(kind[:, None] == 0, space.vectors(v), space.queries(v)))
                leaves = pa.array([[x] if k else None for x, k in zip(at.tolist(), kind.tolist(), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), b.column("kind"), pa.array(at), leaves, *b.columns[4:]], schema=b.schema)

    def fan_out(first: int, last: int | None):
        """Of each query a row for each block of leaves that the test at its bound doesn't rule out, nearest first, those between first and last; its own leaf is done."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, tree = Space(*sent.value[0]), Tree(*sent.value[1])
            for b in batches:
                if not b.num_rows:
                    continue
                projected = space.queries(_rows(b.column("v")))
                home, bound = tree.leaf(projected), b.column("bound").to_numpy()
                for i in range(b.num_rows):
                    far = tree.distances(projected[i])
                    order = np.argsort(far, kind="stable")
                    to = order[order != home[i]][first:last]
                    to = to[far[to] <= limit * bound[i]]
                    blocks, where = np.unique(to // BLOCK, return_inverse=True)
                    leaves = [to[where == j].tolist() for j in range(len(blocks))]
                    copies = b.take(pa.array(np.full(len(blocks), i)))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), copies.column("kind"), copies.column("leaf"), pa.array(leaves, pa.list_(pa.int64())), *copies.columns[4:]], schema=b.schema)

        return work

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, vectors before queries; of each query the best vec_ids of the leaves that it visits here, one after another, and the bound that follows."""
        space = Space(*sent.value[0])
        now, held, ready = None, {}, {}

        def made(leaf: int) -> Leaf:
            if leaf not in ready:
                parts = held.pop(leaf, [])
                vectors = np.concatenate([p[0] for p in parts]) if parts else np.empty((0, sizes.d))
                ready[leaf] = make_leaf(space, vectors, [i for p in parts for i in p[1]])
            return ready[leaf]

        for b in batches:
            block, kind, leaf = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind", "leaf"))
            apart = (np.diff(block) != 0) | (np.diff(kind) != 0) | ((kind[1:] == 0) & (leaf[1:] != leaf[:-1]))
            edges = [0, *(np.flatnonzero(apart) + 1).tolist(), b.num_rows]
            for a, z in ((x, min(x + 512, y)) for u, y in zip(edges[:-1], edges[1:], strict=True) for x in range(u, y, 512)):
                part = b.slice(a, z - a)
                if block[a] != now:
                    now, held, ready = block[a], {}, {}
                if kind[a] == 0:
                    held.setdefault(int(leaf[a]), []).append((_rows(part.column("v")), part.column("ids").to_pylist()))
                    continue
                q, bound, turns = _rows(part.column("v")), part.column("bound").to_numpy().copy(), part.column("leaves").to_pylist()
                out: list[list[tuple[float, int]]] = [[] for _ in turns]
                for x in sorted({x for t in turns for x in t}):
                    rows, there = np.array([i for i, t in enumerate(turns) if x in t]), made(x)
                    if len(rows):
                        products, at, tight = search(space, q[rows], there, k + 1, bound[rows], limit)
                        bound[rows] = tight
                        for n, i in enumerate(rows.tolist()):
                            good = at[n][at[n] >= 0]
                            # What is farther than the bound is beaten by k vec_ids elsewhere.
                            good = good[space.squared(q[i], products[n][: len(good)]) <= bound[i] * (1 + 1e-9)]
                            scores = (there.vectors[good] * q[i]).sum(axis=1).tolist()
                            out[i] += [(-s, v) for s, j in zip(scores, good, strict=True) for v in there.ids[j]]
                best = [sorted(o)[: k + 1] for o in out]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("v"), pa.array(bound, pa.float64()), pa.array([[v for _, v in o] for o in best], pa.list_(pa.int64())), pa.array([[-s for s, _ in o] for o in best], pa.list_(pa.float64()))],
                    ["key", "v", "bound", "ids", "scores"],
                )

    found_schema = "key long, v array<double>, bound double, ids array<long>, scores array<double>"
    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    queries = lambda df: df.select(zero.alias("block"), F.lit(1).alias("kind"), zero.alias("leaf"), none("array<long>").alias("leaves"), "key", "v", none("array<long>").alias("ids"), "bound")
    base = unique.select(zero.alias("block"), F.lit(0).alias("kind"), zero.alias("leaf"), none("array<long>").alias("leaves"), none("long").alias("key"), "v", "ids", none("double").alias("bound"))
    placed = materialize(base.mapInArrow(place, row), "vectors-placed")
    by_block = lambda asking: spread(placed.unionByName(asking), "block").sortWithinPartitions("block", "kind", "leaf").mapInArrow(visit, found_schema)
    home = materialize(by_block(queries(lookups.withColumn("bound", F.lit(float("inf")))).mapInArrow(place, row)), "neighbours-home")
    near = materialize(by_block(queries(home).mapInArrow(fan_out(0, NEAR), row)), "neighbours-near")
    # The bound of a query after these: that of its k + 1 best so far, itself included.
    so_far = home.unionByName(near).groupBy("key").agg(F.min("bound").alias("bound"), F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k + 1).alias("best"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    known = F.greatest(F.lit(0.0), 2 * largest * (largest - F.element_at("best", -1) / size)) * (1 + 1e-9)
    drawn_in = lookups.join(so_far, "key").withColumn("bound", F.when(F.size("best") > k, F.least("bound", known)).otherwise(F.col("bound")))
    rest = by_block(queries(drawn_in).mapInArrow(fan_out(NEAR, None), row))
    found = home.unionByName(near).unionByName(rest).select("key", "ids", "scores")
    hits = found.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("key", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score"))
    top = hits.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))
    answers = lookups.join(lists, "key").select("v", "hits")
    mine = asked.join(answers, "v").select(F.col("vec_id").alias("query_id"), F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")).alias("hits"))
    return mine.select("query_id", F.posexplode(F.slice("hits", 1, k)).alias("at", "h")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))
