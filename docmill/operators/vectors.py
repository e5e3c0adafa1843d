"""An index of vectors by coarse cells: K-1 and K-2 without scoring every vector for every query."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from docmill.operators import scan
from docmill.operators.search import dot, finite, rounded, top, unit, usable, vector_topk
from docmill.sources.shared import new_folder, stored

#: Vectors that centres are fitted on, at most; vectors of one array; queries of one array.
SAMPLE, ARRAY, TOGETHER = 100_000, 1024, 256


class VectorIndex(NamedTuple):
    """dims, cells, centres (cell, e), arrays (cell, vs: up to about 1,024 of chunk_uuid and e) and rows (chunk_uuid, embedding)."""

    dims: int
    cells: int
    centres: DataFrame
    arrays: DataFrame
    rows: DataFrame


def _numbers(e: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in e])


def nearest_cells(rows: DataFrame, centres: list[tuple[int, list[float]]], n: int) -> Column:
    """The n cells whose centres are nearest to e, the nearest first: centres are a constant of the plan, d numbers for each cell."""
    each = F.array(*[F.struct((-dot(F.col("e"), _numbers(c))).alias("s"), F.lit(i).alias("cell")) for i, c in centres])
    return F.transform(F.slice(F.array_sort(each), 1, n), lambda x: x["cell"])


def build_index(vectors: DataFrame, cells: int | None = None, seed: int = 7, path: str | None = None) -> VectorIndex:
    """vectors: chunk_uuid, embedding and other columns. Unit vectors in cells around centres that k-means finds.

    Centres are fitted on at most 100,000 vectors, drawn by hash (a documented bound); every
    usable vector is put in the cell of its nearest centre. A cell with many vectors is several
    arrays, so no row or task holds a cell. There are about the fourth root of n, times four,
    cells, at most 256, unless given.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    path = path or new_folder(spark, "vector-index")
    good, dims = usable(vectors)
    units = stored(unit(good, "chunk_uuid"), f"{path}/units")
    n = units.count()
    cells = cells or max(1, min(256, round(4 * n**0.25)))
    if n == 0:
        return VectorIndex(dims, 1, spark.createDataFrame([], "cell int, e array<double>"), units.select(F.lit(0).alias("cell"), F.array(F.struct("chunk_uuid", "e")).alias("vs")), good)
    drawn = units if n <= SAMPLE else units.where(F.pmod(F.xxhash64(F.lit(seed), "chunk_uuid"), F.lit(1 << 30)) < (1 << 30) * SAMPLE / n)
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(drawn.select(array_to_vector("e").alias("features")))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cells = len(centres)
    placed = stored(units.withColumn("cell", nearest_cells(units, centres, 1)[0]), f"{path}/cells")
    sizes = placed.groupBy("cell").count().withColumn("arrays", F.ceil(F.col("count") / ARRAY)).select("cell", "arrays")  # a row for each cell
    part = F.pmod(F.xxhash64("chunk_uuid"), F.col("arrays"))
    arrays = placed.join(F.broadcast(sizes), "cell").groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("chunk_uuid", "e")).alias("vs")).drop("part")
    return VectorIndex(dims, cells, stored(spark.createDataFrame(centres, "cell int, e array<double>"), f"{path}/centres"), stored(arrays, f"{path}/arrays"), good)


def search(index: VectorIndex, queries: DataFrame, k: int = 100, probes: int | None = None, digits: int | None = None) -> DataFrame:
    """K-1 from the index: the k nearest in the `probes` nearest cells of each query (all cells: exact). (query_id, chunk_uuid, score, rank), scored exactly.

    Queries go to their cells in arrays of about TOGETHER, which meet arrays of vectors as a
    product of two matrices in the task; a task keeps the k best of each query it has met, so
    what is shuffled are k rows for each task and query. A cell with many queries or vectors is
    many rows of both.
    """
    probes = min(probes or max(1, index.cells // 4), index.cells)
    centres = [(r.cell, r.e) for r in index.centres.collect()]  # at most 256 by default, d numbers each
    if not centres:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_uuid {index.arrays.schema['vs'].dataType.elementType['chunk_uuid'].dataType.simpleString()}, score double, rank int")
    asked = unit(queries.where(finite(F.col("embedding")) & (F.size("embedding") == index.dims)), "query_id")
    to = asked.select("query_id", "e", F.explode(nearest_cells(asked, centres, probes)).alias("cell"))
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(asked.count() * probes / index.cells / TOGETHER))))
    grouped = to.groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("query_id", "e")).alias("qs"))
    met = index.arrays.join(grouped, "cell").select("qs", "vs")
    one = lambda c, name: met.schema[c].dataType.elementType[name]
    schema = StructType([one("qs", "query_id"), one("vs", "chunk_uuid"), StructField("score", DoubleType())])
    hits = met.mapInArrow(scan.nearest(k, digits, to_arrow_schema(schema)), schema)
    return top(rounded(hits, digits), k, [F.desc("score"), F.col("chunk_uuid")])


def recall(index: VectorIndex, queries: DataFrame, k: int, probes: int, exact: DataFrame | None = None) -> float:
    """The part of the exact k nearest that a search of so many cells finds."""
    exact = vector_topk(queries, index.rows, k) if exact is None else exact
    found = search(index, queries, k, probes).select("query_id", "chunk_uuid")
    r = exact.join(found.withColumn("met", F.lit(1)), ["query_id", "chunk_uuid"], "left").agg(F.count("*").alias("n"), F.count("met").alias("met")).first()
    return r.met / r.n if r.n else 1.0


def probes_for(index: VectorIndex, k: int, target: float = 0.95, sample: int = 64, seed: int = 11) -> int:
    """The fewest cells that reach the target recall on about `sample` of the index's own vectors, measured against the exact search."""
    n = index.rows.count()
    rate = min(1.0, sample / max(n, 1))
    drawn = index.rows.where(F.pmod(F.xxhash64(F.lit(seed), "chunk_uuid"), F.lit(1 << 30)) < (1 << 30) * rate).select(F.col("chunk_uuid").alias("query_id"), "embedding")
    exact = stored(vector_topk(drawn, index.rows, k), new_folder(index.rows.sparkSession, "exact"))
    low, high = 1, index.cells
    while low < high:
        middle = (low + high) // 2
        if recall(index, drawn, k, middle, exact) >= target:
            high = middle
        else:
            low = middle + 1
    return low
