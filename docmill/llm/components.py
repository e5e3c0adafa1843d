"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import stored
from docmill.sources.shared import new_folder, remove_folder


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Labels each node of edges (src, dst: long) with the smallest node that it reaches.

    Returns (node, component), one row for each node that has an edge to another node. Null
    ends and loops are ignored; an empty table gives an empty result. A round hangs every
    node under the smallest neighbour it knows, first among larger neighbours, then among
    smaller ones, so the number of rounds grows with the logarithm of the number of nodes.
    Each round is two shuffles of at most the number of edges and is written to the shared
    folder, and the one before it deleted. A node's neighbours are only ever joined to their
    minimum, never collected. With 2^60 nodes 60 rounds are enough; more raise an error.
    """
    folder = new_folder(edges.sparkSession, "components")
    links = stored(
        edges.where("src is not null and dst is not null and src != dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct(),
        f"{folder}/0",
    )
    before = None
    for turn in range(1, most_rounds + 1):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(lowest, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .where("a != b")
            .distinct()
        )
        # Small star: b < a in every row of large, so a's smaller neighbours are its rows.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        links = stored(
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .distinct(),
            f"{folder}/{turn}",
        )
        remove_folder(edges.sparkSession, f"{folder}/{turn - 1}")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
