"""Connected components of an edge list, by large and small stars.

Each round relinks every node to the least neighbour it knows; the number of
rounds is logarithmic in practice. Every round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldline.session import discard, materialise

# Rounds of more edges than this join by shuffle: their files may be small enough for a broadcast when their rows are not.
BROADCAST_EDGES = 250_000


def _by_shuffle(least: DataFrame, many: bool) -> DataFrame:
    return least.hint("shuffle_merge") if many else least


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(_by_shuffle(least, many), "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Edges point from the smaller node a to the larger b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(_by_shuffle(least, many), "b")
    return (
        moved.select(F.col("m").alias("x"), F.col("a").alias("y"))
        .unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        .filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b); root is the least node. A stored table."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    current, before = materialise(ordered, "components"), None
    while True:
        size = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before = size
        many = size[0] > BROADCAST_EDGES
        after = materialise(_small_star(_large_star(current, many), many), "components")
        discard(current)
        current = after
    out = materialise(
        current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
            current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
        ),
        "component-roots",
    )
    discard(current)
    return out
