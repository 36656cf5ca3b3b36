"""Weakly connected components by alternating large-star and small-star rounds.

Nothing is collected: each round is two grouped minima and two joins, and its
edge list is written to the shared folder, so lineage stays one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import materialize, release


#: Edges of a partition at least; short lists are kept in few partitions, as each round shuffles them several times.
PART_EDGES = 200_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts).distinct().coalesce(parts)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``component`` is the smallest node id of the component. Self loops, nulls
    and repeated edges are ignored; an empty edge list gives an empty result.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    current = materialize(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark.n == 0:
            break
        seen = mark
        parts = mark.n // PART_EDGES + 1
        following = materialize(_small_star(_large_star(current, parts), parts), "cc")
        release(current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
