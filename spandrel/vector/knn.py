"""Exact nearest neighbours, single and batched, with filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators.joins import BROADCAST_BYTES, planned_bytes
from spandrel.vector.distance import METRICS, literal_vector


def search(df: DataFrame, query: list[float], k: int, metric: str = "euclidean", id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None, max_distance: float | None = None) -> DataFrame:
    """The ``k`` nearest rows with ``distance``; the filter runs before the distances, the top-k is partial in each task."""
    rows = df if where is None else df.where(where)
    scored = rows.withColumn("distance", METRICS[metric](F.col(vector_col), literal_vector(query))).where(F.col("distance").isNotNull())
    if max_distance is not None:
        scored = scored.where(F.col("distance") <= max_distance)
    return scored.orderBy("distance", id_col).limit(k)


def search_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", id_col: str = "vec_id", vector_col: str = "embedding", blocks: int = 64) -> DataFrame:
    """(query_id, id, distance, rank) for every row of ``queries`` (query_id, query).

    A query set of checked size is broadcast to the scan. A larger one is dealt
    to ``blocks``, to each of which the rows are sent once. Ranks are cut to
    ``k`` in each task before the shuffle.
    """
    rows = df.select(F.col(id_col), F.col(vector_col))
    if planned_bytes(queries) <= BROADCAST_BYTES:
        pairs = rows.join(F.broadcast(queries), F.lit(True))
    else:
        dealt = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        pairs = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "__block")
    scored = pairs.withColumn("distance", METRICS[metric](F.col(vector_col), F.col("query"))).where(F.col("distance").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return scored.select("query_id", id_col, "distance").withColumn("rank", rank).where(F.col("rank") <= k)


def search_within(df: DataFrame, allowed: DataFrame, query: list[float], k: int, metric: str = "euclidean", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Nearest rows among the ids of ``allowed`` (column ``node``), such as the result of a traversal."""
    return search(df.join(allowed.select(F.col("node").alias(id_col)).distinct(), id_col, "left_semi"), query, k, metric, id_col, vector_col)
