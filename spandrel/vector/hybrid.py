"""Combining two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hybrid_distance(first, first_weight: float, second, second_weight: float) -> Column:
    """HYBRID(d1, w1, d2, w2) of one row: the mean by weight of the distances that are not NULL."""
    parts = [(F.col(first).cast("double"), first_weight), (F.col(second).cast("double"), second_weight)]
    total, weight = F.lit(0.0), F.lit(0.0)
    for distance, w in parts:
        total = total + F.coalesce(distance * w, F.lit(0.0))
        weight = weight + F.when(distance.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0))
    return F.when(weight != 0, total / weight)


def _ranked(scores: DataFrame, key: str, score: str, ascending: bool) -> DataFrame:
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return scores.withColumn("__rank", F.row_number().over(Window.orderBy(order, key)) - 1)


def weighted(dense: DataFrame, sparse: DataFrame, key: str, dense_weight: float = 0.5, sparse_weight: float = 0.5) -> DataFrame:
    """(key, score) of two bounded candidate lists (key, distance): min-max normalised, a missing one counts as 1."""

    def scaled(frame: DataFrame, name: str) -> DataFrame:
        bounds = frame.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
        value = F.when(F.col("hi") > F.col("lo"), (F.col("distance") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
        return frame.crossJoin(F.broadcast(bounds)).select(key, value.alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), key, "full")
    return both.select(key, (F.coalesce("d", F.lit(1.0)) * dense_weight + F.coalesce("s", F.lit(1.0)) * sparse_weight).alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, distance) of bounded candidate lists (key, distance): 1 - s / max s with s = Σ 1/(k + rank + 1), rank from 0."""
    parts = [_ranked(frame, key, "distance", True).select(key, (1.0 / (F.lit(k) + F.col("__rank") + 1)).alias("s")) for frame in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    sums = union.groupBy(key).agg(F.sum("s").alias("s"))
    top = sums.agg(F.max("s").alias("top"))
    return sums.crossJoin(F.broadcast(top)).select(key, (1 - F.col("s") / F.col("top")).alias("distance"))
