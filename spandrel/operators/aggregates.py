"""Aggregates with the engine's semantics, as columns for ``groupBy().agg()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.registry import col


def array_agg(x, order: bool = True) -> Column:
    """Skips NULLs; no values give NULL; sorted for a stable result unless told not to."""
    items = F.collect_list(col(x))
    return F.when(F.count(col(x)) > 0, F.array_sort(items) if order else items)


def string_agg(x, separator: str = ",") -> Column:
    """Sorted, so that the result does not depend on the partitioning."""
    return F.when(F.count(col(x)) > 0, F.array_join(F.array_sort(F.collect_list(col(x).cast("string"))), separator))


def percentile_cont(p: float, x) -> Column:
    return F.percentile(col(x), F.lit(p))


def percentile_disc(p: float, x: str) -> Column:
    """Smallest value of the column ``x`` whose rank is at least ``p`` of all; counts of distinct values are the state."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{x}`)")


def json_agg(x) -> Column:
    return F.when(F.count(col(x)) > 0, F.to_json(F.array_sort(F.collect_list(col(x)))))


def json_object_agg(k, v) -> Column:
    """The largest value wins for a repeated key; NULL keys are skipped."""
    pairs = F.array_sort(F.collect_list(F.when(col(k).isNotNull(), F.struct(col(k).cast("string").alias("k"), col(v).alias("v")))))
    # Sorted by key and value, the last of each key is the one before another key.
    last = lambda e, i: ~F.coalesce(F.get(pairs, i + 1)["k"] == e.k, F.lit(False))
    return F.to_json(F.map_from_entries(F.filter(pairs, last)))


def bool_and(x) -> Column:
    return F.bool_and(col(x))


def bool_or(x) -> Column:
    return F.bool_or(col(x))


def filtered(agg, x, where: Column) -> Column:
    """agg(x) FILTER (WHERE …) for aggregates that skip NULLs."""
    return agg(F.when(where, col(x)))


def vector_avg(df: DataFrame, by: list[str], vector: str, name: str = "centroid", width: int | None = None) -> DataFrame:
    """Mean vector of each group: positions are averaged apart, so partial sums combine before the shuffle.

    A mean is as long as the group's longest vector, and groups without a vector are left out. With ``width`` every group
    has a mean of that many positions, NULL where none of its vectors has a value.
    """
    values = F.col(vector) if width is None else F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.col(vector), i))
    parts = df.select(*by, F.posexplode(values).alias("__at", "__v")).groupBy(*by, "__at").agg(F.avg(F.col("__v").cast("double")).alias("__m"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__m"))), lambda e: e["__m"]).alias(name))
