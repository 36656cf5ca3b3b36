"""Sorts, limits and first-row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_key(name: str, descending: bool = False, nulls: str | None = None) -> Column:
    """NULLS LAST going up and NULLS FIRST going down, unless said otherwise."""
    first = (nulls or ("first" if descending else "last")) == "first"
    c = F.col(name)
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def limit_with_ties(df: DataFrame, n: int, keys: list[tuple[str, bool]], by: list[str] | None = None) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the first ``n`` rows and those equal to the last of them in the sort keys.

    ``keys`` are (column, descending). Without ``by`` the keys of the first rows
    come from a top-k of ``n`` rows, which are broadcast: no task gets all rows.
    """
    order = [sort_key(name, down) for name, down in keys]
    if by:
        return df.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")
    names = [name for name, _ in keys]
    top = df.select(*names).orderBy(*order).limit(n).distinct().select(*[F.col(c).alias(f"__{c}") for c in names])
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(F.broadcast(top), match, "left_semi")


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def page(df: DataFrame, n: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)
