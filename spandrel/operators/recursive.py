"""Recursive queries as loops over DataFrames.

Each round reads only the rows the last one added. Rounds are written to the
shared folder, so lineage does not grow, and nothing is collected but a flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import materialize


class TooManyRounds(RuntimeError):
    pass


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, max_rounds: int = 100) -> DataFrame:
    """WITH RECURSIVE: ``step`` gets the rows added last. ``distinct`` is UNION (rows seen before end there), else UNION ALL."""
    fresh = materialize(seed.distinct() if distinct else seed, "recursive")
    total = fresh
    for _ in range(max_rounds):
        if fresh.isEmpty():
            return total
        made = step(fresh).select(*seed.columns)
        if distinct:
            made = made.subtract(total)
        fresh = materialize(made, "recursive")
        total = total.unionByName(fresh)
    if fresh.isEmpty():
        return total
    raise TooManyRounds(f"rows were still added after {max_rounds} rounds")


def with_search(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, name: str, depth_first: bool = True, max_rounds: int = 100) -> DataFrame:
    """SEARCH DEPTH | BREADTH FIRST BY key SET name: a sequence column to order by.

    ``step`` must carry ``__path`` through, which is the array of keys up to the parent.
    """
    start = seed.withColumn("__path", F.array(F.col(key)))

    def grow(fresh: DataFrame) -> DataFrame:
        return step(fresh).withColumn("__path", F.concat("__path", F.array(F.col(key))))

    rows = recursive(start, grow, distinct=False, max_rounds=max_rounds)
    order = F.col("__path") if depth_first else F.struct(F.size("__path").alias("depth"), F.col(key).alias("key"))
    return rows.withColumn(name, order).drop("__path")


def with_cycle(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, mark: str = "is_cycle", path: str = "path", max_rounds: int = 100) -> DataFrame:
    """CYCLE key SET mark USING path: a row whose key is already on its path is kept, marked, and not followed."""
    start = seed.withColumn(path, F.array(F.col(key))).withColumn(mark, F.lit(False))

    def grow(fresh: DataFrame) -> DataFrame:
        made = step(fresh.where(~F.col(mark)))
        return made.withColumn(mark, F.array_contains(path, F.col(key))).withColumn(path, F.concat(path, F.array(F.col(key))))

    return recursive(start, grow, distinct=False, max_rounds=max_rounds)


def unwind(df: DataFrame, items: str, name: str) -> DataFrame:
    """A row for each element; NULL and empty lists give none."""
    return df.withColumn(name, F.explode(items))
