"""Join helpers where Spark's own ``join`` needs a rewrite or a guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; an unknown size is estimated as very large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its planned size is within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if planned_bytes(df) <= limit else df


def join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """All nine join types; right semi and anti are the left ones with sides swapped."""
    if how in ("right_semi", "right_anti"):
        return right.join(left, on, how.replace("right", "left"))
    return left.join(right, on, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with ``low <= point <= high`` as an equi-join on buckets of ``width``.

    Each interval enters every bucket it touches, each point one; widths near a
    typical interval keep that short, and no nested-loop join is planned.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = right.where(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    placed = left.where(F.col(point).isNotNull()).withColumn("__cell", cell(point))
    return placed.join(spread, "__cell").where(F.col(point).between(F.col(low), F.col(high))).drop("__cell")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join with the left side's keys spread over ``salts`` tasks and the right side repeated for each.

    For a left side in which one key holds a large share of the rows and the
    right side is unique or small a key. Inner, left, left semi and left anti.
    Always merged: Catalyst's estimate of the right side leaves its repetition
    out, so it would be broadcast at ``salts`` times the bytes that are allowed.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted {how} join would repeat unmatched right rows")
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated.hint("merge"), [key, "__salt"], how).drop("__salt")


def lateral_top(left: DataFrame, right: DataFrame, on: Column, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """For each left row its first ``n`` matches in ``order`` (LATERAL … ORDER BY … LIMIT n); ``keys`` identify left rows."""
    from pyspark.sql import Window

    ranked = left.join(right, on).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")
