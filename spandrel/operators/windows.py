"""Window features that Spark's windows lack: GROUPS frames, EXCLUDE and FILTER."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = None


def _bound(value: int | None, low: bool) -> int:
    if value is None:
        return Window.unboundedPreceding if low else Window.unboundedFollowing
    return value


def window_aggregate(df: DataFrame, name: str, agg: str, value: Column, partition: list[str], order: list[Column], frame: tuple[str, int | None, int | None], exclude: str | None = None, where: Column | None = None) -> DataFrame:
    """``df`` with ``name`` = agg(value) FILTER (WHERE …) over a ROWS, RANGE or GROUPS frame with EXCLUDE.

    ``agg``: sum, count, avg, min, max, first_value or last_value. Offsets count
    from the current row, None is unbounded. GROUPS frames become RANGE frames
    over the dense rank. Sums, counts and averages subtract excluded rows from
    the frame where it holds all of them; other cases go through the frame's
    rows as an array, whose size is the frame's.
    """
    kind, low, high = frame
    x = value if where is None else F.when(where, value)
    base = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    ordered = base.orderBy(*order)
    rank = "__peers"
    out = df.withColumn("__x", x).withColumn(rank, F.dense_rank().over(ordered))
    if kind == "groups":
        spec = base.orderBy(rank).rangeBetween(_bound(low, True), _bound(high, False))
    elif kind == "range":
        spec = ordered.rangeBetween(_bound(low, True), _bound(high, False))
    else:
        spec = ordered.rowsBetween(_bound(low, True), _bound(high, False))
    total, count = F.sum("__x").over(spec), F.count("__x").over(spec)
    inside = (low is None or low <= 0) and (high is None or high >= 0)
    own, held = F.coalesce(F.col("__x"), F.lit(0)), F.when(F.col("__x").isNotNull(), 1).otherwise(0)
    peers = base.orderBy(rank).rangeBetween(0, 0)
    whole = inside and kind != "rows"
    if agg in ("sum", "count", "avg") and (exclude in (None, "no others") or (inside and exclude == "current row") or whole):
        less, fewer = F.lit(0), F.lit(0)
        if exclude == "current row":
            less, fewer = own, held
        elif exclude in ("group", "ties"):
            less, fewer = F.coalesce(F.sum("__x").over(peers), F.lit(0)), F.count("__x").over(peers)
            if exclude == "ties":
                less, fewer = less - own, fewer - held
        left = count - fewer
        made = left if agg == "count" else F.when(left > 0, (F.coalesce(total, F.lit(0)) - less) / (left if agg == "avg" else F.lit(1)))
        if agg == "sum":
            made = F.when(left > 0, F.coalesce(total, F.lit(0)) - less)
        return out.withColumn(name, made).drop("__x", rank)
    row = "__row"
    out = out.withColumn(row, F.row_number().over(ordered))
    rows = F.collect_list(F.struct(F.col(row).alias("r"), F.col(rank).alias("p"), F.col("__x").alias("x"), (where if where is not None else F.lit(True)).alias("w"))).over(spec)
    out = out.withColumn("__rows", rows)
    drop = {
        "current row": lambda e: e.r != F.col(row),
        "group": lambda e: e.p != F.col(rank),
        "ties": lambda e: (e.p != F.col(rank)) | (e.r == F.col(row)),
    }.get(exclude, lambda e: F.lit(True))
    kept = F.filter("__rows", lambda e: drop(e) & F.coalesce(e.w, F.lit(False)))
    values = F.transform(kept, lambda e: e.x)
    solid = F.array_compact(values)
    sums = F.aggregate(solid, F.lit(0.0), lambda a, v: a + v.cast("double"))
    made = {
        "sum": lambda: F.when(F.size(solid) > 0, sums),
        "count": lambda: F.size(solid).cast("long"),
        "avg": lambda: F.when(F.size(solid) > 0, sums / F.size(solid)),
        "min": lambda: F.array_min(solid),
        "max": lambda: F.array_max(solid),
        "first_value": lambda: F.get(values, F.lit(0)),
        "last_value": lambda: F.try_element_at(values, F.lit(-1)),
    }[agg]()
    return out.withColumn(name, made).drop("__x", rank, row, "__rows")
