"""Collections of points: named vectors and a payload, with filters and bulk changes that return a new collection."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.vector import knn


@dataclass(frozen=True)
class Collection:
    """``points``: id, one array column for each named vector, and payload columns."""

    points: DataFrame
    vectors: dict[str, tuple[int, str]]
    name: str = "points"
    metadata: dict = field(default_factory=dict)

    def check(self) -> DataFrame:
        """Points whose vectors have another length than declared."""
        wrong = [F.col(v).isNotNull() & (F.size(v) != size) for v, (size, _) in self.vectors.items()]
        return self.points.where(reduce(lambda a, b: a | b, wrong, F.lit(False)))

    def insert(self, rows: DataFrame) -> Collection:
        """New points; ids that exist are left as they are."""
        fresh = rows.join(self.points.select("id"), "id", "left_anti")
        return replace(self, points=self.points.unionByName(fresh, allowMissingColumns=True))

    def upsert(self, rows: DataFrame) -> Collection:
        old = self.points.join(rows.select("id"), "id", "left_anti")
        return replace(self, points=old.unionByName(rows, allowMissingColumns=True))

    def delete(self, test: Column) -> Collection:
        return replace(self, points=self.points.where(~F.coalesce(test, F.lit(False))))

    def set_payload(self, test: Column, **values) -> Collection:
        changed = {k: F.when(test, F.lit(v)).otherwise(F.col(k)) if k in self.points.columns else F.when(test, F.lit(v)) for k, v in values.items()}
        return replace(self, points=self.points.withColumns(changed))

    def search(self, vector: str, query: list[float], k: int, filter: dict | None = None) -> DataFrame:
        return knn.search(self.points, query, k, self.vectors[vector][1], "id", vector, payload_filter(filter) if filter else None)


def payload_filter(tree: dict) -> Column:
    """Column of a filter tree.

    Leaves are {"field": f, "op": value} with op of eq, ne, gt, gte, lt, lte,
    range (low, high), in, not_in, contains, starts_with, array_contains, exists;
    {"and": [...]}, {"or": [...]} and {"not": tree} combine them.
    """
    if "and" in tree:
        return reduce(lambda a, b: a & b, map(payload_filter, tree["and"]))
    if "or" in tree:
        return reduce(lambda a, b: a | b, map(payload_filter, tree["or"]))
    if "not" in tree:
        return ~payload_filter(tree["not"])
    c = F.col(tree["field"])
    op, value = next((k, v) for k, v in tree.items() if k != "field")
    return {
        "eq": lambda: c == value,
        "ne": lambda: c != value,
        "gt": lambda: c > value,
        "gte": lambda: c >= value,
        "lt": lambda: c < value,
        "lte": lambda: c <= value,
        "range": lambda: c.between(*value),
        "in": lambda: c.isin(*value),
        "not_in": lambda: ~c.isin(*value),
        "contains": lambda: F.contains(c, F.lit(value)),
        "starts_with": lambda: F.startswith(c, F.lit(value)),
        "array_contains": lambda: F.array_contains(c, value),
        "exists": lambda: c.isNotNull() if value else c.isNull(),
    }[op]()
