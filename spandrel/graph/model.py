"""Property graphs as two DataFrames.

``nodes``: id long, labels array<string>, and property columns.
``edges``: id long, src long, dst long, edge_type string, and property columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.values import label_expression

DIRECTIONS = ("out", "in", "both")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame) -> PropertyGraph:
        """Graph of an edge list with src and dst; missing edge columns are filled in."""
        if "edge_type" not in edges.columns:
            edges = edges.withColumn("edge_type", F.lit("EDGE"))
        if "id" not in edges.columns:
            edges = edges.withColumn("id", F.xxhash64("src", "dst", "edge_type"))
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return cls(ends.withColumn("labels", F.array(F.lit("Node"))), edges)

    def nodes_with(self, labels: str | None = None, where: Column | None = None) -> DataFrame:
        found = self.nodes if labels is None else self.nodes.where(label_expression("labels", labels))
        return found if where is None else found.where(where)

    def edges_of(self, types: list[str] | None = None, where: Column | None = None) -> DataFrame:
        found = self.edges if not types else self.edges.where(F.col("edge_type").isin(*types))
        return found if where is None else found.where(where)

    def hops(self, direction: str = "out", types: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """Edges as (a, b, edge and its columns), to be walked from a to b."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {DIRECTIONS}")
        found = self.edges_of(types, where)
        out = found.withColumns({"a": F.col("src"), "b": F.col("dst")})
        back = found.withColumns({"a": F.col("dst"), "b": F.col("src")})
        return {"out": out, "in": back, "both": out.union(back.where("src <> dst"))}[direction]

    def undirected(self) -> DataFrame:
        """Distinct pairs a < b."""
        return self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
