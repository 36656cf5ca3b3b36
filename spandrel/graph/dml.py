"""Graph changes: each function returns a new graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.graph.model import PropertyGraph


def create(graph: PropertyGraph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
    """CREATE: adds nodes and edges; missing property columns become NULL."""
    out = graph
    if nodes is not None:
        out = replace(out, nodes=out.nodes.unionByName(nodes, allowMissingColumns=True))
    if edges is not None:
        out = replace(out, edges=out.edges.unionByName(edges, allowMissingColumns=True))
    return out


def merge_nodes(graph: PropertyGraph, rows: DataFrame, keys: list[str], on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> PropertyGraph:
    """MERGE: rows without a node of equal ``keys`` become nodes (ON CREATE SET); nodes that match get ON MATCH SET."""
    fresh = rows.join(graph.nodes.select(*keys), keys, "left_anti")
    fresh = fresh.withColumns(on_create or {})
    old = graph.nodes
    if on_match:
        hit = old.join(rows.select(*keys).distinct().withColumn("__hit", F.lit(1)), keys, "left")
        old = hit.withColumns({c: F.when(F.col("__hit") == 1, v).otherwise(F.col(c) if c in old.columns else F.lit(None)) for c, v in on_match.items()}).drop("__hit")
    return replace(graph, nodes=old.unionByName(fresh, allowMissingColumns=True))


def merge_edges(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """MERGE of edges (src, dst, edge_type, …): those that exist are kept, the others added."""
    fresh = rows.join(graph.edges.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")
    return replace(graph, edges=graph.edges.unionByName(fresh, allowMissingColumns=True))


def set_properties(graph: PropertyGraph, where: Column, **values) -> PropertyGraph:
    """SET n.x = …; values are columns or literals."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    old = lambda k: F.col(k) if k in graph.nodes.columns else F.lit(None)
    return replace(graph, nodes=graph.nodes.withColumns({k: F.when(where, column(v)).otherwise(old(k)) for k, v in values.items()}))


def set_labels(graph: PropertyGraph, where: Column, *labels: str) -> PropertyGraph:
    added = F.array_union("labels", F.array(*map(F.lit, labels)))
    return replace(graph, nodes=graph.nodes.withColumn("labels", F.when(where, added).otherwise(F.col("labels"))))


def remove_properties(graph: PropertyGraph, where: Column, *names: str) -> PropertyGraph:
    kinds = {f.name: f.dataType for f in graph.nodes.schema.fields}
    return replace(graph, nodes=graph.nodes.withColumns({n: F.when(where, F.lit(None).cast(kinds[n])).otherwise(F.col(n)) for n in names}))


def remove_labels(graph: PropertyGraph, where: Column, *labels: str) -> PropertyGraph:
    left = F.array_except("labels", F.array(*map(F.lit, labels)))
    return replace(graph, nodes=graph.nodes.withColumn("labels", F.when(where, left).otherwise(F.col("labels"))))


class HasEdges(RuntimeError):
    pass


def delete_nodes(graph: PropertyGraph, where: Column, detach: bool = False) -> PropertyGraph:
    """DELETE raises if a node still has edges; DETACH DELETE removes them too."""
    gone = graph.nodes.where(F.coalesce(where, F.lit(False))).select("id")
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if not detach:
        if not ends.join(gone, "id", "left_semi").isEmpty():
            raise HasEdges("nodes to delete still have edges")
        return replace(graph, nodes=delete_rows(graph.nodes, where))
    edges = graph.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*graph.edges.columns)
    return PropertyGraph(delete_rows(graph.nodes, where), edges)


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_edges(graph: PropertyGraph, where: Column) -> PropertyGraph:
    return replace(graph, edges=delete_rows(graph.edges, where))


def foreach(graph: PropertyGraph, items: list, change) -> PropertyGraph:
    """FOREACH (x IN items | …): ``change(graph, x)`` in turn; the list is part of the statement, so it is short."""
    for item in items:
        graph = change(graph, item)
    return graph
