"""Expansion and traversal by frontiers: each round joins only the nodes reached last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.graph.model import PropertyGraph
from spandrel.session import materialize


def expand(graph: PropertyGraph, rows: DataFrame, start: str, to: str, direction: str = "out", types: list[str] | None = None, edge: str | None = None, labels: str | None = None, where: Column | None = None, edge_where: Column | None = None, optional: bool = False) -> DataFrame:
    """One hop from the node ids in column ``start``; adds column ``to`` and, if named, the edge as a struct.

    ``labels`` and ``where`` restrict the reached nodes. ``optional`` keeps rows without a hop.
    """
    hops = graph.hops(direction, types, edge_where)
    if labels is not None or where is not None:
        hops = hops.join(graph.nodes_with(labels, where).select(F.col("id").alias("__id")), F.col("b") == F.col("__id"), "left_semi")
    carried = [F.col("a").alias("__a"), F.col("b").alias(to)]
    if edge:
        carried.append(F.struct(*[F.col(c) for c in graph.edges.columns]).alias(edge))
    return rows.join(hops.select(*carried), F.col(start) == F.col("__a"), "left" if optional else "inner").drop("__a")


def reach(graph: PropertyGraph, starts: DataFrame, low: int = 1, high: int | None = None, direction: str = "out", types: list[str] | None = None, labels: str | None = None, max_rounds: int = 1000) -> DataFrame:
    """(source, node, depth): each node once a source, at its least depth, for depths from ``low`` to ``high``.

    ``starts`` has a column ``id``. Without ``high`` it goes on until nothing new
    is reached. The start itself has depth 0 and is returned only if ``low`` is 0.
    """
    hops = graph.hops(direction, types).select("a", "b").distinct()
    seen = materialize(starts.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    frontier = seen
    for depth in range(1, (high if high is not None else max_rounds) + 1):
        found = frontier.join(hops, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        frontier = materialize(found.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    found = seen.where(F.col("depth") >= low)
    if labels is not None:
        found = found.join(graph.nodes_with(labels).select(F.col("id").alias("node")), "node", "left_semi").select("source", "node", "depth")
    return found


def bfs(graph: PropertyGraph, start: int, max_depth: int | None = None, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node, depth, path): breadth first from one node; the path is the least one by node ids."""
    return _walk(graph, start, max_depth, direction, types)


#: Edges among reached nodes up to which depth-first order is computed; it is sequential, so they go to the driver.
DFS_EDGES = 2_000_000


def dfs(graph: PropertyGraph, start: int, max_depth: int | None = None, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node, depth, path, place): depth first from one node, neighbours by id, each node where it is first visited.

    Reached nodes are found by a distributed walk first. Depth-first order cannot be computed in parallel: more than
    ``DFS_EDGES`` edges among them raise an error.
    """
    spark = graph.nodes.sparkSession
    starts = spark.createDataFrame([(start,)], "id long")
    near = reach(graph, starts, 0, max_depth, direction, types).select("node")
    hops = graph.hops(direction, types).select("a", "b").distinct()
    inner = hops.join(near.withColumnRenamed("node", "a"), "a", "left_semi").join(near.withColumnRenamed("node", "b"), "b", "left_semi")
    pairs = inner.limit(DFS_EDGES + 1).collect()
    if len(pairs) > DFS_EDGES:
        raise ValueError(f"depth-first order over more than {DFS_EDGES} edges; set max_depth")
    after: dict[int, list[int]] = {}
    for a, b in sorted((r["a"], r["b"]) for r in pairs):
        after.setdefault(a, []).append(b)
    seen, rows, todo = {start}, [(start, 0, [start], 1)], [iter(after.get(start, ()))]
    path = [start]
    while todo:
        following = next((b for b in todo[-1] if b not in seen), None) if max_depth is None or len(path) <= max_depth else None
        if following is None:
            todo.pop()
            path.pop()
            continue
        seen.add(following)
        path.append(following)
        rows.append((following, len(path) - 1, list(path), len(rows) + 1))
        todo.append(iter(after.get(following, ())))
    return spark.createDataFrame(rows, "node long, depth int, path array<long>, place int")


def _walk(graph, start, max_depth, direction, types) -> DataFrame:
    hops = graph.hops(direction, types).select("a", "b").distinct()
    spark = graph.nodes.sparkSession
    seen = spark.createDataFrame([(start, 0, [start])], "node long, depth int, path array<long>")
    frontier = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(hops, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        least = found.groupBy("node").agg(F.min("path").alias("path"))
        frontier = materialize(least.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path"), "walk")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def paths(graph: PropertyGraph, starts: DataFrame, low: int, high: int, direction: str = "out", types: list[str] | None = None, distinct: str = "nodes") -> DataFrame:
    """Every path of ``low`` to ``high`` hops: (source, node, nodes, edges).

    ``distinct`` "nodes" forbids a node twice on a path, "edges" an edge twice, "none" nothing.
    """
    hops = graph.hops(direction, types).select("a", "b", F.col("id").alias("e"))
    now = starts.select(F.col("id").alias("source"), F.col("id").alias("node"), F.array("id").alias("nodes"), F.array().cast("array<long>").alias("edges")).distinct()
    out = now if low == 0 else None
    for depth in range(1, high + 1):
        step = now.join(hops, F.col("node") == F.col("a"))
        if distinct == "nodes":
            step = step.where(~F.array_contains("nodes", F.col("b")))
        elif distinct == "edges":
            step = step.where(~F.array_contains("edges", F.col("e")))
        now = step.select("source", F.col("b").alias("node"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("e")).alias("edges"))
        if depth % 3 == 0:
            now = materialize(now, "paths")
        if depth >= low:
            out = now if out is None else out.union(now)
    return out
