"""Procedures by name: ``call("algo.pageRank", graph, …)`` and ``SHOW PROCEDURES``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.graph import analytics, paths, traverse
from spandrel.graph.model import PropertyGraph


@dataclass(frozen=True)
class Procedure:
    run: Callable[..., DataFrame]
    arguments: tuple[str, ...]
    description: str


PROCEDURES: dict[str, Procedure] = {}


def procedure(name: str, arguments: str, description: str):
    def keep(run):
        PROCEDURES[name.lower()] = Procedure(run, tuple(arguments.split()), description)
        return run

    return keep


def _scores(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("nodeId"), "score")


@procedure("algo.pageRank", "damping_factor max_iterations", "PageRank of every node")
def _pagerank(g, damping_factor=0.85, max_iterations=100):
    return _scores(analytics.pagerank(g, damping_factor, max_iterations))


@procedure("algo.betweennessCentrality", "normalized endpoints", "Share of shortest paths through every node")
def _betweenness(g, normalized=True, endpoints=False):
    return _scores(analytics.betweenness_centrality(g, normalized, endpoints))


@procedure("algo.closenessCentrality", "harmonic", "Closeness of every node")
def _closeness(g, harmonic=False):
    return _scores(analytics.closeness_centrality(g, harmonic))


@procedure("algo.degreeCentrality", "direction", "Degrees of every node")
def _degree(g, direction="both"):
    return analytics.degree_centrality(g).select(F.col("id").alias("nodeId"), F.col("in_degree").alias("inDegree"), F.col("out_degree").alias("outDegree"), F.col("total_degree").alias("totalDegree"))


@procedure("algo.eigenvectorCentrality", "maxIterations tolerance", "Eigenvector centrality of every node")
def _eigenvector(g, maxIterations=100, tolerance=1e-6):
    return _scores(analytics.eigenvector_centrality(g, maxIterations, tolerance))


@procedure("algo.louvain", "maxIterations tolerance weightProperty", "Communities by modularity")
def _louvain(g, maxIterations=10, tolerance=1e-4, weightProperty=None):
    found = analytics.louvain(g, maxIterations, tolerance, weightProperty)
    return found.select(F.col("id").alias("nodeId"), F.col("community").alias("communityId"), F.lit(analytics.modularity(g, found, weightProperty)).alias("modularity"))


@procedure("algo.labelPropagation", "maxIterations", "Communities by label propagation")
def _labels(g, maxIterations=100):
    return analytics.label_propagation(g, maxIterations).select(F.col("id").alias("nodeId"), F.col("community").alias("communityId"))


@procedure("algo.connectedComponents", "mode", "Weak or strong components")
def _connected(g, mode="weak"):
    found = analytics.strongly_connected_components(g) if mode == "strong" else analytics.connected_components(g)
    return found.select(F.col("id").alias("nodeId"), F.col("component").alias("componentId"))


@procedure("algo.stronglyConnectedComponents", "", "Strong components")
def _strong(g):
    return _connected(g, "strong")


@procedure("algo.triangleCount", "", "Triangles and clustering coefficient of every node")
def _triangles(g):
    return analytics.triangles(g).join(analytics.clustering_coefficients(g), "id").select(F.col("id").alias("nodeId"), F.col("triangles").alias("triangleCount"), "coefficient")


@procedure("algo.bfs", "startNode edge_type direction maxDepth", "Nodes by depth from a start")
def _bfs(g, startNode, edge_type=None, direction="out", maxDepth=None):
    return traverse.bfs(g, startNode, maxDepth, direction, [edge_type] if edge_type else None)


@procedure("algo.dfs", "startNode edge_type direction maxDepth", "Nodes in preorder from a start")
def _dfs(g, startNode, edge_type=None, direction="out", maxDepth=None):
    return traverse.dfs(g, startNode, maxDepth, direction, [edge_type] if edge_type else None).orderBy("place").drop("place")


@procedure("algo.shortestPath", "sourceId targetId edge_type max_depth", "A path with the fewest hops")
def _shortest(g, sourceId, targetId, edge_type=None, max_depth=1000):
    return paths.shortest_path(g, sourceId, targetId, types=[edge_type] if edge_type else None, max_depth=max_depth).select(F.col("nodes").alias("path"), "length")


@procedure("algo.allShortestPaths", "sourceId targetId edge_type max_depth", "Every path with the fewest hops")
def _all_shortest(g, sourceId, targetId, edge_type=None, max_depth=1000):
    found = paths.all_shortest_paths(g, sourceId, targetId, types=[edge_type] if edge_type else None, max_depth=max_depth)
    return found.select(F.col("nodes").alias("path"), "length", F.col("nodes").alias("nodeIds"), F.col("edges").alias("edgeIds"))


def _costed(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("total_cost").alias("totalCost"), F.col("path").alias("nodeIds"), F.col("edges").alias("edgeIds"))


@procedure("algo.dijkstra", "sourceId targetId weightProperty defaultWeight maxWeight", "The cheapest path")
def _dijkstra(g, sourceId, targetId, weightProperty="weight", defaultWeight=1.0, maxWeight=None):
    return _costed(paths.dijkstra(g, sourceId, targetId, weight=weightProperty, default_weight=defaultWeight, max_weight=maxWeight))


@procedure("algo.astar", "sourceId targetId weightProperty latProperty lonProperty maxCost", "The cheapest path")
def _astar(g, sourceId, targetId, weightProperty="weight", latProperty=None, lonProperty=None, maxCost=None):
    return _costed(paths.astar(g, sourceId, targetId, latProperty, lonProperty, maxCost, weight=weightProperty))


@procedure("algo.sssp", "sourceId weightProperty maxWeight", "Least costs from one node")
def _sssp(g, sourceId, weightProperty="weight", maxWeight=None):
    return paths.sssp(g, sourceId, weightProperty, max_weight=maxWeight).select(F.col("node").alias("nodeId"), "distance", F.col("path").alias("pathNodeIds"))


@procedure("algo.nodeSimilarity", "label edge_type topK similarityCutoff", "Pairs by shared neighbours")
def _similarity(g, label=None, edge_type=None, topK=None, similarityCutoff=0.0):
    return analytics.node_similarity(g, "jaccard", topK, similarityCutoff, label, [edge_type] if edge_type else None)


@procedure("algo.jaccard", "node1 node2 edge_type", "Jaccard similarity of two nodes")
def _jaccard(g, node1, node2, edge_type=None):
    return analytics.pair_similarity(g, node1, node2, "jaccard", [edge_type] if edge_type else None).select("similarity")


@procedure("algo.overlap", "node1 node2 edge_type", "Overlap of two nodes")
def _overlap(g, node1, node2, edge_type=None):
    return analytics.pair_similarity(g, node1, node2, "overlap", [edge_type] if edge_type else None).select("similarity")


@procedure("algo.cosine", "node1 node2 properties", "Cosine of two nodes' properties")
def _cosine(g, node1, node2, properties):
    return analytics.property_cosine(g, node1, node2, list(properties)).select("similarity")


def call(name: str, graph: PropertyGraph, *arguments, **named) -> DataFrame:
    """Run a procedure; positional arguments follow its declared order."""
    found = PROCEDURES.get(name.lower())
    if found is None:
        raise LookupError(f"no procedure {name}")
    if len(arguments) > len(found.arguments):
        raise TypeError(f"{name} takes {len(found.arguments)} arguments at most")
    return found.run(graph, **dict(zip(found.arguments, arguments)), **named)


def show_procedures(spark: SparkSession) -> DataFrame:
    rows = [(name, p.description, "READ", False) for name, p in sorted(PROCEDURES.items())]
    return spark.createDataFrame(rows, "name string, description string, mode string, worksOnSystem boolean")
