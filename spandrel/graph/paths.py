"""Shortest paths: hop counts by frontiers, weights by relaxation rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.graph.model import PropertyGraph
from spandrel.session import materialize, release

ENDS = "source long, target long, nodes array<long>, edges array<long>, length int"


def paths_between(graph: PropertyGraph, sources: DataFrame, targets: DataFrame, direction: str = "out", types: list[str] | None = None, max_depth: int = 1000, excluded: list[int] | None = None, every: bool = True) -> DataFrame:
    """(source, target, nodes, edges, length): the paths with the fewest hops, or without ``every`` the least of them by its ids.

    ``sources`` holds ids as ``source`` and ``targets`` as ``target``, for all sources or, with a column ``source``, for
    that one. All sources advance in the same rounds, each until it has reached all its targets; any number may be asked.
    A source is its own target by a path of length 0. Null ids are ignored.
    """
    spark = graph.nodes.sparkSession
    keys = ["source", "node"] if "source" in targets.columns else ["node"]
    wanted = materialize(targets.withColumnRenamed("target", "node").select(*keys).dropna().distinct(), "ends")
    hops = graph.hops(direction, types).select("a", "b", F.col("id").alias("e"))
    if excluded:
        hops = hops.where(~F.col("b").isin(*excluded))
    start = sources.select("source").dropna().distinct()
    now = materialize(start.select("source", F.col("source").alias("node"), F.array("source").alias("nodes"), F.array().cast("array<long>").alias("edges")), "paths")
    layers, found, done = [now], spark.createDataFrame([], ENDS), None
    if wanted.isEmpty():
        return found
    if "source" in keys:
        total = wanted.groupBy("source").agg(F.count("*").alias("n"))
        now = now.join(total, "source", "left_semi")
    else:
        total = start.select("source", F.lit(wanted.count()).alias("n"))
    for depth in range(max_depth + 1):
        hit = materialize(now.join(wanted, keys, "left_semi").select("source", F.col("node").alias("target"), "nodes", "edges", F.lit(depth).alias("length")), "hits")
        if not hit.isEmpty():
            found = found.union(hit)
            done = found.groupBy("source").agg(F.countDistinct("target").alias("n")).join(total, ["source", "n"]).select("source")
        if depth == max_depth or now.isEmpty():
            break
        front = now if done is None else now.join(done, "source", "left_anti")
        seen = layers[0].select("source", "node")
        for layer in layers[1:]:
            seen = seen.union(layer.select("source", "node"))
        grown = front.join(hops, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("e")).alias("edges"))
        fresh = grown.join(seen, ["source", "node"], "left_anti")
        if not every:
            fresh = fresh.groupBy("source", "node").agg(F.min(F.struct("nodes", "edges")).alias("p")).select("source", "node", "p.*")
        now = materialize(fresh, "paths")
        layers.append(now)
    release(wanted, *layers)
    return found


def all_shortest_paths(graph: PropertyGraph, source: int, target: int, **options) -> DataFrame:
    """Every path with the fewest hops: (nodes, edges, length). The source itself is a path of length 0."""
    ends = graph.nodes.sparkSession.createDataFrame([(source, target)], "source long, target long")
    return paths_between(graph, ends.select("source"), ends, **options).select("nodes", "edges", "length")


def shortest_path(graph: PropertyGraph, source: int, target: int, **options) -> DataFrame:
    """The least of the shortest paths by its node ids."""
    return all_shortest_paths(graph, source, target, every=False, **options)


def sssp(graph: PropertyGraph, source: int, weight: str | None = "weight", default_weight: float = 1.0, max_weight: float | None = None, direction: str = "out", types: list[str] | None = None, max_rounds: int = 1000, target: int | None = None) -> DataFrame:
    """(node, distance, path, edges): least total weights from one node, by relaxation until nothing improves.

    Weights must not be negative; a missing weight counts as ``default_weight``. Ties go to the path of fewer edges, then
    to the least by node ids. Each round grows the nodes that the last one improved, reads ids and distances of the others,
    and writes its improvements alone. With a ``target``, what is no nearer than that is left out, and only it is right.
    """
    spark = graph.nodes.sparkSession
    hops = graph.hops(direction, types)
    cost = F.coalesce(F.col(weight).cast("double"), F.lit(default_weight)) if weight and weight in hops.columns else F.lit(default_weight)
    hops = hops.select("a", "b", F.col("id").alias("e"), cost.alias("w"))
    if not hops.where("w < 0").isEmpty():
        raise ValueError("negative weight")
    hops = materialize(hops.groupBy("a", "b").agg(F.min(F.struct("w", "e")).alias("m")).select("a", "b", "m.w", "m.e"), "sssp")
    changed = spark.createDataFrame([(source, 0.0, [source], [])], "node long, distance double, path array<long>, edges array<long>")
    settled = changed
    for _ in range(max_rounds):
        grown = changed.join(hops, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.concat("path", F.array("b")).alias("path"), F.concat("edges", F.array("e")).alias("edges"))
        if max_weight is not None:
            grown = grown.where(F.col("distance") <= max_weight)
        if target is not None:
            nearest = settled.where(F.col("node") == target).agg(F.min("distance")).first()[0]
            grown = grown if nearest is None else grown.where(F.col("distance") < nearest)
        offer = grown.groupBy("node").agg(F.min(F.struct("distance", "path", "edges")).alias("n")).select("node", "n.*")
        known = settled.select(F.col("node").alias("s"), F.col("distance").alias("d"))
        changed = materialize(offer.join(known, (F.col("node") == F.col("s")) & (F.col("d") <= F.col("distance")), "left_anti"), "sssp")
        if changed.isEmpty():
            release(hops, changed)
            return settled.groupBy("node").agg(F.min(F.struct("distance", "path", "edges")).alias("k")).select("node", "k.*")
        settled = settled.union(changed)
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def dijkstra(graph: PropertyGraph, source: int, target: int, **options) -> DataFrame:
    """(path, total_cost, edges) of the cheapest path; no row if there is none."""
    return sssp(graph, source, target=target, **options).where(F.col("node") == target).select("path", F.col("distance").alias("total_cost"), "edges")


def astar(graph: PropertyGraph, source: int, target: int, lat: str | None = None, lon: str | None = None, max_cost: float | None = None, **options) -> DataFrame:
    """The cheapest path, as ``dijkstra``: an admissible heuristic prunes a sequential search but never changes its answer.

    Rounds over all improved nodes have no queue to order, so ``lat`` and ``lon`` are accepted and not used.
    """
    return dijkstra(graph, source, target, max_weight=max_cost, **options)
