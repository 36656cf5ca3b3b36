"""Graph algorithms. Each loop writes its small state to the shared folder once a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.graph.components import connected_components as _components
from spandrel.graph.model import PropertyGraph
from spandrel.session import materialize, release


def _ids(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.select("id").distinct()


def pagerank(graph: PropertyGraph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): dangling mass is spread evenly; stops when no score moves by ``tolerance``; sums to 1."""
    ids = _ids(graph)
    n = ids.count()
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    base = materialize(ids.join(out, "id", "left").fillna(0, ["out"]), "rank")
    edges = materialize(graph.edges.select("src", "dst"), "rank")
    ranks = materialize(base.withColumn("score", F.lit(1.0 / max(n, 1))), "rank")
    for _ in range(max_iterations):
        dangling = ranks.where("out = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        given = edges.join(ranks.where("out > 0").select(F.col("id").alias("src"), (F.col("score") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        fresh = ranks.withColumnRenamed("score", "old").join(given, "id", "left")
        fresh = materialize(fresh.withColumn("score", F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("got", F.lit(0.0))).select("id", "out", "score", F.abs(F.col("score") - F.col("old")).alias("moved")), "rank")
        moved = fresh.agg(F.max("moved")).first()[0]
        release(ranks)
        ranks = fresh
        if moved is None or moved < tolerance:
            break
    total = ranks.agg(F.sum("score")).first()[0] or 1.0
    return ranks.select("id", (F.col("score") / total).alias("score"))


def degree_centrality(graph: PropertyGraph) -> DataFrame:
    """(id, in_degree, out_degree, total_degree)."""
    ends = graph.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(graph.edges.select("dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return _ids(graph).join(sums, "id", "left").fillna(0).withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))


def _undirected_hops(graph: PropertyGraph) -> DataFrame:
    pairs = graph.undirected()
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _all_depths(graph: PropertyGraph, hops: DataFrame) -> tuple[DataFrame, int]:
    """(source, node, depth, paths): shortest path counts between all pairs, and the greatest depth."""
    seen = materialize(_ids(graph).select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths")), "depths")
    frontier, depth = seen, 0
    while True:
        found = frontier.join(hops, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = materialize(found.join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(depth + 1).alias("depth"), "paths"), "depths")
        if fresh.isEmpty():
            return seen, depth
        depth += 1
        frontier, seen = fresh, seen.union(fresh)


def closeness_centrality(graph: PropertyGraph, harmonic: bool = False) -> DataFrame:
    """(id, score) over outgoing hops: reached/Σd · reached/(n-1), or Σ1/d/(n-1)."""
    n = _ids(graph).count()
    depths, _ = _all_depths(graph, graph.hops("out").select("a", "b").distinct())
    sums = depths.where("depth > 0").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("depth").alias("d"), F.sum(1 / F.col("depth")).alias("h"))
    score = F.col("h") / (n - 1) if harmonic else F.col("r") / F.col("d") * F.col("r") / (n - 1)
    return _ids(graph).join(sums, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def betweenness_centrality(graph: PropertyGraph, normalized: bool = True, endpoints: bool = False) -> DataFrame:
    """(id, score): Brandes' dependencies over undirected hops, all sources at once, one join a depth."""
    n = _ids(graph).count()
    hops = materialize(_undirected_hops(graph), "between")
    depths, deepest = _all_depths(graph, hops)
    depths = materialize(depths, "between")
    below = depths.where("false").select("source", "node", "paths", F.lit(0.0).alias("dependency"))
    parts = [below]
    now = None
    for depth in range(deepest, -1, -1):
        layer = depths.where(F.col("depth") == depth).select("source", "node", "paths")
        if now is None:
            now = layer.withColumn("dependency", F.lit(0.0))
        else:
            given = now.select("source", F.col("node").alias("w"), (F.lit(1.0) + F.col("dependency")).alias("g"), F.col("paths").alias("pw")).join(hops.select(F.col("a").alias("w"), F.col("b").alias("node")), "w")
            got = given.join(layer, ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("paths") / F.col("pw") * F.col("g")).alias("dependency"))
            now = layer.join(got, ["source", "node"], "left").fillna(0.0, ["dependency"])
        now = materialize(now, "between")
        parts.append(now)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    scores = whole.where("source <> node").groupBy(F.col("node").alias("id")).agg(F.sum("dependency").alias("s"), F.count("*").alias("ends"))
    raw = F.col("s") / 2 + (F.col("ends") if endpoints else F.lit(0))
    scale = 2.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    return _ids(graph).join(scores, "id", "left").select("id", (F.coalesce(raw, F.lit(0.0)) * scale).alias("score"))


def eigenvector_centrality(graph: PropertyGraph, max_iterations: int = 100, tolerance: float = 1e-6, zero: float | None = None) -> DataFrame:
    """(id, score): power iteration over incoming edges; a zero vector, as of a graph without cycles, becomes uniform, or all ``zero`` if that is given."""
    ids = materialize(_ids(graph), "eigen")
    n = ids.count()
    start = 1.0 / max(n, 1) ** 0.5
    now = materialize(ids.withColumn("score", F.lit(start)), "eigen")
    for _ in range(max_iterations):
        got = graph.edges.select("src", F.col("dst").alias("id")).join(now.select(F.col("id").alias("src"), "score"), "src").groupBy("id").agg(F.sum("score").alias("x"))
        fresh = materialize(now.withColumnRenamed("score", "old").join(got, "id", "left").fillna(0.0, ["x"]), "eigen")
        norm = (fresh.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]) or 0.0
        if norm == 0:
            return ids.withColumn("score", F.lit(start if zero is None else zero))
        scaled = fresh.withColumn("score", F.col("x") / norm)
        moved = scaled.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        now = scaled.select("id", "score")
        if moved < tolerance:
            break
        now = materialize(now, "eigen")
    return now


def connected_components(graph: PropertyGraph) -> DataFrame:
    """(id, component): weak components, named by their least node id."""
    found = _components(graph.edges)
    return _ids(graph).join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strongly_connected_components(graph: PropertyGraph, max_rounds: int = 1000) -> DataFrame:
    """(id, component): forward and backward colouring.

    Each round gives every node the least id that reaches it, then collects the
    nodes that reach that id inside its colour; those form components and leave.
    """
    left = materialize(_ids(graph), "scc")
    edges = materialize(graph.edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    done = left.where("false").withColumn("component", F.col("id"))
    for _ in range(max_rounds):
        if left.isEmpty():
            return done
        colour = _spread(left.withColumn("c", F.col("id")), edges, max_rounds)
        own = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        back = materialize(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc")
        marked = _flood(colour.where("id = c").select("id"), back, max_rounds)
        found = materialize(colour.join(marked, "id", "left_semi").select("id", F.col("c").alias("component")), "scc")
        done = done.union(found)
        left = materialize(left.join(found, "id", "left_anti"), "scc")
        edges = materialize(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc")
    raise RuntimeError("components did not settle")


def _spread(state: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """Least value ``c`` that reaches each node along ``edges``; each round sends only changed values."""
    now, changed = materialize(state, "spread"), state
    for _ in range(max_rounds):
        offer = changed.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("o"))
        fresh = materialize(now.join(offer, "id", "left").select("id", F.least("c", "o").alias("c"), (F.col("o") < F.col("c")).alias("less")), "spread")
        changed = fresh.where("less").select("id", "c")
        now = fresh.select("id", "c")
        if changed.isEmpty():
            return now
    raise RuntimeError("values did not settle")


def _flood(start: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    seen = frontier = materialize(start, "flood")
    for _ in range(max_rounds):
        found = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = materialize(found.join(seen, "id", "left_anti"), "flood")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    raise RuntimeError("flood did not settle")


def label_propagation(graph: PropertyGraph, max_iterations: int = 100) -> DataFrame:
    """(id, community): synchronous rounds over undirected neighbours; the most frequent label wins, a node's own on a
    tie, else the least. Oscillation ends with ``max_iterations``."""
    hops = materialize(_undirected_hops(graph), "labels")
    now = materialize(_ids(graph).withColumn("community", F.col("id")), "labels")
    for _ in range(max_iterations):
        votes = hops.join(now.select(F.col("id").alias("b"), F.col("community").alias("l")), "b").groupBy(F.col("a").alias("id"), "l").agg(F.count("*").alias("n"))
        best = votes.join(now, "id").groupBy("id").agg(F.max(F.struct("n", (F.col("l") == F.col("community")).alias("own"), (-F.col("l")).alias("m"))).alias("w"))
        fresh = materialize(now.join(best, "id", "left").select("id", F.coalesce(-F.col("w.m"), "community").alias("community"), F.col("community").alias("old")), "labels")
        changed = not fresh.where("community <> old").isEmpty()
        now = fresh.select("id", "community")
        if not changed:
            break
    return now


def modularity(graph: PropertyGraph, communities: DataFrame, weight: str | None = None) -> float:
    """Modularity of an undirected partition (columns id, community)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    edges = graph.edges.select("src", "dst", w.alias("w"))
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return 0.0
    named = edges.join(communities.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(communities.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    inside = named.where("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.sum("w").alias("i"))
    degree = named.select(F.col("cs").alias("c"), "w").union(named.select("cd", "w")).groupBy("c").agg(F.sum("w").alias("d"))
    parts = degree.join(inside, "c", "left").fillna(0.0, ["i"])
    return parts.agg(F.sum(F.col("i") / total - F.pow(F.col("d") / (2 * total), F.lit(2.0)))).first()[0]


def louvain(graph: PropertyGraph, max_iterations: int = 10, tolerance: float = 1e-4, weight: str | None = None) -> DataFrame:
    """(id, community): parallel local moves by modularity gain, then aggregation, while modularity grows.

    In a round a node moves only to a community whose name is less than its own in
    even rounds and greater in odd ones, so two nodes never swap.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    level = materialize(graph.edges.select("src", "dst", w.alias("w")), "louvain")
    total = level.agg(F.sum("w")).first()[0] or 0.0
    place = _ids(graph).withColumn("community", F.col("id"))
    if not total:
        return place
    best = modularity(graph, place, weight)
    for _ in range(max_iterations):
        moved = _local_moves(level, total)
        trial = materialize(place.join(moved.select(F.col("id").alias("community"), F.col("c").alias("next")), "community", "left").select("id", F.coalesce("next", "community").alias("community")), "louvain")
        score = modularity(graph, trial, weight)
        if score < best + tolerance:
            break
        best, place = score, trial
        level = materialize(level.join(moved.select(F.col("id").alias("src"), F.col("c").alias("s")), "src").join(moved.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), "louvain")
    names = place.groupBy("community").agg(F.min("id").alias("name"))
    return place.join(names, "community").select("id", F.col("name").alias("community"))


def _local_moves(level: DataFrame, total: float, rounds: int = 8) -> DataFrame:
    hops = level.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").union(level.where("src <> dst").select("dst", "src", "w"))
    hops = materialize(hops.groupBy("a", "b").agg(F.sum("w").alias("w")), "moves")
    degree = materialize(level.select(F.col("src").alias("id"), "w").union(level.select("dst", "w")).groupBy("id").agg(F.sum("w").alias("k")), "moves")
    now = materialize(degree.withColumn("c", F.col("id")), "moves")
    for turn in range(rounds):
        sums = now.groupBy("c").agg(F.sum("k").alias("t"))
        near = hops.join(now.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("a").alias("id"), F.col("cb").alias("to")).agg(F.sum("w").alias("kin"))
        offers = near.join(now, "id").join(sums.withColumnRenamed("c", "to"), "to")
        stay = offers.where("to = c").select("id", (F.col("kin") - F.col("k") * (F.col("t") - F.col("k")) / (2 * total)).alias("base"))
        alone = now.join(sums, "c").select("id", (-F.col("k") * (F.col("t") - F.col("k")) / (2 * total)).alias("lone"))
        aside = F.col("to") < F.col("c") if turn % 2 == 0 else F.col("to") > F.col("c")
        gain = offers.where("to <> c").where(aside).withColumn("g", F.col("kin") - F.col("k") * F.col("t") / (2 * total))
        best = gain.groupBy("id").agg(F.max(F.struct("g", (-F.col("to")).alias("m"))).alias("x"))
        joined = now.join(best, "id", "left").join(stay, "id", "left").join(alone, "id", "left")
        better = F.col("x.g") > F.coalesce("base", "lone") + 1e-12
        fresh = materialize(joined.select("id", "k", F.when(better, -F.col("x.m")).otherwise(F.col("c")).alias("c"), F.coalesce(better, F.lit(False)).alias("moved")), "moves")
        changed = not fresh.where("moved").isEmpty()
        now = fresh.select("id", "k", "c")
        if not changed and turn % 2:
            break
    return now


def triangles(graph: PropertyGraph) -> DataFrame:
    """(id, triangles): of the simple undirected graph; each edge points to its end of higher degree first."""
    pairs = graph.undirected()
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    degree = ends.groupBy("id").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    directed = materialize(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "triangles")
    wedges = directed.join(directed.select(F.col("x").alias("y"), F.col("y").alias("z")), "y")
    closed = wedges.join(directed.select("x", F.col("y").alias("z")), ["x", "z"])
    counts = closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return _ids(graph).join(counts, "id", "left").fillna(0, ["triangles"])


def clustering_coefficients(graph: PropertyGraph) -> DataFrame:
    """(id, coefficient): 2T/(d(d-1)), 0 below two neighbours."""
    pairs = graph.undirected()
    degree = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    return triangles(graph).join(degree, "id", "left").select("id", F.when(F.col("d") > 1, 2 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0)).alias("coefficient"))


def _rarest(near: DataFrame, size: DataFrame, share: float) -> DataFrame:
    """Of each node's neighbours the rarest, as many as two nodes with that share in common must have one of in common."""
    held = near.join(near.groupBy("dst").agg(F.count("*").alias("df")), "dst").join(size, "src")
    place = F.row_number().over(Window.partitionBy("src").orderBy("df", "dst"))
    # A little less than the share, so that rounding loses no pair.
    return held.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-6)) + 1).select("src", "dst")


def node_similarity(graph: PropertyGraph, measure: str = "jaccard", top: int | None = None, cutoff: float = 0.0, label: str | None = None, types: list[str] | None = None) -> DataFrame:
    """(node1, node2, similarity) by shared out-neighbours, node1 < node2; pairs that share none are left out.

    ``top`` is over all pairs. A Jaccard or cosine ``cutoff`` compares those pairs alone that share one of the
    rarest neighbours of each, so that a neighbour of very many nodes does not pair them all.
    """
    near = graph.edges_of(types).select("src", "dst").distinct()
    if label:
        near = near.join(graph.nodes_with(label).select(F.col("id").alias("src")), "src", "left_semi")
    size = near.groupBy("src").agg(F.count("*").alias("n"))
    one, two = near.select(F.col("src").alias("node1"), "dst"), near.select(F.col("src").alias("node2"), "dst")
    # A pair at the cutoff c shares c (Jaccard) or c * c (cosine) of either's neighbours at least.
    share = {"jaccard": cutoff, "cosine": cutoff * cutoff}.get(measure, 0.0)
    if share > 0:
        first = materialize(_rarest(near, size, share), "similar")
        pairs = first.select(F.col("src").alias("node1"), "dst").join(first.select(F.col("src").alias("node2"), "dst"), "dst").where("node1 < node2").select("node1", "node2").distinct()
        both = pairs.join(one, "node1").join(two, ["node2", "dst"])
    else:
        both = one.join(two, "dst").where("node1 < node2")
    both = both.groupBy("node1", "node2").agg(F.count("*").alias("i"))
    sized = both.join(size.select(F.col("src").alias("node1"), F.col("n").alias("n1")), "node1").join(size.select(F.col("src").alias("node2"), F.col("n").alias("n2")), "node2")
    score = {"jaccard": F.col("i") / (F.col("n1") + F.col("n2") - F.col("i")), "overlap": F.col("i") / F.least("n1", "n2"), "cosine": F.col("i") / F.sqrt(F.col("n1") * F.col("n2"))}[measure]
    found = sized.select("node1", "node2", score.alias("similarity")).where(F.col("similarity") >= cutoff)
    return found if top is None else found.orderBy(F.desc("similarity"), "node1", "node2").limit(top)


def pair_similarity(graph: PropertyGraph, node1: int, node2: int, measure: str = "jaccard", types: list[str] | None = None) -> DataFrame:
    """(node1, node2, similarity) of two nodes' out-neighbour sets; empty sets give 0."""
    near = graph.edges_of(types)
    sides = near.agg(F.collect_set(F.when(F.col("src") == node1, F.col("dst"))).alias("x"), F.collect_set(F.when(F.col("src") == node2, F.col("dst"))).alias("y"))
    both, some, least = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y")), F.least(F.size("x"), F.size("y"))
    score = both / F.nullif(some if measure == "jaccard" else least, F.lit(0))
    return sides.select(F.lit(node1).alias("node1"), F.lit(node2).alias("node2"), F.coalesce(score, F.lit(0.0)).alias("similarity"))


def property_cosine(graph: PropertyGraph, node1: int, node2: int, properties: list[str]) -> DataFrame:
    """(node1, node2, similarity) of numeric properties; a missing one is 0, a zero vector gives 0."""
    pick = lambda n, p: F.coalesce(F.max(F.when(F.col("id") == n, F.col(p).cast("double"))), F.lit(0.0))
    rows = graph.nodes.agg(*[pick(node1, p).alias(f"x_{p}") for p in properties], *[pick(node2, p).alias(f"y_{p}") for p in properties])
    add = lambda items: sum(items[1:], items[0])
    dot = add([F.col(f"x_{p}") * F.col(f"y_{p}") for p in properties])
    norms = F.sqrt(add([F.col(f"x_{p}") * F.col(f"x_{p}") for p in properties])) * F.sqrt(add([F.col(f"y_{p}") * F.col(f"y_{p}") for p in properties]))
    return rows.select(F.lit(node1).alias("node1"), F.lit(node2).alias("node2"), F.when(norms > 0, dot / norms).otherwise(F.lit(0.0)).alias("similarity"))
